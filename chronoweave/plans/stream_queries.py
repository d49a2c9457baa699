"""Registered queries: domain events in batch and as streams, streaming version building."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronoweave.ledger import with_closures
from chronoweave.plans import fixtures as fx
from chronoweave.plans.common import flat, sql, stored, t
from chronoweave.plans.ledger_queries import _PLAN
from chronoweave.session import checkpoint_root
from chronoweave.sources import event_io
from chronoweave.sources.event_io import MESSAGE_SCHEMA
from chronoweave.streaming import events as ev
from chronoweave.streaming.versions import VersionStore, stream_versions

_TYPE_OF = {
    "signup": "fact.version_recorded", "view": "evidence.captured", "purchase": "decision.recorded", "click": "context.captured",
}


def _uuid(kind: int, c):
    return F.concat(F.lit(f"00000000-0000-4000-800{kind}-"), F.lpad(c.cast("string"), 12, "0"))


def _uuid_sql(kind: int, c: str) -> str:
    return f"'00000000-0000-4000-800{kind}-' || lpad(cast({c} as varchar), 12, '0')"


def domain_events(s, d):
    """Events as domain events of four types, with payloads taken from the row."""
    e = fx.table(s, d, "events")
    i = F.col("event_id")
    rows = e.select(
        "event_type", "ts", _uuid(0, F.col("user_id") % 4).alias("organization_id"), _uuid(1, i).alias("id"),
        _uuid(2, F.col("user_id")).alias("fact_id"), F.lit(1).alias("version"), _uuid(3, i % 5).alias("source_id"),
        F.lit(None).cast("string").alias("supersedes_id"), F.col("ts").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"),
        F.lit(50).alias("authority"), fx.scope_by_six(i).alias("privacy_scope"), F.col("ts").alias("recorded_at"),
        F.lit("DOCUMENT_EXCERPT").alias("evidence_type"), F.sha2(i.cast("string"), 256).alias("content_sha256"), F.col("ts").alias("captured_at"),
        _uuid(4, i).alias("snapshot_id"), _uuid(5, F.col("user_id")).alias("decided_by_user_id"), F.lit(None).cast("string").alias("agent"),
        F.lit("order.approve").alias("action"), F.col("ts").alias("decided_at"), F.sha2(i.cast("string"), 256).alias("receipt_sha256"),
        _uuid(5, F.col("user_id")).alias("captured_by_user_id"), F.col("ts").alias("known_at"), F.lit(fx.MODEL).alias("embedding_model"),
        F.col("ts").alias("created_at"), F.col("ts").alias("valid_at"), F.col("value").alias("value"),
    )
    parts = [
        ev.events_from(rows.where(F.col("event_type") == name), kind, time="ts", event_id=F.col("id")) for name, kind in _TYPE_OF.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def messages(s, d):
    """What a broker would deliver: every tenth event twice, every error event as junk of four kinds."""
    good = ev.envelopes(domain_events(s, d)).select("topic", "key", "value")
    number = F.substring(F.get_json_object("value", "$.id"), 25, 12).cast("long")
    good = good.withColumn("n", number)
    twice = good.where(F.col("n") % 10 == 0)
    e = fx.table(s, d, "events").where("event_type = 'error'")
    i = F.col("event_id")
    some = F.concat(
        F.lit('{"specversion":"1.0","id":"'), _uuid(1, i), F.lit('","type":"'), F.when(i % 4 == 0, "fact.revoked").otherwise("fact.unheard"),
        F.lit('","source":"chronoweave","schema_version":1,"organization_id":"'), _uuid(0, F.col("user_id") % 4), F.lit('","subject":"'), _uuid(1, i),
        F.lit('","time":"2024-01-01T00:00:00+00:00","data":{}'), F.when(i % 4 == 1, ',"extra":1').otherwise(""), F.lit("}"),
    )
    junk = e.select(F.lit("chronoweave.facts.v1").alias("topic"), _uuid(0, F.col("user_id") % 4).alias("key"), F.when(i % 4 == 3, "{broken").otherwise(some).alias("value"), i.alias("n"))
    every = good.unionByName(twice).unionByName(junk)
    return every.select("topic", (F.col("n") % 8).cast("int").alias("partition"), F.col("n").alias("offset"), "key", "value")


_DOMAIN = f"""dom as (
 select {_uuid_sql(1, 'event_id')} as id, case event_type when 'signup' then 'fact.version_recorded' when 'view' then 'evidence.captured'
  when 'purchase' then 'decision.recorded' else 'context.captured' end as type, {_uuid_sql(0, 'user_id % 4')} as organization_id, ts, event_id as n, event_type from events where event_type <> 'error')"""
_DAILY = """select organization_id, strftime(ts, '%Y-%m-%d') as day, count(*) filter (event_type = 'signup') as facts_recorded,
 count(*) filter (event_type = 'view') as evidence_captured, count(*) filter (event_type = 'purchase') as decisions_recorded from dom
 where event_type <> 'click' group by 1, 2"""
_OUTCOMES = """select 'handled' as outcome, count(*) as messages from events where event_type in ('signup', 'view', 'purchase')
union all select 'duplicate', count(*) from events where event_type in ('signup', 'view', 'purchase') and event_id % 10 = 0
union all select 'ignored', count(*) + count(*) filter (event_id % 10 = 0) from events where event_type = 'click'
union all select 'dead_lettered', count(*) from events where event_type = 'error'"""


def _fresh_folder(s, name):
    return f"{checkpoint_root(s)}/chronoweave/{s.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def _stored_events(s, d):
    """Events published to a folder, read back as a broker's messages and decoded."""
    folder = _fresh_folder(s, "events")
    event_io.write_events(domain_events(s, d), folder=folder)
    read = event_io.read_events(s, folder=folder, streaming=False)
    return flat(ev.decode(read).select("topic", "key", "id", "type", "organization_id", "subject", "time", "problem"))


def _decoded(s, d):
    return ev.decode(messages(s, d))


def _good(s, d):
    decoded = _decoded(s, d)
    return decoded.where(F.col("problem").isNull())


def _streamed(s, d):
    """Run the activity projector over the messages as a file stream; returns its store."""
    prefix = _fresh_folder(s, "activity")
    source = f"{prefix}/in"
    messages(s, d).repartition(4).write.json(source)  # four files, two micro-batches
    store = ev.ActivityStore(f"{prefix}/out")
    stream = s.readStream.schema(MESSAGE_SCHEMA).option("maxFilesPerTrigger", 2).json(source)
    ev.run_activity(stream, store, f"{prefix}/ckpt").awaitTermination()
    return store


def _stream_activity(s, d):
    return flat(_streamed(s, d).activity(s))


def _stream_outcomes(s, d):
    return _streamed(s, d).read(s, "outcomes", "outcome string, messages long").groupBy("outcome").agg(F.sum("messages").alias("messages"))


def _stream_dedup(s, d):
    """The bounded-state variant: native streaming dedup within a watermark, into files."""
    prefix = _fresh_folder(s, "dedup")
    messages(s, d).write.json(f"{prefix}/in")
    stream = s.readStream.schema(MESSAGE_SCHEMA).json(f"{prefix}/in")
    good = ev.decode(stream).where(F.col("problem").isNull()).select("id", "type", "time")
    q = (
        ev.dedup_within(good, "60 days").writeStream.format("parquet").option("path", f"{prefix}/out")
        .option("checkpointLocation", f"{prefix}/ckpt").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return s.read.parquet(f"{prefix}/out").groupBy("type").agg(F.count(F.lit(1)).alias("events"))


def _stream_versions(s, d):
    """Claims arrive in three drops by arrival time; versions are built drop by drop."""
    def build():
        prefix = _fresh_folder(s, "claims")
        claims = fx.claims(s, d)
        store = VersionStore(f"{prefix}/out")
        for lo, hi in (("1970-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2100-01-01")):
            part = claims.where((F.col("arrival") >= F.lit(lo).cast("timestamp")) & (F.col("arrival") < F.lit(hi).cast("timestamp")))
            part.write.mode("append").parquet(f"{prefix}/in")
            stream = s.readStream.schema(claims.schema).parquet(f"{prefix}/in")
            stream_versions(stream, store, f"{prefix}/ckpt").awaitTermination()
        kinds = lambda name, *cols: store.read(s, name).select(*cols)
        v = kinds("versions", "organization_id", "id", "fact_id", "version", "valid_until", "recorded_at", "valid_until_recorded_at", "supersedes_id")
        c = kinds("closures", "organization_id", "fact_version_id", "valid_until", "recorded_at")
        x = kinds("contradictions", "left_version_id", F.col("right_version_id").alias("id"))
        return with_closures(v, c).join(x, "id", "left")

    return stored(s, d, "streamed_versions", build)


QUERIES = {
    "io10_projected_events": (
        lambda s, d: flat(domain_events(s, d).select("id", "type", "organization_id", "subject", "time", F.map_keys(F.from_json("data", "map<string,string>")).getItem(0).alias("first_field"),
                                                    F.size(F.json_object_keys("data")).alias("fields"))),
        f"""with {_DOMAIN}
select id, type, organization_id, id as subject, {t('ts')} as time, 'id' as first_field, case type when 'fact.version_recorded' then 10 when 'evidence.captured' then 7
 when 'decision.recorded' then 7 else 6 end as fields from dom""",
    ),
    "io8_event_messages": (
        lambda s, d: ev.envelopes(domain_events(s, d)).select("topic", "key", F.get_json_object("value", "$.id").alias("id"), F.size("headers").alias("headers")),
        f"""with {_DOMAIN}
select case when type like 'fact%' then 'chronoweave.facts.v1' when type like 'evidence%' then 'chronoweave.evidence.v1' else 'chronoweave.decisions.v1' end as topic,
 organization_id as key, id, 2 as headers from dom""",
    ),
    "io7_events_written_and_read": (
        _stored_events,
        f"""with {_DOMAIN}
select case when type like 'fact%' then 'chronoweave.facts.v1' when type like 'evidence%' then 'chronoweave.evidence.v1' else 'chronoweave.decisions.v1' end as topic,
 organization_id as key, id, type, organization_id, id as subject, {t('ts')} as time, cast(null as varchar) as problem from dom""",
    ),
    "st1_decoded_events": (
        lambda s, d: flat(_decoded(s, d).select("offset", "problem", "type", "time").withColumn(
            "time", F.when(F.col("problem").isNull(), F.col("time"))).withColumn("type", F.when(F.col("problem").isNull(), F.col("type")))),
        f"""with {_DOMAIN}, two as (select * from dom union all select * from dom where n % 10 = 0)
select n as offset, cast(null as varchar) as problem, type, {t('ts')} as time from two
union all select event_id, case event_id % 4 when 0 then 'undecodable: payload' when 1 then 'undecodable: envelope' when 2 then 'undecodable: unknown type'
 else 'undecodable: not a JSON object' end, null, null from events where event_type = 'error'""",
    ),
    "io9_dead_letters": (
        lambda s, d: ev.split_dead_letters(messages(s, d))[1].select("topic", "dlq_consumer", "dlq_error", "dlq_attempts", "dlq_source"),
        """select 'chronoweave.facts.v1.dlq' as topic, 'activity-projector' as dlq_consumer, (['undecodable: payload','undecodable: envelope','undecodable: unknown type','undecodable: not a JSON object'])[event_id % 4 + 1] as dlq_error,
 0 as dlq_attempts, 'chronoweave.facts.v1/' || (event_id % 8) || '/' || event_id as dlq_source from events where event_type = 'error'""",
    ),
    "st2_routed_events": (
        lambda s, d: ev.route(domain_events(s, d)).groupBy("topic", "type").agg(F.count(F.lit(1)).alias("events")),
        f"""with {_DOMAIN}
select case when type like 'fact%' then 'chronoweave.facts.v1' when type like 'evidence%' then 'chronoweave.evidence.v1' else 'chronoweave.decisions.v1' end as topic, type, count(*) as events from dom group by 1, 2""",
    ),
    "st3_subscription": (
        lambda s, d: ev.subscribe(domain_events(s, d), ev.COUNTER_OF).groupBy("type").agg(F.count(F.lit(1)).alias("events")),
        f"with {_DOMAIN}\nselect type, count(*) as events from dom where event_type <> 'click' group by 1",
    ),
    "st4_deduplicated": (
        lambda s, d: ev.dedup_exact(_good(s, d)).groupBy("type").agg(F.count(F.lit(1)).alias("events")),
        f"with {_DOMAIN}\nselect type, count(*) as events from dom group by 1",
    ),
    "st4_stream_dedup_within_watermark": (_stream_dedup, f"with {_DOMAIN}\nselect type, count(*) as events from dom group by 1"),
    "st5_activity_daily": (
        lambda s, d: flat(ev.activity_daily(ev.dedup_exact(_good(s, d)))), f"with {_DOMAIN}\n{_DAILY}",
    ),
    "st5_stream_activity_daily": (_stream_activity, f"with {_DOMAIN}\n{_DAILY}"),
    "st6_recent_activity": (
        lambda s, d: flat(ev.recent_activity(ev.activity_daily(ev.dedup_exact(_good(s, d))), 7, F.lit("2024-01-20").cast("date"))),
        f"with {_DOMAIN}, a as ({_DAILY})\nselect * from a where day >= '2024-01-14'",
    ),
    "st7_outcomes": (
        lambda s, d: ev.outcomes(_decoded(s, d), ev.dedup_exact(ev.subscribe(_good(s, d), ev.COUNTER_OF)).select("id")), _OUTCOMES,
    ),
    "st7_stream_outcomes": (_stream_outcomes, _OUTCOMES),
    "st8_stream_versions": (
        lambda s, d: flat(_stream_versions(s, d).select("id", "version", "supersedes_id", "valid_until", "recorded_at", "valid_until_recorded_at")),
        sql(_PLAN + f"\nselect id, version, supersedes_id, {t('valid_until')} as valid_until, {t('recorded_at')} as recorded_at, {t('valid_until_recorded_at')} as valid_until_recorded_at from built", "claims"),
    ),
    "st9_stream_contradictions": (
        lambda s, d: _stream_versions(s, d).where("left_version_id is not null").select("id", "left_version_id"),
        sql(
            _PLAN + """,
p as (select id, valid_from, source_id, value, supersedes_id, lag(source_id) over w as ps, lag(value) over w as pv, lag(observed_at) over w as po from built window w as (partition by fact_id order by version))
select id, supersedes_id as left_version_id from p where supersedes_id is not null and ps <> source_id and pv <> value and valid_from <= po""", "claims",
        ),
    ),
}
