"""Shared pieces of the registered queries: stored fixture tables and SQL building blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import build
from chronoweave.operators.contradictions import value_conflicts
from chronoweave.plans import fixtures as fx
from chronoweave.session import checkpoint_root, prepare

_STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived ledger table, written once per session to the shared folder and read from there.

    The ledger is a stored table in real use too; queries then start from files with pushdown.
    """
    prepare(spark)
    app = spark.sparkContext.applicationId
    key = (app, sf_dir, name)
    if key not in _STORED:
        tag = hashlib.sha256(sf_dir.encode()).hexdigest()[:12]
        path = f"{checkpoint_root(spark)}/chronoweave/{app}/{tag}/{name}"
        make().write.mode("overwrite").parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def led(s: SparkSession, d: str) -> DataFrame:
    return stored(s, d, "versions", lambda: fx.versions(s, d))


def revs(s: SparkSession, d: str) -> DataFrame:
    return fx.revocations(led(s, d))


def dec(s: SparkSession, d: str) -> DataFrame:
    return stored(s, d, "decisions", lambda: fx.decisions(s, d))


def snap(s: SparkSession, d: str) -> DataFrame:
    return stored(s, d, "snapshot_facts", lambda: fx.snapshot_facts(led(s, d), revs(s, d), dec(s, d)))


def relied(s: SparkSession, d: str) -> DataFrame:
    return fx.decision_facts(snap(s, d))


def src(s: SparkSession, d: str) -> DataFrame:
    return fx.sources(s)


def snapshots(s: SparkSession, d: str) -> DataFrame:
    """The frozen context of each decision."""
    return dec(s, d).select(
        "organization_id", F.col("snapshot_id").alias("id"), F.col("decided_by_user_id").alias("captured_by_user_id"),
        F.concat(F.lit("facts of user "), F.col("user_id").cast("string")).alias("query"),
        F.col("decided_at").alias("valid_at"), F.col("decided_at").alias("known_at"),
        F.lit(fx.MODEL).alias("embedding_model"), F.lit("unavailable").alias("vector_search"),
        F.array(F.lit("PUBLIC"), F.lit("INTERNAL"), F.lit("CONFIDENTIAL"), F.lit("RESTRICTED")).alias("privacy_scopes"),
    )


def evidence(s: SparkSession, d: str) -> DataFrame:
    return stored(s, d, "evidence", lambda: build.capture_evidence(fx.evidence_requests(s, d))[0])


def links(s: SparkSession, d: str) -> DataFrame:
    """Links between captured evidence and versions."""
    known = evidence(s, d).select("organization_id", F.col("id").alias("evidence_id"))
    return fx.evidence_links(s, d).join(known, ["organization_id", "evidence_id"], "left_semi")


def conflicts(s: SparkSession, d: str) -> DataFrame:
    return stored(s, d, "contradictions", lambda: value_conflicts(led(s, d)))


def flat(df: DataFrame) -> DataFrame:
    """Times and days as text, decimals as doubles, so that rows compare across engines."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "decimal":
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


# --- the same fixture in SQL -----------------------------------------------------------------------


def t(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


SCOPE_OF = (
    "case {0} % 6 when 0 then 'PUBLIC' when 4 then 'CONFIDENTIAL' when 5 then 'RESTRICTED' else 'INTERNAL' end"
)
ORD = "(case {0} when 'PUBLIC' then 0 when 'INTERNAL' then 1 when 'CONFIDENTIAL' then 2 else 3 end)"


def ordinal(column: str) -> str:
    return ORD.format(column)


CTE = {
    "claims": f"""
claims as (
 select event_id as id, user_id % 4 as organization_id, user_id, user_id || ':' || event_type as fact_id,
  'user' as entity_type, cast(user_id as varchar) as external_id, event_type as property, ts as valid_from,
  regexp_replace(cast(value as varchar), '\\.0$', '') as value, event_id % 5 as source_id,
  ts + INTERVAL '6' HOUR * (event_id % 7) as observed_at, ts + INTERVAL '1' HOUR * (event_id % 11) as arrival,
  cast(50 + 10 * (event_id % 5) as int) as authority, cast(0.5 + (event_id % 50) * 0.01 as decimal(4,3)) as confidence,
  {SCOPE_OF.format('event_id')} as privacy_scope
 from events)""",
    "led": """
led_b as (select *, row_number() over (partition by fact_id order by valid_from, id) as version from claims),
led_r as (
 select *, max(arrival - INTERVAL '0.000001' SECOND * version) over (partition by fact_id order by version rows unbounded preceding)
  + INTERVAL '0.000001' SECOND * version as recorded_at from led_b),
led as (
 select *, lead(valid_from) over (partition by fact_id order by version) as valid_until,
  lead(recorded_at) over (partition by fact_id order by version) as valid_until_recorded_at,
  lag(id) over (partition by fact_id order by version) as supersedes_id from led_r)""",
    "revs": """
revs as (select id, id as fact_version_id, organization_id, 'found wrong' as reason, recorded_at + INTERVAL '3' DAY as revoked_at
 from led where id % 37 = 0)""",
    "dec": """
dec as (
 select o.o_orderkey as id, o.o_orderkey as snapshot_id, u.user_id, u.user_id % 4 as organization_id,
  'user-' || u.user_id as decided_by_user_id, 'order.approve' as action, '{"priority":"' || o.o_orderpriority || '"}' as outcome,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * (o.o_orderkey * 7919 % 43200) as decided_at
 from orders o join (select user_id, row_number() over (order by user_id) - 1 as i, count(*) over () as n
  from (select distinct user_id from events) q) u on o.o_custkey % u.n = u.i)""",
    "snap": """
snap as materialized (
 select *, position <= 1 + snapshot_id % 2 as relied_on from (
  select d.organization_id, d.snapshot_id, l.id as fact_version_id, l.property,
   row_number() over (partition by d.id order by l.authority * l.confidence desc, l.id) as position
  from dec d join led l on l.user_id = d.user_id and l.recorded_at <= d.decided_at and l.valid_from <= d.decided_at
   and (l.valid_until is null or l.valid_until_recorded_at > d.decided_at or l.valid_until > d.decided_at)
  left join revs r on r.fact_version_id = l.id and r.revoked_at <= d.decided_at where r.fact_version_id is null) q)""",
    "relied": """
relied as (select organization_id, snapshot_id as decision_id, snapshot_id, fact_version_id from snap where relied_on)""",
    "src": """
src as (
 select i % 4 as organization_id, i // 4 as id, 'source-' || (i // 4) as name,
  (['SYSTEM_OF_RECORD','API','DOCUMENT','HUMAN','AGENT'])[(i // 4) + 1] as source_type, cast(50 + 10 * (i // 4) as int) as default_authority
 from range(20) r(i))""",
    "excerpts": f"""
excerpts as (
 select doc_id as id, doc_id % 4 as organization_id, source as source_id,
  regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') as excerpt,
  {SCOPE_OF.format('doc_id')} as privacy_scope,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * (doc_id % 43200) as captured_at
 from documents)""",
    "evid": """
evid as (
 select * exclude (k) from (
  select *, sha256(excerpt) as content_sha256,
   row_number() over (partition by organization_id, source_id, sha256(excerpt) order by captured_at, id) as k
  from excerpts where length(excerpt) between 1 and 8000) q where k = 1)""",
    "links": """
links as (
 select d.doc_id % 4 as organization_id, d.doc_id as evidence_id, e.event_id as fact_version_id,
  case when d.doc_id % 5 = 0 then 'CONTRADICTS' else 'SUPPORTS' end as relation,
  TIMESTAMP '2024-01-02 00:00:00' + INTERVAL '1' MINUTE * (d.doc_id % 43200) as linked_at
 from documents d join events e on e.event_id = d.doc_id * 3 % (select count(*) from events)
 where d.doc_id % 4 = e.user_id % 4 and d.doc_id in (select id from evid))""",
    "conf": f"""
pairs as (
 select *, lag(id) over w as p_id, lag(source_id) over w as p_source_id, lag(value) over w as p_value,
  lag(observed_at) over w as p_observed_at, lag(authority) over w as p_authority, lag(confidence) over w as p_confidence,
  lag(privacy_scope) over w as p_scope
 from led window w as (partition by fact_id order by version)),
conf as (
 select organization_id, p_id || '~' || id as id, entity_type, external_id, p_id as left_version_id, id as right_version_id,
  'value_conflict' as kind, 'open' as status,
  case when (p_authority, p_confidence, p_observed_at) >= (authority, confidence, observed_at) then p_id else id end as preferred_version_id,
  case when {ordinal('p_scope')} >= {ordinal('privacy_scope')} then p_scope else privacy_scope end as privacy_scope,
  recorded_at as detected_at
 from pairs where p_id is not null and p_source_id <> source_id and p_value <> value and valid_from <= p_observed_at)""",
}
NEEDS = {
    "led": ["claims"], "revs": ["led"], "dec": [], "snap": ["dec", "led", "revs"], "relied": ["snap"], "src": [],
    "claims": [], "excerpts": [], "evid": ["excerpts"], "links": ["evid"], "conf": ["led"],
}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """A query over the named fixture tables and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS[name]:
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    parts = [CTE[n].strip() for n in order]
    body = body.strip()
    extra = ""
    if body.lower().startswith("with "):
        extra, body = body[5:].rsplit("\nselect", 1)
        parts.append(extra.strip())
        body = "select" + body
    head = "with recursive " if recursive else "with "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body
