"""Domain events: projection from table rows, envelopes, decoding, dedup, the daily read model.

Every function works on batch and streaming DataFrames; ``run_activity`` drives a stream with
``foreachBatch`` so that replaying a batch writes the same files again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.frames import computed_once
from chronoweave.functions.privacy import PRIVACY_ORDER
from chronoweave.session import cut_lineage
from chronoweave.streaming.keyed_log import BUCKETS, EVERY, KeyedLog

# Event types with the payload columns each may carry, as (field, kind, nullable).
# Payloads hold ids and metadata, never values, excerpts or outcomes.
EVENT_FIELDS = {
    "fact.version_recorded": (
        ("id", "uuid", False),
        ("fact_id", "uuid", False),
        ("version", "int", False),
        ("source_id", "uuid", False),
        ("supersedes_id", "uuid", True),
        ("valid_from", "time", False),
        ("valid_until", "time", True),
        ("authority", "int", False),
        ("privacy_scope", "scope", False),
        ("recorded_at", "time", False),
    ),
    "fact.embedding_stored": (
        ("fact_version_id", "uuid", False),
        ("model", "text", False),
        ("created_at", "time", False),
    ),
    "contradiction.detected": (
        ("id", "uuid", False),
        ("entity_id", "uuid", False),
        ("left_version_id", "uuid", False),
        ("right_version_id", "uuid", False),
        ("kind", "text", False),
        ("detector", "text", False),
        ("privacy_scope", "text", False),
        ("detected_at", "time", False),
    ),
    "fact.revoked": (
        ("id", "uuid", False),
        ("fact_version_id", "uuid", False),
        ("revoked_by_user_id", "uuid", False),
        ("revoked_at", "time", False),
    ),
    "evidence.captured": (
        ("id", "uuid", False),
        ("source_id", "uuid", False),
        ("evidence_type", "text", False),
        ("content_sha256", "text", False),
        ("privacy_scope", "scope", False),
        ("captured_at", "time", False),
        ("recorded_at", "time", False),
    ),
    "evidence.linked": (
        ("fact_version_id", "uuid", False),
        ("evidence_id", "uuid", False),
        ("relation", "text", False),
        ("linked_at", "time", False),
    ),
    "context.captured": (
        ("id", "uuid", False),
        ("captured_by_user_id", "uuid", False),
        ("valid_at", "time", False),
        ("known_at", "time", False),
        ("embedding_model", "text", False),
        ("created_at", "time", False),
    ),
    "decision.recorded": (
        ("id", "uuid", False),
        ("snapshot_id", "uuid", False),
        ("decided_by_user_id", "uuid", False),
        ("agent", "text", True),
        ("action", "text", False),
        ("decided_at", "time", False),
        ("receipt_sha256", "text", False),
    ),
    "decision.impacted": (
        ("revocation_id", "uuid", False),
        ("decision_id", "uuid", False),
        ("snapshot_id", "uuid", False),
        ("fact_version_id", "uuid", False),
        ("relied_on", "bool", False),
    ),
}
SUBJECT = {
    "fact.version_recorded": "id", "fact.embedding_stored": "fact_version_id", "contradiction.detected": "id",
    "fact.revoked": "fact_version_id", "evidence.captured": "id", "evidence.linked": "fact_version_id",
    "context.captured": "id", "decision.recorded": "id", "decision.impacted": "decision_id",
}
TOPIC_OF = {
    "fact.version_recorded": "facts", "fact.embedding_stored": "facts", "contradiction.detected": "facts",
    "fact.revoked": "facts", "evidence.captured": "evidence", "evidence.linked": "evidence",
    "context.captured": "decisions", "decision.recorded": "decisions", "decision.impacted": "decisions",
}
COUNTER_OF = {
    "fact.version_recorded": "facts_recorded", "evidence.captured": "evidence_captured",
    "decision.recorded": "decisions_recorded",
}
ENVELOPE_KEYS = ("specversion", "id", "type", "source", "schema_version", "organization_id", "subject", "time", "data")
UUID_PATTERN = r"^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"
AWARE_PATTERN = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})$"

SOURCE = "chronoweave"
PREFIX = "chronoweave"
ACTIVITY = "activity-projector"
MAX_DAYS = 366
MAX_ERROR_CHARS = 500


def topics(prefix: str = PREFIX) -> list[str]:
    return [f"{prefix}.{t}.v1" for t in ("facts", "evidence", "decisions")]


def _lookup(c: Column, table: dict[str, str]) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[c]


def topic_for(event_type: Column, prefix: str = PREFIX) -> Column:
    """Null for an unknown type."""
    return F.concat(F.lit(f"{prefix}."), _lookup(event_type, TOPIC_OF), F.lit(".v1"))


def route(events: DataFrame, prefix: str = PREFIX) -> DataFrame:
    return events.withColumn("topic", topic_for(F.col("type"), prefix))


def subscribe(events: DataFrame, types) -> DataFrame:
    return events.where(F.col("type").isin(*types))


def _iso(name: str, kind: str) -> Column:
    if kind == "time":
        return F.concat(F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    return F.col(name)


def events_from(rows: DataFrame, event_type: str, *, time: str, event_id: Column | None = None) -> DataFrame:
    """Rows of a changed table as events holding only the listed columns."""
    subject = F.col(SUBJECT[event_type]).cast("string")
    payload = F.to_json(
        F.struct(*[_iso(n, k).alias(n) for n, k, _ in EVENT_FIELDS[event_type]]), {"ignoreNullFields": "false"}
    )
    return rows.select(
        (F.sha2(F.concat_ws("|", F.lit(event_type), payload), 256) if event_id is None else event_id).alias("id"),
        F.lit(event_type).alias("type"),
        F.col("organization_id").cast("string").alias("organization_id"),
        subject.alias("subject"),
        F.col(time).alias("time"),
        payload.alias("data"),
    )


def envelopes(events: DataFrame, *, source: str = SOURCE, prefix: str = PREFIX) -> DataFrame:
    """``topic, key, value, headers``: one message per event, keyed by tenant so its order is kept."""
    head = F.to_json(
        F.struct(
            F.lit("1.0").alias("specversion"), "id", "type", F.lit(source).alias("source"),
            F.lit(1).alias("schema_version"), "organization_id", "subject",
            F.concat(F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")).alias("time"),
        )
    )
    value = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"data":'), F.col("data"), F.lit("}"))
    header = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("binary").alias("value"))
    return events.select(
        topic_for(F.col("type"), prefix).alias("topic"), F.col("organization_id").alias("key"), value.alias("value"),
        F.array(header("event_type", F.col("type")), header("event_id", F.col("id"))).alias("headers"),
    )


# --- decoding ------------------------------------------------------------------------------------


def _fits(value: Column, kind: Column) -> Column:
    """Is the text a value of the given kind? Null is no value."""
    return F.coalesce(
        F.when(kind == "uuid", value.rlike(UUID_PATTERN))
        .when(kind == "time", value.rlike(AWARE_PATTERN) & value.try_cast("timestamp").isNotNull())
        .when(kind == "int", value.try_cast("long").isNotNull())
        .when(kind == "bool", F.lower(value).isin("true", "false"))
        .when(kind == "scope", value.isin(*PRIVACY_ORDER))
        .otherwise(value.isNotNull()),
        F.lit(False),
    )


def _payload_rules() -> Column:
    """A constant map: event type -> its fields with kind and whether null is allowed."""
    pairs = []
    for event_type in EVENT_FIELDS:
        fields = [
            F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), F.lit(o).alias("nullable"))
            for n, k, o in EVENT_FIELDS[event_type]
        ]
        pairs += [F.lit(event_type), F.array(*fields)]
    return F.create_map(*pairs)


def decode(messages: DataFrame, *, source: str = SOURCE) -> DataFrame:
    """Parse and validate envelopes (``value``); ``problem`` is null for a good event.

    Unknown payload fields are ignored, unknown envelope fields are not. Split on ``problem``.
    """
    e = F.from_json("value", "map<string,string>")
    parsed = computed_once(
        messages,
        {"__keys": F.json_object_keys("value"), "__e": e, "__d": F.from_json(e["data"], "map<string,string>")},
    )
    env = lambda k: F.col("__e")[k]
    kinds = {"id": "uuid", "organization_id": "uuid", "subject": "uuid", "time": "time"}
    shape = (
        (F.size(F.array_except("__keys", F.array(*[F.lit(k) for k in ENVELOPE_KEYS]))) == 0)
        & (F.coalesce(env("specversion"), F.lit("1.0")) == "1.0")
        & (F.coalesce(env("source"), F.lit(source)) == source)
        & F.coalesce(env("schema_version"), F.lit("1")).try_cast("long").isNotNull()
        & F.forall(
            F.array(*[F.struct(env(n).alias("value"), F.lit(k).alias("kind")) for n, k in kinds.items()]),
            lambda f: _fits(f["value"], f["kind"]),
        )
        & F.col("__d").isNotNull()
    )
    payload = F.forall(
        _payload_rules()[env("type")],
        lambda f: F.map_contains_key("__d", f["name"])
        & ((f["nullable"] & F.col("__d")[f["name"]].isNull()) | _fits(F.col("__d")[f["name"]], f["kind"])),
    )
    problem = (
        F.when(F.col("__keys").isNull(), "undecodable: not a JSON object")
        .when(~F.coalesce(shape, F.lit(False)), "undecodable: envelope")
        .when(~F.coalesce(env("type").isin(*EVENT_FIELDS), F.lit(False)), "undecodable: unknown type")
        .when(~F.coalesce(payload, F.lit(False)), "undecodable: payload")
    )
    return parsed.select(
        *messages.columns, problem.alias("problem"), env("id").alias("id"), env("type").alias("type"),
        env("organization_id").alias("organization_id"), env("subject").alias("subject"),
        env("time").try_cast("timestamp").alias("time"), F.col("__d").alias("data"),
    )


def dead_letters(failed: DataFrame, consumer: str = ACTIVITY, attempts: int = 0) -> DataFrame:
    """Messages for ``<topic>.dlq`` with consumer, error, attempts and where they came from."""
    where = F.concat_ws("/", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    return failed.select(
        F.concat(F.col("topic"), F.lit(".dlq")).alias("topic"), "key", "value", F.lit(consumer).alias("dlq_consumer"),
        F.substring("problem", 1, MAX_ERROR_CHARS).alias("dlq_error"), F.lit(attempts).alias("dlq_attempts"),
        where.alias("dlq_source"),
    )


def split_dead_letters(messages: DataFrame, *, source: str = SOURCE) -> tuple[DataFrame, DataFrame]:
    decoded = decode(messages, source=source)
    return decoded.where(F.col("problem").isNull()).drop("problem"), dead_letters(decoded.where(F.col("problem").isNotNull()))


# --- dedup and counting ---------------------------------------------------------------------------


def dedup_exact(events: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """First occurrence of each event id that was never processed before (unbounded memory)."""
    first = events.dropDuplicates(["id"])
    return first if processed is None else first.join(processed.select("id"), "id", "left_anti")


def dedup_within(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Streaming dedup with bounded state: redeliveries later than ``delay`` are not recognised."""
    return events.withWatermark("time", delay).dropDuplicatesWithinWatermark(["id"])


def activity_daily(events: DataFrame) -> DataFrame:
    """Per tenant and UTC day the number of facts, evidence and decisions recorded."""
    counted = subscribe(events, COUNTER_OF)
    return counted.groupBy("organization_id", F.to_date("time").alias("day")).agg(
        *[F.count_if(F.col("type") == t).alias(c) for t, c in COUNTER_OF.items()]
    )


def recent_activity(activity: DataFrame, days: int, today: Column) -> DataFrame:
    """The last ``days`` days including today. Order for display: day."""
    if not 1 <= days <= MAX_DAYS:
        raise ValueError(f"days must be between 1 and {MAX_DAYS}")
    return activity.where(F.col("day") >= F.date_sub(today, days - 1))


def outcomes(decoded: DataFrame, fresh_ids: DataFrame, types=tuple(COUNTER_OF)) -> DataFrame:
    """How many messages were handled, duplicate, ignored or dead-lettered.

    ``fresh_ids`` are the event ids applied now; each was handled once, its other copies are
    duplicates.
    """
    wanted = F.col("type").isin(*types)
    tally = (
        decoded.withColumn("__bad", F.col("problem").isNotNull())
        .groupBy("__bad", F.when(~F.col("__bad") & wanted, F.col("id")).alias("id"))
        .agg(F.count(F.lit(1)).alias("n"))
        .join(fresh_ids.select("id", F.lit(1).alias("__fresh")), "id", "left")
    )
    fresh = F.coalesce("__fresh", F.lit(0))
    kinds = tally.select(
        F.when(F.col("__bad"), F.col("n")).otherwise(0).alias("dead_lettered"),
        F.when(~F.col("__bad") & F.col("id").isNull(), F.col("n")).otherwise(0).alias("ignored"),
        F.when(F.col("id").isNotNull(), fresh).otherwise(0).alias("handled"),
        F.when(F.col("id").isNotNull(), F.col("n") - fresh).otherwise(0).alias("duplicate"),
    )
    names = ("handled", "duplicate", "ignored", "dead_lettered")
    totals = kinds.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    return totals.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("outcome", "messages"))


@dataclass
class ActivityStore:
    """Append-only folders of the read model; one sub-folder per micro-batch."""

    root: str
    buckets: int = BUCKETS
    every: int = EVERY

    def processed(self) -> KeyedLog:
        """Ids of all events applied, by bucket; a batch reads the buckets its ids fall into."""
        return KeyedLog(f"{self.root}/processed", ["id"], buckets=self.buckets, every=self.every)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        """All batches of one table, empty when nothing was written yet."""
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(jvm_path):
            return spark.createDataFrame([], f"{schema}, batch_id long")
        return spark.read.schema(f"{schema}, batch_id long").parquet(self.path(name))

    def write(self, df: DataFrame, name: str, batch_id: int) -> None:
        """Replaces the rows of this batch only, so a replay leaves the same state."""
        df.write.mode("overwrite").parquet(f"{self.path(name)}/batch_id={batch_id}")

    def activity(self, spark: SparkSession) -> DataFrame:
        schema = "organization_id string, day date, " + ", ".join(f"{c} long" for c in COUNTER_OF.values())
        return self.read(spark, "activity", schema).groupBy("organization_id", "day").agg(
            *[F.sum(c).alias(c) for c in COUNTER_OF.values()]
        )


def apply_activity_batch(batch: DataFrame, batch_id: int, store: ActivityStore, *, source: str = SOURCE) -> None:
    """One micro-batch: decode, drop known ids, add to the daily counts, park what is undecodable."""
    spark = batch.sparkSession
    decoded = cut_lineage(decode(batch, source=source))  # four outputs read this batch
    good = subscribe(decoded.where(F.col("problem").isNull()), COUNTER_OF)
    processed = store.processed()
    earlier = processed.touched(spark, good.select("id"), batch_id)
    fresh = cut_lineage(dedup_exact(good.select("id", "type", "organization_id", "time"), earlier))
    store.write(dead_letters(decoded.where(F.col("problem").isNotNull())), "dead_letters", batch_id)
    store.write(activity_daily(fresh), "activity", batch_id)
    store.write(outcomes(decoded, fresh), "outcomes", batch_id)
    processed.append(fresh.select("id"), batch_id)


def run_activity(messages: DataFrame, store: ActivityStore, checkpoint: str, *, source: str = SOURCE, **trigger):
    """Start the projector; by default it works off what is available and stops."""
    return (
        messages.writeStream.foreachBatch(lambda b, i: apply_activity_batch(b, i, store, source=source))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
