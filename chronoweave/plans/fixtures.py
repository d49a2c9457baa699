"""Ledger tables derived from the driver's star-schema tables, for the registered queries.

One event is one version of the fact (user, event type); every order is a decision of the user it
maps to; documents are evidence. The derivation uses the package's own skew-safe operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions import scalars as sc
from chronoweave.ledger import Ledger
from chronoweave.operators.build import assign_recorded_at
from chronoweave.operators.ordered import HOT_ROWS, chunked_scan, time_chunk, with_neighbours
from chronoweave.operators.temporal import ENTITY, facts_at
from chronoweave.session import prepare

MODEL = "fixture:64"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its naive timestamps are UTC."""
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def _hours(n):
    return F.make_dt_interval(F.lit(0), n.cast("int"))


def scope_by_six(c):
    k = c % 6
    return (
        F.when(k == 0, "PUBLIC").when(k == 4, "CONFIDENTIAL").when(k == 5, "RESTRICTED").otherwise("INTERNAL")
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as claims, before versions are planned."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    amount = F.regexp_replace(F.col("value").cast("string"), r"\.0$", "")
    return e.select(
        (F.col("user_id") % 4).alias("organization_id"),
        i.alias("id"),
        F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_type")).alias("fact_id"),
        F.lit("user").alias("entity_type"),
        F.col("user_id").cast("string").alias("external_id"),
        F.col("event_type").alias("property"),
        amount.alias("value"),
        (i % 5).alias("source_id"),
        F.col("ts").alias("valid_from"),
        F.lit(None).cast("timestamp").alias("valid_until"),
        (F.col("ts") + _hours(6 * (i % 7))).alias("observed_at"),
        (F.col("ts") + _hours(i % 11)).alias("arrival"),
        (50 + 10 * (i % 5)).cast("int").alias("authority"),
        (F.lit(0.5) + (i % 50) * 0.01).cast("decimal(4,3)").alias("confidence"),
        scope_by_six(i).alias("privacy_scope"),
    )


def versions(spark: SparkSession, sf_dir: str, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The fact versions: numbered by valid time, recorded in strictly growing order, closed by the
    next version."""
    fact = ["organization_id", "fact_id"]
    timed = assign_recorded_at(
        claims(spark, sf_dir),
        [F.col("valid_from"), F.col("id")],
        chunk=time_chunk(F.col("valid_from")),
        hot_rows=hot_rows,
    ).withColumn("version", F.col("version").cast("int"))
    linked = with_neighbours(
        timed,
        fact,
        "version",
        previous={"supersedes_id": "id"},
        following={"__next_from": "valid_from", "__next_recorded": "recorded_at"},
    )
    return linked.select(
        "organization_id",
        "id",
        "fact_id",
        "entity_type",
        "external_id",
        "property",
        "version",
        "value",
        "source_id",
        "valid_from",
        F.col("__next_from").alias("valid_until"),
        "observed_at",
        "recorded_at",
        F.col("__next_recorded").alias("valid_until_recorded_at"),
        "supersedes_id",
        "authority",
        "confidence",
        "privacy_scope",
    )


def revocations(led: DataFrame) -> DataFrame:
    return led.where(F.col("id") % 37 == 0).select(
        "organization_id",
        F.col("id").alias("id"),
        F.col("id").alias("fact_version_id"),
        F.lit("found wrong").alias("reason"),
        F.lit("auditor").alias("revoked_by_user_id"),
        (F.col("recorded_at") + F.expr("INTERVAL '3' DAY")).alias("revoked_at"),
    )


def sources(led_or_spark, spark: SparkSession | None = None) -> DataFrame:
    spark = spark or led_or_spark
    return spark.range(20).select(
        (F.col("id") % 4).alias("organization_id"),
        F.floor(F.col("id") / 4).alias("id"),
        F.concat(F.lit("source-"), F.floor(F.col("id") / 4).cast("string")).alias("name"),
        F.element_at(
            F.array(*[F.lit(x) for x in ("SYSTEM_OF_RECORD", "API", "DOCUMENT", "HUMAN", "AGENT")]),
            (F.floor(F.col("id") / 4) + 1).cast("int"),
        ).alias("source_type"),
        F.lit(None).cast("string").alias("uri"),
        (50 + 10 * F.floor(F.col("id") / 4)).cast("int").alias("default_authority"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision per order, made by the user the order's customer maps to."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    ranked = chunked_scan(
        users, [], F.floor(F.col("user_id") / 4096), [F.col("user_id")], number="i"
    ).withColumn("i", F.col("i") - 1)
    n = users.agg(F.count(F.lit(1)).alias("n")).scalar()
    o = table(spark, sf_dir, "orders").withColumn("i", F.col("o_custkey") % n)
    return o.join(ranked, "i").select(
        (F.col("user_id") % 4).alias("organization_id"),
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").alias("snapshot_id"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("decided_by_user_id"),
        F.lit(None).cast("string").alias("agent"),
        F.lit("order.approve").alias("action"),
        F.concat(F.lit('{"priority":"'), F.col("o_orderpriority"), F.lit('"}')).alias("outcome"),
        F.lit(None).cast("string").alias("rationale"),
        F.col("user_id"),
        (
            F.lit("2024-01-01").cast("timestamp")
            + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_orderkey") * 7919 % 43200).cast("int"))
        ).alias("decided_at"),
    )


def snapshot_facts(
    led: DataFrame, revs: DataFrame, dec: DataFrame, *, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The facts of the decision's user valid and known at the decision, in the order of trust."""
    asks = dec.select(
        F.col("id").alias("ask_id"),
        "organization_id",
        F.lit("user").alias("entity_type"),
        F.col("user_id").cast("string").alias("external_id"),
        F.col("decided_at").alias("valid_at"),
        F.col("decided_at").alias("known_at"),
    )
    columns = [*ENTITY, "id", "property", "authority", "confidence"]
    held = facts_at(led, asks, revs, same_instant=True, columns=columns, hot_rows=hot_rows)
    trust = F.col("authority") * F.col("confidence")
    # Rows lie by entity: where an id asks about one user only, its context is ranked there.
    users = dec.groupBy("id").agg(F.min("user_id").alias("a"), F.max("user_id").alias("b"))
    own = ["ask_id"] if not users.where("a <> b").isEmpty() else [*ENTITY, "ask_id"]
    place = F.row_number().over(Window.partitionBy(*own).orderBy(trust.desc(), "id"))  # one decision's context
    return held.withColumn("position", place).select(
        "organization_id",
        F.col("ask_id").alias("snapshot_id"),
        F.col("id").alias("fact_version_id"),
        F.col("position").cast("int").alias("position"),
        "property",
    )


def decision_facts(snap: DataFrame) -> DataFrame:
    """Relied on: the first or the first two facts of the snapshot."""
    return snap.where(F.col("position") <= 1 + F.col("snapshot_id") % 2).select(
        "organization_id", F.col("snapshot_id").alias("decision_id"), "snapshot_id", "fact_version_id"
    )


def evidence_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a capture request, whole text."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        (F.col("doc_id") % 4).alias("organization_id"),
        F.col("doc_id").alias("id"),
        F.col("source").alias("source_id"),
        F.lit("DOCUMENT_EXCERPT").alias("evidence_type"),
        F.col("text").alias("excerpt"),
        F.lit(None).cast("string").alias("uri"),
        F.lit(None).cast("string").alias("metadata"),
        scope_by_six(F.col("doc_id")).alias("privacy_scope"),
        (
            F.lit("2024-01-01").cast("timestamp")
            + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("doc_id") % 43200).cast("int"))
        ).alias("captured_at"),
    )


def evidence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document d is linked to event (3 d mod number of events) of the same tenant."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    n = e.agg(F.count(F.lit(1)).alias("n")).scalar()
    d = table(spark, sf_dir, "documents").select("doc_id").withColumn("event_id", F.col("doc_id") * 3 % n)
    same = (F.col("doc_id") % 4) == (F.col("user_id") % 4)
    return d.join(e, "event_id").where(same).select(
        (F.col("doc_id") % 4).alias("organization_id"),
        F.col("doc_id").alias("evidence_id"),
        F.col("event_id").alias("fact_version_id"),
        F.when(F.col("doc_id") % 5 == 0, "CONTRADICTS").otherwise("SUPPORTS").alias("relation"),
        (
            F.lit("2024-01-02").cast("timestamp")
            + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("doc_id") % 43200).cast("int"))
        ).alias("linked_at"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    led = versions(spark, sf_dir)
    revs = revocations(led)
    dec = decisions(spark, sf_dir)
    snap = snapshot_facts(led, revs, dec)
    return Ledger(
        versions=led,
        sources=sources(spark),
        revocations=revs,
        decisions=dec,
        snapshot_facts=snap,
        decision_facts=decision_facts(snap),
        links=evidence_links(spark, sf_dir),
    )



