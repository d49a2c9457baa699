"""Evaluation datasets and results as tables; the analytics tables as partitioned JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators.analytics import case_rows, run_rows

# The shape of dataset and result files.
FACT_SPEC = (
    "key string, property string, value string, hours double, entity_type string, external_id string, "
    "source string, authority int, confidence string, privacy_scope string, tenant string, revoked boolean"
)
DATASET_SCHEMA = (
    "name string, version string, synthetic boolean, description string, cases array<struct<"
    "id:string, category:string, question:string, query:string, valid_at_hours:double, caller_role:string, "
    "relevant:array<string>, forbidden:map<string,string>, "
    "facts:array<struct<" + ", ".join(f"{f.split()[0]}:{f.split()[1]}" for f in FACT_SPEC.split(", ")) + ">>, "
    "expect:struct<status:string, answer_contains:array<string>, answer_excludes:array<string>, "
    "cited_keys:array<string>, forbidden_in_context:array<string>>>>"
)
RESULT_SCHEMA = (
    "kind string, date string, commit_sha string, working_tree_dirty boolean, "
    "dataset struct<name:string, version:string, synthetic:boolean, cases:int>, "
    "configuration struct<embedding_model:string>, metrics map<string, map<string,string>>, "
    "cases map<string, array<struct<case_id:string, category:string, ranked_keys:array<string>, "
    "relevant:array<string>, forbidden:map<string,string>, latency_ms:double, vector_search:string, "
    "violations:array<string>>>>"
)
EPOCH = "2026-01-15 09:00:00"


def read_eval_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases, their facts, and problems (duplicate ids or keys, references to unknown keys).

    Handles answer cases (``question``, ``expect``) and retrieval cases (``query``, ``relevant``,
    ``forbidden``). A dataset with problems should not be used.
    """
    raw = spark.read.schema(DATASET_SCHEMA).json(path, multiLine=True)
    case = raw.select(
        F.col("name").alias("dataset_name"), F.col("version").alias("dataset_version"), "synthetic", F.explode("cases").alias("c")
    )
    hours = lambda h: F.timestamp_micros(
        F.unix_micros(F.lit(EPOCH).cast("timestamp")) + (h * 3_600_000_000).cast("long")
    )
    none = F.array().cast("array<string>")
    cases = case.select(
        "dataset_name", "dataset_version", "synthetic", F.col("c.id").alias("case_id"), "c.category",
        F.coalesce("c.question", "c.query").alias("query"), hours(F.col("c.valid_at_hours")).alias("valid_at"),
        F.coalesce("c.caller_role", F.lit("ADMIN")).alias("caller_role"),
        F.coalesce("c.relevant", none).alias("relevant"),
        F.coalesce("c.forbidden", F.create_map().cast("map<string,string>")).alias("forbidden"),
        F.col("c.expect.status").alias("expected_status"),
        F.coalesce("c.expect.answer_contains", none).alias("answer_contains"),
        F.coalesce("c.expect.answer_excludes", none).alias("answer_excludes"),
        F.coalesce("c.expect.cited_keys", none).alias("cited_keys"),
        F.coalesce("c.expect.forbidden_in_context", none).alias("forbidden_in_context"),
    )
    f = case.select(F.col("c.id").alias("case_id"), F.explode("c.facts").alias("f"))
    facts = f.select(
        "case_id", "f.key", "f.property", "f.value", hours(F.coalesce("f.hours", F.lit(0.0))).alias("valid_from"),
        F.coalesce("f.entity_type", F.lit("customer")).alias("entity_type"),
        F.coalesce("f.external_id", F.lit("customer-991")).alias("external_id"),
        F.coalesce("f.source", F.lit("billing-db")).alias("source"), "f.authority",
        F.coalesce("f.confidence", F.lit("1.000")).cast("decimal(4,3)").alias("confidence"),
        F.coalesce("f.privacy_scope", F.lit("INTERNAL")).alias("privacy_scope"),
        F.coalesce("f.tenant", F.lit("self")).alias("tenant"),
        F.coalesce("f.revoked", F.lit(False)).alias("revoked"),
    )
    twice = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit("duplicate_case_id").alias("problem"), "case_id", F.lit(None).cast("string").alias("key")
    )
    keys = facts.groupBy("case_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit("duplicate_fact_key").alias("problem"), "case_id", "key"
    )
    named = cases.select(
        "case_id", F.explode(F.array_union(F.array_union("cited_keys", "relevant"), F.map_keys("forbidden"))).alias("key")
    )
    unknown = named.join(facts, ["case_id", "key"], "left_anti").select(F.lit("unknown_key").alias("problem"), "case_id", "key")
    both = cases.select(
        "case_id", F.explode(F.array_intersect("relevant", F.map_keys("forbidden"))).alias("key")
    ).select(F.lit("relevant_and_forbidden").alias("problem"), "case_id", "key")
    problems = twice.unionByName(keys).unionByName(unknown).unionByName(both)
    return cases, facts, problems


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """Retrieval evaluation results (``retrieval-*.json``); files of another kind are left out."""
    df = spark.read.schema(RESULT_SCHEMA).json(f"{folder}/retrieval-*.json", multiLine=True)
    return df.where(F.col("kind") == "retrieval-evaluation")


def export_runs(results: DataFrame, out: str) -> None:
    run_rows(results).write.mode("overwrite").partitionBy("run_date").json(f"{out}/retrieval_runs")


def export_cases(results: DataFrame, out: str) -> None:
    case_rows(results).write.mode("overwrite").partitionBy("run_date").json(f"{out}/retrieval_cases")


_COMMON = (
    "run_id string, run_timestamp string, commit_sha string, working_tree_dirty boolean, dataset_name string, "
    "dataset_version string, synthetic boolean, embedding_model string, configuration string, "
)
ANALYTICS_SCHEMAS = {
    "retrieval_runs": _COMMON
    + "cases int, cases_with_relevant_facts int, mrr double, recall_at_1 double, recall_at_3 double, recall_at_5 double, "
    "recall_at_10 double, precision_at_1 double, precision_at_3 double, precision_at_5 double, precision_at_10 double, "
    "ndcg_at_1 double, ndcg_at_3 double, ndcg_at_5 double, ndcg_at_10 double, temporal_correctness double, "
    "authorization_correctness double, forbidden_results int, latency_ms_p50 double, run_date date",
    "retrieval_cases": _COMMON
    + "case_id string, category string, relevant_count int, returned_count int, first_relevant_rank int, "
    "reciprocal_rank double, latency_ms double, vector_search string, violation_count int, run_date date",
}


def register_analytics(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Both analytics tables as temporary views; ``run_date`` is a partition column and prunes."""
    out = {}
    for name, schema in ANALYTICS_SCHEMAS.items():
        out[name] = spark.read.schema(schema).json(f"{folder}/{name}")
        out[name].createOrReplaceTempView(name)
    return out
