"""Evaluation results as flat analytics rows, and the reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import scalars as sc

# The metrics of a run row, in column order.
RUN_METRICS = {
    "cases": "int", "cases_with_relevant_facts": "int", "mrr": "double",
    "recall@1": "double", "recall@3": "double", "recall@5": "double", "recall@10": "double",
    "precision@1": "double", "precision@3": "double", "precision@5": "double", "precision@10": "double",
    "ndcg@1": "double", "ndcg@3": "double", "ndcg@5": "double", "ndcg@10": "double",
    "temporal_correctness": "double", "authorization_correctness": "double", "forbidden_results": "int",
    "latency_ms_p50": "double",
}


def _common() -> list[Column]:
    return [
        sc.run_id(F.col("date"), F.col("commit_sha")).alias("run_id"),
        F.col("date").alias("run_timestamp"),
        "commit_sha",
        F.coalesce("working_tree_dirty", F.lit(False)).alias("working_tree_dirty"),
        F.col("dataset.name").alias("dataset_name"),
        F.col("dataset.version").alias("dataset_version"),
        F.coalesce("dataset.synthetic", F.lit(True)).alias("synthetic"),
        F.col("configuration.embedding_model").alias("embedding_model"),
        F.substring("date", 1, 10).alias("run_date"),
    ]


def metric_column_name(metric: str) -> str:
    return metric.replace("@", "_at_")


def run_rows(results: DataFrame) -> DataFrame:
    """One row per run and configuration with its metrics (``metrics``: map configuration -> map)."""
    rows = results.select(*_common(), F.explode("metrics").alias("configuration", "__m"))
    values = [F.col("__m")[m].try_cast("double").cast(t).alias(metric_column_name(m)) for m, t in RUN_METRICS.items()]
    return rows.select(*[c for c in rows.columns if c != "__m"], *values)


def case_rows(results: DataFrame) -> DataFrame:
    """One row per run, configuration and case (``cases``: map configuration -> array of cases)."""
    by_config = results.select(*_common(), F.explode("cases").alias("configuration", "__cs"))
    rows = by_config.select(*[c for c in by_config.columns if c != "__cs"], F.explode("__cs").alias("__c"))
    keys = F.coalesce("__c.ranked_keys", F.array().cast("array<string>"))
    relevant = F.array_distinct(F.coalesce("__c.relevant", F.array().cast("array<string>")))
    at = F.array_position(F.transform(keys, lambda k: F.array_contains(relevant, k)), True)
    first = F.when(at > 0, at.cast("int"))
    return rows.select(
        *[c for c in rows.columns if c != "__c"],
        F.col("__c.case_id").alias("case_id"), F.col("__c.category").alias("category"),
        F.size(relevant).alias("relevant_count"), F.size(keys).alias("returned_count"),
        first.alias("first_relevant_rank"),
        F.coalesce(F.bround(F.lit(1.0) / first, 4), F.lit(0.0)).alias("reciprocal_rank"),
        F.col("__c.latency_ms").alias("latency_ms"), F.col("__c.vector_search").alias("vector_search"),
        F.size(F.coalesce("__c.violations", F.array().cast("array<string>"))).alias("violation_count"),
    )


def best_recall_at_5(runs: DataFrame) -> DataFrame:
    return (
        runs.select("run_date", "run_id", "configuration", "recall_at_5", "mrr", "ndcg_at_5", "synthetic")
        .orderBy(F.col("run_date").desc(), F.col("recall_at_5").desc(), F.col("mrr").desc())
        .limit(20)
    )


def mrr_by_category(cases: DataFrame) -> DataFrame:
    """Order for display: category, mrr descending."""
    return (
        cases.where(F.col("relevant_count") > 0)
        .groupBy("configuration", "category")
        .agg(
            F.count(F.lit(1)).alias("cases"), F.round(F.avg("reciprocal_rank"), 4).alias("mrr"),
            F.round(F.expr("percentile_disc(0.5) within group (order by latency_ms)"), 2).alias("latency_ms_p50"),
        )
    )


def correctness_violations(cases: DataFrame) -> DataFrame:
    """Order for display: run_date descending, violation_count descending."""
    return cases.where(F.col("violation_count") > 0).select(
        "run_date", "run_id", "configuration", "case_id", "category", "violation_count"
    )


def trend_by_commit(runs: DataFrame) -> DataFrame:
    """Order for display: configuration, run_timestamp."""
    return runs.select(
        "configuration", "run_timestamp", F.substring("commit_sha", 1, 8).alias("commit_sha"), "working_tree_dirty",
        "mrr", "recall_at_5",
    )


def contradictions_by_source(contradictions: DataFrame, versions: DataFrame) -> DataFrame:
    """How many contradictions each source takes part in, and how often its side is preferred."""
    sides = contradictions.select(
        "organization_id", "preferred_version_id",
        F.explode(F.array("left_version_id", "right_version_id")).alias("id"),
    )
    return (
        sides.join(versions.select("organization_id", "id", "source_id"), ["organization_id", "id"])
        .groupBy("organization_id", "source_id")
        .agg(
            F.count(F.lit(1)).alias("contradictions"),
            F.count_if(F.col("preferred_version_id") == F.col("id")).alias("preferred"),
        )
    )


def failed_runs_by_agent(runs: DataFrame) -> DataFrame:
    return runs.groupBy("organization_id", "agent").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "failed").alias("failed")
    )
