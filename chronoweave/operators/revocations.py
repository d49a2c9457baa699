"""Revoking versions, the decisions a revocation touches, and the reports on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import scalars as sc
from chronoweave.functions.privacy import visible
from chronoweave.operators.temporal import FACT, latest_versions

MAX_LIST = 100


def record_revocations(
    requests: DataFrame, versions: DataFrame, existing: DataFrame | None = None, ceiling: str = "RESTRICTED"
) -> tuple[DataFrame, DataFrame]:
    """First request per version wins; the rest are refused with a reason.

    ``requests``: ``organization_id, id, fact_id, version_id (null: latest), reason,
    revoked_by_user_id, requested_at``.
    """
    head = latest_versions(versions).select(*FACT, F.col("id").alias("__latest"))
    r = requests.withColumn("reason", sc.strip(F.col("reason"))).join(head, FACT, "left")
    r = r.withColumn("fact_version_id", F.coalesce("version_id", "__latest"))
    seen = versions.where(visible("privacy_scope", ceiling)).select(
        *FACT, F.col("id").alias("fact_version_id"), F.lit(True).alias("__found")
    )
    r = r.join(seen, [*FACT, "fact_version_id"], "left")
    key = ["organization_id", "fact_version_id"]
    if existing is not None:
        r = r.join(existing.select(*key, F.lit(True).alias("__before")), key, "left")
    else:
        r = r.withColumn("__before", F.lit(None).cast("boolean"))
    problem = (
        F.when(F.length("reason").between(1, sc.REASON_MAX), F.lit(None)).otherwise(F.lit("bad_reason"))
    )
    problem = F.coalesce(
        problem,
        F.when(F.col("__latest").isNull(), "fact_not_found"),
        F.when(F.col("__found").isNull(), "version_not_found"),
        F.when(F.col("__before").isNotNull(), "already_revoked"),
    )
    r = r.withColumn("problem", problem)
    good = r.where(F.col("problem").isNull())
    winner = good.groupBy(*key).agg(F.min(F.struct("requested_at", "id")).alias("__w")).select(
        "organization_id", F.col("__w.id").alias("id")
    )
    done = good.join(winner, ["organization_id", "id"], "left_semi").select(
        "organization_id", "id", "fact_version_id", "reason", "revoked_by_user_id",
        F.col("requested_at").alias("revoked_at"),
    )
    late = good.join(winner, ["organization_id", "id"], "left_anti").withColumn("problem", F.lit("already_revoked"))
    refused = r.where(F.col("problem").isNotNull()).unionByName(late)
    return done, refused.select("organization_id", "id", "fact_id", "problem")


def decisions_holding(revocations: DataFrame, snapshot_facts: DataFrame, decisions: DataFrame, decision_facts: DataFrame) -> DataFrame:
    """Every (revocation, decision) whose frozen context held the revoked version."""
    r = revocations.select("organization_id", F.col("id").alias("revocation_id"), "fact_version_id", "revoked_at")
    held = snapshot_facts.select("organization_id", "snapshot_id", "fact_version_id").join(
        r, ["organization_id", "fact_version_id"]
    )
    d = decisions.select(
        "organization_id", F.col("id").alias("decision_id"), "snapshot_id", "action", "agent", "decided_at"
    )
    relied = decision_facts.select("organization_id", "decision_id", "fact_version_id", F.lit(True).alias("relied_on"))
    return (
        held.join(d, ["organization_id", "snapshot_id"])
        .join(relied, ["organization_id", "decision_id", "fact_version_id"], "left")
        .withColumn("relied_on", F.coalesce("relied_on", F.lit(False)))
    )


def impact_rows(revocations, snapshot_facts, decisions, decision_facts) -> DataFrame:
    """The decisions already made when the version was revoked, as stored at that moment."""
    return (
        decisions_holding(revocations, snapshot_facts, decisions, decision_facts)
        .where(F.col("decided_at") <= F.col("revoked_at"))
        .select("organization_id", "revocation_id", "decision_id", "snapshot_id", "fact_version_id", "relied_on")
    )


def revocation_decisions(revocations, snapshot_facts, decisions, decision_facts, impacts) -> DataFrame:
    """One row per (revocation, decision), recomputed, marked by whether it was stored at the time."""
    stored = impacts.select("organization_id", "revocation_id", "decision_id", F.lit(True).alias("__stored"))
    rows = decisions_holding(revocations, snapshot_facts, decisions, decision_facts).join(
        stored, ["organization_id", "revocation_id", "decision_id"], "left"
    )
    was = F.coalesce("__stored", F.lit(False))
    return rows.select(
        "organization_id", "revocation_id", "decision_id", "snapshot_id", "fact_version_id", "action", "agent",
        "decided_at", "relied_on", was.alias("recorded_at_revocation"), (~was).alias("decided_after_revocation"),
    )


def revocation_report(revocations: DataFrame, versions: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per revocation: what was revoked and how many decisions it touches.

    ``rows`` comes from ``revocation_decisions``; decisions stay rows, only counts are grouped.
    """
    counts = rows.groupBy("organization_id", "revocation_id").agg(
        F.count(F.lit(1)).alias("decisions_with_version_in_context"),
        F.count_if("relied_on").alias("decisions_relied_on"),
        F.count_if("decided_after_revocation").alias("decided_after_revocation"),
    )
    v = versions.select(
        "organization_id", F.col("id").alias("fact_version_id"), "fact_id", "entity_type", "external_id",
        "property", "version", "privacy_scope",
    )
    r = revocations.select(
        "organization_id", F.col("id").alias("revocation_id"), "fact_version_id", "reason", "revoked_by_user_id", "revoked_at"
    )
    zero = ["decisions_with_version_in_context", "decisions_relied_on", "decided_after_revocation"]
    return (
        r.join(v, ["organization_id", "fact_version_id"])
        .join(counts, ["organization_id", "revocation_id"], "left")
        .fillna(0, subset=zero)
    )


def impact_of_fact(report: DataFrame, facts: DataFrame, ceiling: str) -> DataFrame:
    """Reports of the given facts' revoked versions the caller may see."""
    return report.join(facts.select(*FACT), FACT, "left_semi").where(visible("privacy_scope", ceiling))


def list_revocations(report: DataFrame, ceiling: str, limit: int = 20) -> DataFrame:
    """Newest first."""
    if not 1 <= limit <= MAX_LIST:
        raise ValueError(f"limit must be between 1 and {MAX_LIST}")
    seen = report.where(visible("privacy_scope", ceiling))
    return seen.orderBy(F.col("revoked_at").desc(), "revocation_id").limit(limit)
