"""Contradictions: detection between neighbouring versions, review findings, views, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import scalars as sc
from chronoweave.functions.privacy import max_scope, visible
from chronoweave.operators.ordered import with_neighbours
from chronoweave.operators.temporal import FACT

RULE = "observed-value-conflict-v1"  # fixed value: name of the rule
MAX_LIST = 200


def value_conflicts(versions: DataFrame, *, chunk_rows: int = 4096) -> DataFrame:
    """Consecutive versions P, N of different sources with different values, where P was observed at
    an instant that N now covers.

    P counts as it was claimed: its end matters only when it was given with the claim itself.
    """
    cols = [
        "id", "source_id", "value", "valid_until", "observed_at", "authority", "confidence",
        "privacy_scope", "recorded_at", "valid_until_recorded_at",
    ]
    pairs = with_neighbours(
        versions, FACT, "version", previous={f"p_{c}": c for c in cols}, chunk_rows=chunk_rows
    ).where(F.col("p_id").isNotNull())
    differs = (F.col("p_source_id") != F.col("source_id")) & (
        sc.canonical_json(F.col("p_value")) != sc.canonical_json(F.col("value"))
    )
    own_end = F.when(F.col("p_valid_until_recorded_at") == F.col("p_recorded_at"), F.col("p_valid_until"))
    within = own_end.isNull() | (F.col("p_observed_at") < own_end)
    covers = F.col("valid_from") <= F.col("p_observed_at")
    rank = lambda p: F.struct(
        F.col(f"{p}authority"), F.col(f"{p}confidence"), F.col(f"{p}observed_at")
    )
    return pairs.where(differs & within & covers).select(
        "organization_id",
        F.concat_ws("~", F.col("p_id").cast("string"), F.col("id").cast("string")).alias("id"),
        "entity_type",
        "external_id",
        F.col("p_id").alias("left_version_id"),
        F.col("id").alias("right_version_id"),
        F.lit("value_conflict").alias("kind"),
        F.lit(RULE).alias("detector"),
        F.concat(
            F.lit("source "), F.col("p_source_id").cast("string"), F.lit(" observed a different value at "),
            sc.utc_iso(F.col("p_observed_at")), F.lit(", which the new version (valid from "),
            sc.utc_iso(F.col("valid_from")), F.lit(") also covers"),
        ).alias("explanation"),
        F.when(rank("p_") >= rank(""), F.col("p_id")).otherwise(F.col("id")).alias("preferred_version_id"),
        max_scope(F.col("p_privacy_scope"), F.col("privacy_scope")).alias("privacy_scope"),
        F.lit("open").alias("status"),
        F.col("recorded_at").alias("detected_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        F.lit(None).cast("string").alias("resolved_by_user_id"),
        F.lit(None).cast("string").alias("resolution_note"),
    )


def accept_findings(
    findings: DataFrame, labelled: DataFrame, existing: DataFrame, detector: str
) -> tuple[DataFrame, DataFrame]:
    """Semantic findings over labelled facts: new contradictions, and per review the counts.

    ``findings``: ``review_id, left_label, right_label, explanation, found_at``; ``labelled``:
    ``review_id, label`` plus version columns.
    """
    side = lambda p: labelled.select(
        "review_id",
        F.col("label").alias(f"{p}_label"),
        F.col("organization_id").alias(f"{p}_org"),
        F.col("id").alias(f"{p}_id"),
        F.col("fact_id").alias(f"{p}_fact"),
        F.col("privacy_scope").alias(f"{p}_scope"),
        F.col("entity_type").alias(f"{p}_type"),
        F.col("external_id").alias(f"{p}_ext"),
    )
    f = findings.join(side("left"), ["review_id", "left_label"], "left").join(
        side("right"), ["review_id", "right_label"], "left"
    )
    bad = F.col("left_id").isNull() | F.col("right_id").isNull() | (F.col("left_fact") == F.col("right_fact"))
    swapped = F.col("left_id").cast("string") > F.col("right_id").cast("string")
    f = (
        f.withColumn("rejected", bad)
        .withColumn("organization_id", F.col("left_org"))
        .withColumn("left_version_id", F.when(swapped, F.col("right_id")).otherwise(F.col("left_id")))
        .withColumn("right_version_id", F.when(swapped, F.col("left_id")).otherwise(F.col("right_id")))
        .withColumn("entity_type", F.col("left_type"))
        .withColumn("external_id", F.col("left_ext"))
    )
    pair = ["organization_id", "left_version_id", "right_version_id"]
    good = f.where(~bad)
    firsts = good.groupBy(*pair).agg(
        F.min(F.struct("found_at", "review_id", F.substring("explanation", 1, 2000).alias("explanation"),
                       "entity_type", "external_id", max_scope(F.col("left_scope"), F.col("right_scope")).alias("privacy_scope"))).alias("__f"),
        F.count(F.lit(1)).alias("__n"),
    )
    new = firsts.join(existing.select(*pair), pair, "left_anti")
    rows = new.select(
        "organization_id",
        F.concat_ws("~", F.col("left_version_id").cast("string"), F.col("right_version_id").cast("string")).alias("id"),
        "__f.entity_type", "__f.external_id", "left_version_id", "right_version_id",
        F.lit("semantic").alias("kind"), F.lit(detector).alias("detector"), "__f.explanation",
        F.lit(None).cast(labelled.schema["id"].dataType).alias("preferred_version_id"),
        "__f.privacy_scope", F.lit("open").alias("status"), F.col("__f.found_at").alias("detected_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        F.lit(None).cast("string").alias("resolved_by_user_id"),
        F.lit(None).cast("string").alias("resolution_note"),
    )
    created = new.groupBy(F.col("__f.review_id").alias("review_id")).agg(F.count(F.lit(1)).alias("created"))
    counts = (
        f.groupBy("review_id")
        .agg(F.count_if("rejected").alias("rejected"), F.count_if(~F.col("rejected")).alias("__ok"))
        .join(created, "review_id", "left")
        .select("review_id", F.coalesce("created", F.lit(0)).alias("created"),
                (F.col("__ok") - F.coalesce("created", F.lit(0))).alias("known"), "rejected")
    )
    return rows, counts


def list_contradictions(
    contradictions: DataFrame,
    ceiling: str,
    *,
    status: str | None = None,
    entity_type: str | None = None,
    external_id: str | None = None,
    limit: int = 50,
) -> DataFrame:
    """Visible contradictions, newest first."""
    if not 1 <= limit <= MAX_LIST:
        raise ValueError(f"limit must be between 1 and {MAX_LIST}")
    c = contradictions.where(visible("privacy_scope", ceiling))
    for column, wanted in (("status", status), ("entity_type", entity_type), ("external_id", external_id)):
        if wanted is not None:
            c = c.where(F.col(column) == wanted)
    return c.orderBy(F.col("detected_at").desc(), "id").limit(limit)


def contradiction_view(contradictions: DataFrame, versions: DataFrame, sources: DataFrame) -> DataFrame:
    """Both versions of each contradiction with their property and source."""
    named = versions.join(
        sources.select("organization_id", F.col("id").alias("source_id"), F.col("name").alias("source_name")),
        ["organization_id", "source_id"],
        "left",
    )
    out = contradictions
    for p in ("left", "right"):
        side = named.select(
            "organization_id",
            F.col("id").alias(f"{p}_version_id"),
            *[
                F.col(c).alias(f"{p}_{c}")
                for c in ("fact_id", "property", "version", "value", "source_id", "source_name", "valid_from", "valid_until", "recorded_at")
            ],
        )
        out = out.join(side, ["organization_id", f"{p}_version_id"])
    return out


def apply_resolutions(contradictions: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Close open contradictions with the first valid entry of an append-only log.

    ``log``: ``organization_id, contradiction_id, entry_id, status, note, user_id, at``. Returns the
    current contradictions and the refused entries.
    """
    key = ["organization_id", "contradiction_id"]
    known = contradictions.select("organization_id", F.col("id").alias("contradiction_id"), F.col("status").alias("__now"))
    entries = log.join(known, key, "left")
    problem = (
        F.when(~F.col("status").isin("resolved", "dismissed"), "bad_status")
        .when(F.col("__now").isNull(), "not_found")
        .when(F.col("__now") != "open", "already_closed")
    )
    entries = entries.withColumn("problem", problem)
    good = entries.where(F.col("problem").isNull())
    first = good.groupBy(*key).agg(F.min(F.struct("at", "entry_id", "status", "note", "user_id")).alias("__e"))
    late = good.join(first.select(*key, F.col("__e.entry_id").alias("__first")), key).where(
        F.col("entry_id") != F.col("__first")
    )
    refused = entries.where(F.col("problem").isNotNull()).select(*key, "entry_id", "problem").unionByName(
        late.select(*key, "entry_id", F.lit("already_closed").alias("problem"))
    )
    e = first.select("organization_id", F.col("contradiction_id").alias("id"), "__e")
    hit = F.col("__e").isNotNull()
    new = {
        "status": F.when(hit, F.col("__e.status")).otherwise(F.col("status")),
        "resolved_at": F.when(hit, F.col("__e.at")).otherwise(F.col("resolved_at")),
        "resolved_by_user_id": F.when(hit, F.col("__e.user_id")).otherwise(F.col("resolved_by_user_id")),
        "resolution_note": F.when(hit, F.col("__e.note")).otherwise(F.col("resolution_note")),
    }
    joined = contradictions.join(e, ["organization_id", "id"], "left")
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in contradictions.columns]), refused
