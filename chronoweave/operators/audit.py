"""Data-quality jobs over the ledger: each returns ``rule, key`` of violating rows.

An empty result means a sound ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import scalars as sc
from chronoweave.functions.privacy import PRIVACY_ORDER
from chronoweave.operators.ordered import HOT_ROWS, chunked_scan, time_chunk
from chronoweave.operators.temporal import FACT

# Allowed values of the enumerated columns.
EVIDENCE_TYPES = ("DOCUMENT_EXCERPT", "API_RESPONSE", "DATABASE_RECORD", "HUMAN_STATEMENT", "AGENT_OUTPUT")
CONTRADICTION_KINDS = ("value_conflict", "semantic")
CONTRADICTION_STATUSES = ("open", "resolved", "dismissed")
_FAR = "9999-12-31"


def _key(*columns: str) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def _flag(df: DataFrame, rule: str, *key: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), _key(*key).alias("key"))


def _broken(condition: Column) -> Column:
    """A check that is null counts as broken."""
    return ~F.coalesce(condition, F.lit(False))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overlapping_validity(versions: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Versions that start before an earlier-starting version of the fact has ended."""
    end = F.coalesce(F.col("valid_until"), F.lit(_FAR).cast("timestamp"))
    scanned = chunked_scan(
        versions.select(*FACT, "id", "version", "valid_from", "valid_until"), FACT, time_chunk(F.col("valid_from")),
        [F.col("valid_from"), F.col("version"), F.col("id")], max_before={"__ended": end}, hot_rows=hot_rows,
    )
    return _flag(scanned.where(F.col("__ended") > F.col("valid_from")), "overlapping_validity", "organization_id", "id")


def version_numbering(versions: DataFrame) -> DataFrame:
    """Numbers from 1, unique per fact; only the first supersedes nothing; each is superseded once,
    within its fact."""
    org_id = ["organization_id", "id"]
    parts = [
        _flag(versions.where(_broken(F.col("version") >= 1)), "version_below_1", *org_id),
        _flag(
            versions.groupBy(*FACT, "version").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
            "duplicate_version", *FACT, "version",
        ),
        _flag(
            versions.where((F.col("version") == 1) != F.col("supersedes_id").isNull()), "supersedes_missing_or_extra", *org_id
        ),
        _flag(
            versions.where(F.col("supersedes_id").isNotNull())
            .groupBy("organization_id", "supersedes_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
            "superseded_twice", "organization_id", "supersedes_id",
        ),
    ]
    target = versions.select(*FACT, F.col("id").alias("supersedes_id"))
    parts.append(
        _flag(
            versions.where(F.col("supersedes_id").isNotNull()).join(target, [*FACT, "supersedes_id"], "left_anti"),
            "supersedes_other_fact", *org_id,
        )
    )
    return _all(parts)


def version_values(versions: DataFrame) -> DataFrame:
    """Row rules of one version."""
    rules = {
        "empty_window": F.col("valid_until").isNull() | (F.col("valid_until") > F.col("valid_from")),
        "end_without_recording": F.col("valid_until").isNull() == F.col("valid_until_recorded_at").isNull(),
        "authority_out_of_range": F.col("authority").between(0, 100),
        "confidence_out_of_range": F.col("confidence").between(0, 1),
        "unknown_scope": F.col("privacy_scope").isin(*PRIVACY_ORDER),
        "bad_value": sc.fact_value_ok(sc.canonical_json(F.col("value"))),
    }
    return row_rules(versions, rules, "organization_id", "id")


def row_rules(df: DataFrame, rules: dict[str, Column], *key: str) -> DataFrame:
    """One scan for any number of row rules."""
    failed = F.array_compact(F.array(*[F.when(_broken(ok), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.explode(failed).alias("rule"), _key(*key).alias("key"))


def tenant_closure(child: DataFrame, column: str, parent: DataFrame, rule: str, *key: str, parent_id: str = "id") -> DataFrame:
    """References that do not resolve inside the same tenant."""
    p = parent.select("organization_id", F.col(parent_id).alias(column))
    return _flag(
        child.where(F.col(column).isNotNull()).join(p, ["organization_id", column], "left_anti"), rule, *(key or ("organization_id", column))
    )


def cites_outside_snapshot(decision_facts: DataFrame, snapshot_facts: DataFrame) -> DataFrame:
    on = ["organization_id", "snapshot_id", "fact_version_id"]
    return _flag(
        decision_facts.join(snapshot_facts, on, "left_anti"), "cites_outside_snapshot", "organization_id", "decision_id", "fact_version_id"
    )


def evidence_rules(evidence: DataFrame) -> DataFrame:
    rows = row_rules(
        evidence,
        {
            "unknown_evidence_type": F.col("evidence_type").isin(*EVIDENCE_TYPES),
            "excerpt_length": F.length("excerpt").between(1, sc.EXCERPT_MAX),
            "bad_content_hash": F.col("content_sha256").rlike(sc.SHA256_PATTERN),
            "metadata_not_an_object": sc.canonical_json(F.col("metadata")).startswith("{"),
        },
        "organization_id", "id",
    )
    content = ["organization_id", "source_id", "content_sha256"]
    twice = evidence.groupBy(*content).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.unionByName(_flag(twice, "duplicate_content", *content))


def embedding_rules(embeddings: DataFrame, dims: int) -> DataFrame:
    rows = row_rules(
        embeddings,
        {
            "bad_content_hash": F.col("content_sha256").rlike(sc.SHA256_PATTERN),
            "wrong_dimension": F.size("embedding") == dims,
        },
        "organization_id", "fact_version_id", "model",
    )
    key = ["fact_version_id", "model"]
    twice = embeddings.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.unionByName(_flag(twice, "duplicate_embedding", *key))


def contradiction_rules(contradictions: DataFrame) -> DataFrame:
    rows = row_rules(
        contradictions,
        {
            "same_version_twice": F.col("left_version_id") != F.col("right_version_id"),
            "unknown_kind": F.col("kind").isin(*CONTRADICTION_KINDS),
            "unknown_status": F.col("status").isin(*CONTRADICTION_STATUSES),
            "open_and_resolved": (F.col("status") == "open") == F.col("resolved_at").isNull(),
        },
        "organization_id", "id",
    )
    pair = ["organization_id", "left_version_id", "right_version_id"]
    twice = contradictions.groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.unionByName(_flag(twice, "duplicate_pair", *pair))


def revocation_rules(revocations: DataFrame, impacts: DataFrame, snapshot_facts: DataFrame) -> DataFrame:
    version = ["organization_id", "fact_version_id"]
    twice = revocations.groupBy(*version).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blank = revocations.where(_broken(F.length(sc.strip(F.col("reason"))) > 0))
    unseen = impacts.join(snapshot_facts, ["organization_id", "snapshot_id", "fact_version_id"], "left_anti")
    return _all(
        [
            _flag(twice, "revoked_twice", *version),
            _flag(blank, "blank_reason", *version),
            _flag(unseen, "impact_not_in_context", "organization_id", "decision_id", "fact_version_id"),
        ]
    )


def snapshot_rules(snapshots: DataFrame, snapshot_facts: DataFrame) -> DataFrame:
    place = ["organization_id", "snapshot_id", "position"]
    twice = snapshot_facts.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _all(
        [
            _flag(snapshot_facts.where(_broken(F.col("position") >= 1)), "position_below_1", *place),
            _flag(twice, "duplicate_position", *place),
            row_rules(
                snapshots, {"unknown_vector_search": F.col("vector_search").isin("used", "unavailable")}, "organization_id", "id"
            ),
        ]
    )


def append_only(before: DataFrame, after: DataFrame) -> DataFrame:
    """Between two copies no version changed, except by closing an open end once; none vanished."""
    closing = ("valid_until", "valid_until_recorded_at")
    fixed = [c for c in before.columns if c not in (*closing, "organization_id", "id")]
    old = before.select("organization_id", "id", F.struct(*fixed).alias("__old"), *[F.col(c).alias(f"__old_{c}") for c in closing])
    new = after.select("organization_id", "id", F.struct(*fixed).alias("__new"), *[F.col(c).alias(f"__new_{c}") for c in closing])
    both = old.join(new, ["organization_id", "id"], "full_outer")
    vanished = F.col("__new").isNull()
    was_open = F.col("__old_valid_until").isNull()
    end_moved = ~F.col("__old_valid_until").eqNullSafe(F.col("__new_valid_until")) | ~F.col(
        "__old_valid_until_recorded_at"
    ).eqNullSafe(F.col("__new_valid_until_recorded_at"))
    rule = F.when(vanished, "version_vanished").when(
        ~F.col("__old").eqNullSafe(F.col("__new")), "version_changed"
    ).when(end_moved & ~was_open, "end_changed_twice")
    return (
        both.where(F.col("__old").isNotNull())
        .withColumn("rule", rule)
        .where(F.col("rule").isNotNull())
        .select("rule", _key("organization_id", "id").alias("key"))
    )


def tenants_without_admin(memberships: DataFrame) -> DataFrame:
    counts = memberships.groupBy("organization_id").agg(F.count_if(F.col("role") == "ADMIN").alias("admins"))
    return _flag(counts.where("admins = 0"), "no_admin", "organization_id")


#: Every reference between ledger tables: child, its column, parent (by ``id``), the rule it breaks, and the key to report.
REFERENCES = (
    ("versions", "source_id", "sources", "unknown_source", ("organization_id", "id")),
    ("versions", "supersedes_id", "versions", "supersedes_unknown_version", ("organization_id", "id")),
    ("evidence", "source_id", "sources", "evidence_of_unknown_source", ("organization_id", "id")),
    ("links", "fact_version_id", "versions", "link_to_unknown_version", ()),
    ("links", "evidence_id", "evidence", "link_to_unknown_evidence", ()),
    ("embeddings", "fact_version_id", "versions", "embedding_of_unknown_version", ()),
    ("snapshot_facts", "fact_version_id", "versions", "snapshot_of_unknown_version", ()),
    ("snapshot_facts", "snapshot_id", "snapshots", "fact_of_unknown_snapshot", ()),
    ("decisions", "snapshot_id", "snapshots", "decision_on_unknown_snapshot", ("organization_id", "id")),
    ("decision_facts", "decision_id", "decisions", "citation_of_unknown_decision", ()),
    ("decision_facts", "fact_version_id", "versions", "citation_of_unknown_version", ()),
    ("revocations", "fact_version_id", "versions", "revocation_of_unknown_version", ("organization_id", "id")),
    ("impacts", "revocation_id", "revocations", "impact_of_unknown_revocation", ()),
    ("impacts", "decision_id", "decisions", "impact_on_unknown_decision", ()),
    ("contradictions", "left_version_id", "versions", "contradiction_of_unknown_version", ("organization_id", "id")),
    ("contradictions", "right_version_id", "versions", "contradiction_of_unknown_version", ("organization_id", "id")),
    ("contradictions", "preferred_version_id", "versions", "contradiction_of_unknown_version", ("organization_id", "id")),
)


def closed_references(tables: dict[str, DataFrame]) -> list[DataFrame]:
    """References that leave the tenant or lead nowhere, of all tables that are given with their parents."""
    return [
        tenant_closure(tables[child], column, tables[parent], rule, *key)
        for child, column, parent, rule, key in REFERENCES
        if tables.get(child) is not None and tables.get(parent) is not None and column in tables[child].columns
    ]


def audit(tables: dict[str, DataFrame], *, dims: int | None = None) -> DataFrame:
    """Every audit that applies to the given ledger tables."""
    t = tables.get
    v = tables["versions"]
    parts = [overlapping_validity(v), version_numbering(v), version_values(v), *closed_references(tables)]
    if t("evidence") is not None:
        parts.append(evidence_rules(t("evidence")))
    if t("snapshot_facts") is not None:
        if t("snapshots") is not None:
            parts.append(snapshot_rules(t("snapshots"), t("snapshot_facts")))
        if t("decision_facts") is not None:
            parts.append(cites_outside_snapshot(t("decision_facts"), t("snapshot_facts")))
        if t("revocations") is not None and t("impacts") is not None:
            parts.append(revocation_rules(t("revocations"), t("impacts"), t("snapshot_facts")))
    if t("embeddings") is not None and dims is not None:
        parts.append(embedding_rules(t("embeddings"), dims))
    if t("contradictions") is not None:
        parts.append(contradiction_rules(t("contradictions")))
    if t("memberships") is not None:
        parts.append(tenants_without_admin(t("memberships")))
    return _all(parts)
