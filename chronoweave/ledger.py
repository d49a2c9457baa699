"""The ledger: one DataFrame per table, with explicit schemas."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TS = "timestamp"

# The columns of each ledger table.
SCHEMAS = {
    "versions": (
        "organization_id string, id string, fact_id string, entity_type string, external_id string, "
        "property string, version int, value string, source_id string, valid_from timestamp, "
        "valid_until timestamp, observed_at timestamp, recorded_at timestamp, "
        "valid_until_recorded_at timestamp, supersedes_id string, authority int, "
        "confidence decimal(4,3), privacy_scope string"
    ),
    "sources": "organization_id string, id string, name string, source_type string, uri string, default_authority int",
    "revocations": (
        "organization_id string, id string, fact_version_id string, reason string, "
        "revoked_by_user_id string, revoked_at timestamp"
    ),
    "evidence": (
        "organization_id string, id string, source_id string, evidence_type string, excerpt string, "
        "content_sha256 string, uri string, metadata string, privacy_scope string, captured_at timestamp, "
        "recorded_at timestamp"
    ),
    "links": (
        "organization_id string, evidence_id string, fact_version_id string, relation string, linked_at timestamp"
    ),
    "embeddings": (
        "organization_id string, fact_version_id string, model string, content_sha256 string, "
        "embedding array<float>, created_at timestamp"
    ),
    "snapshots": (
        "organization_id string, id string, captured_by_user_id string, query string, valid_at timestamp, "
        "known_at timestamp, embedding_model string, vector_search string, privacy_scopes array<string>, "
        "parameters string, created_at timestamp"
    ),
    "snapshot_facts": (
        "organization_id string, snapshot_id string, fact_version_id string, position int, "
        "ranking struct<score:double,rrf_score:double,trust:double,vector_rank:int,vector_distance:double,"
        "text_rank:int,text_score:double>"
    ),
    "decisions": (
        "organization_id string, id string, snapshot_id string, decided_by_user_id string, agent string, "
        "action string, outcome string, rationale string, decided_at timestamp, receipt_sha256 string"
    ),
    "decision_facts": "organization_id string, decision_id string, snapshot_id string, fact_version_id string",
    "contradictions": (
        "organization_id string, id string, entity_type string, external_id string, left_version_id string, "
        "right_version_id string, kind string, detector string, explanation string, "
        "preferred_version_id string, privacy_scope string, status string, detected_at timestamp, "
        "resolved_at timestamp, resolved_by_user_id string, resolution_note string"
    ),
    "impacts": (
        "organization_id string, revocation_id string, decision_id string, snapshot_id string, "
        "fact_version_id string, relied_on boolean"
    ),
    "memberships": "organization_id string, user_id string, role string, is_active boolean",
}


@dataclass
class Ledger:
    """Tables by name; a table a job does not need may be None."""

    versions: DataFrame
    sources: DataFrame | None = None
    revocations: DataFrame | None = None
    evidence: DataFrame | None = None
    links: DataFrame | None = None
    embeddings: DataFrame | None = None
    snapshots: DataFrame | None = None
    snapshot_facts: DataFrame | None = None
    decisions: DataFrame | None = None
    decision_facts: DataFrame | None = None
    contradictions: DataFrame | None = None
    impacts: DataFrame | None = None
    memberships: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None}


ORG_BUCKETS = 64


def org_bucket(organization_id: Column | None = None, buckets: int = ORG_BUCKETS) -> Column:
    """The bucket a tenant's rows are stored in."""
    return F.pmod(F.xxhash64(F.col("organization_id") if organization_id is None else organization_id), F.lit(buckets)).cast("int")


def tenant_scoped(ledger: Ledger, organization_ids, *, buckets: int = ORG_BUCKETS) -> Ledger:
    """Restrict every table to the given tenants.

    Of tables stored by tenant bucket only the folders of these tenants are read: their buckets are
    constants to the optimiser.
    """
    ids = list(organization_ids)

    def restrict(t: DataFrame) -> DataFrame:
        mine = F.col("organization_id").isin(ids)
        if "org_bucket" in t.columns and ids:
            kind = t.schema["organization_id"].dataType
            own = [F.col("org_bucket") == org_bucket(F.lit(i).cast(kind), buckets) for i in ids]
            mine = reduce(lambda a, b: a | b, own) & mine
        return t.where(mine)

    return Ledger(**{n: restrict(t) for n, t in ledger.tables().items()})


def with_closures(base: DataFrame, closures: DataFrame) -> DataFrame:
    """Logical versions: the append-only base left-joined with the append-only closings.

    The first closing of a version wins, so replaying a closing changes nothing.
    """
    first = closures.groupBy("organization_id", "fact_version_id").agg(
        F.min(F.struct("recorded_at", "valid_until")).alias("__c")
    )
    joined = base.join(
        first,
        (base.organization_id == first.organization_id) & (base.id == first.fact_version_id),
        "left",
    )
    closed = base.valid_until.isNull() & F.col("__c").isNotNull()
    values = {
        "valid_until": F.when(closed, F.col("__c.valid_until")).otherwise(base.valid_until),
        "valid_until_recorded_at": F.when(closed, F.col("__c.recorded_at")).otherwise(
            base.valid_until_recorded_at
        ),
    }
    return joined.select(*[values[c].alias(c) if c in values else base[c] for c in base.columns])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])
