"""Provenance of versions and the graph of what depends on what, as node and edge tables.

Nodes and edges hold ids, times, scopes and hashes only, never values or excerpts. Impact
questions are joins over the edges; results stay rows, so a source behind a third of all versions
is no group that one task would have to hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import scalars as sc
from chronoweave.functions.privacy import visible
from chronoweave.operators.access import redact
from chronoweave.operators.temporal import FACT

# Node labels and edge types.
LABELS = ("Entity", "Fact", "FactVersion", "Source", "Evidence", "Snapshot", "Decision")
EDGE_TYPES = (
    "OF_ENTITY", "VERSION_OF", "ASSERTED_BY", "SUPERSEDES", "FROM_SOURCE", "EVIDENCE_FOR", "INCLUDED", "BASED_ON",
    "RELIED_ON",
)


# --- provenance of one version -------------------------------------------------------------------


def provenance(versions: DataFrame, sources: DataFrame, links: DataFrame, evidence: DataFrame, ceiling: str) -> tuple[DataFrame, DataFrame]:
    """Each visible version with its source and how much evidence was withheld; and the evidence rows.

    Order of evidence for display: linked_at, captured_at, evidence_id.
    """
    s = sources.select("organization_id", F.col("id").alias("source_id"), F.col("name").alias("source_name"), "source_type")
    e = evidence.select(
        "organization_id", F.col("id").alias("evidence_id"), "evidence_type", "content_sha256", "uri", "captured_at",
        F.col("source_id").alias("evidence_source_id"), F.col("privacy_scope").alias("evidence_scope"),
    )
    rows = links.join(e, ["organization_id", "evidence_id"])
    seen = visible("evidence_scope", ceiling)
    counts = rows.groupBy("organization_id", "fact_version_id").agg(
        F.count_if(seen).alias("evidence_shown"), F.count_if(~seen).alias("withheld_evidence")
    )
    v = versions.where(visible("privacy_scope", ceiling)).join(s, ["organization_id", "source_id"], "left")
    head = v.join(
        counts.withColumnRenamed("fact_version_id", "id"), ["organization_id", "id"], "left"
    ).fillna(0, subset=["evidence_shown", "withheld_evidence"])
    shown = rows.where(seen).join(
        v.select("organization_id", F.col("id").alias("fact_version_id")), ["organization_id", "fact_version_id"], "left_semi"
    )
    return head, shown


def list_sources(sources: DataFrame) -> DataFrame:
    """Per tenant by name."""
    return sources.orderBy("organization_id", "name")


# --- graph projection ------------------------------------------------------------------------------


def entity_id(org: str = "organization_id", kind: str = "entity_type", ext: str = "external_id") -> Column:
    return F.concat_ws("/", F.col(kind), F.col(ext))


def _node(df: DataFrame, label: str, node_id: Column, attributes: dict[str, Column]) -> DataFrame:
    pairs = [p for name, c in attributes.items() for p in (F.lit(name), c.cast("string"))]
    attrs = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map()
    return df.select(
        F.lit(label).alias("label"), node_id.cast("string").alias("id"), F.col("organization_id").cast("string").alias("org"),
        attrs.cast("map<string,string>").alias("attributes"), F.lit(False).alias("placeholder"),
    )


def graph_nodes(tables: dict[str, DataFrame]) -> DataFrame:
    """Nodes of the ledger tables present (versions, sources, evidence, snapshots, decisions)."""
    c = F.col
    parts = []
    v = tables.get("versions")
    if v is not None:
        parts += [
            _node(
                v.select("organization_id", "entity_type", "external_id").distinct(), "Entity", entity_id(),
                {"entity_type": c("entity_type"), "external_id": c("external_id")},
            ),
            _node(
                v.select("organization_id", "fact_id", "property").distinct(), "Fact", c("fact_id"),
                {"property": c("property")},
            ),
            _node(
                v, "FactVersion", c("id"),
                {
                    "version": c("version"), "value_sha256": sc.value_sha256(sc.canonical_json(c("value"))),
                    "valid_from": sc.utc_iso(c("valid_from")), "valid_until": sc.utc_iso(c("valid_until")),
                    "recorded_at": sc.utc_iso(c("recorded_at")),
                    "valid_until_recorded_at": sc.utc_iso(c("valid_until_recorded_at")),
                    "authority": c("authority"), "confidence": c("confidence"), "privacy_scope": c("privacy_scope"),
                },
            ),
        ]
    if tables.get("sources") is not None:
        parts.append(
            _node(tables["sources"], "Source", c("id"),
                  {"name": c("name"), "source_type": c("source_type"), "default_authority": c("default_authority")})
        )
    if tables.get("evidence") is not None:
        parts.append(
            _node(tables["evidence"], "Evidence", c("id"),
                  {"evidence_type": c("evidence_type"), "content_sha256": c("content_sha256"), "uri": c("uri"),
                   "privacy_scope": c("privacy_scope"), "captured_at": sc.utc_iso(c("captured_at"))})
        )
    if tables.get("snapshots") is not None:
        parts.append(
            _node(tables["snapshots"], "Snapshot", c("id"),
                  {"valid_at": sc.utc_iso(c("valid_at")), "known_at": sc.utc_iso(c("known_at")),
                   "captured_by_user_id": c("captured_by_user_id")})
        )
    if tables.get("decisions") is not None:
        parts.append(
            _node(tables["decisions"], "Decision", c("id"),
                  {"action": c("action"), "agent": c("agent"), "decided_at": sc.utc_iso(c("decided_at")),
                   "decided_by_user_id": c("decided_by_user_id"), "receipt_sha256": c("receipt_sha256")})
        )
    return _union(parts)


def _edge(df: DataFrame, kind: str, src: tuple[str, Column], dst: tuple[str, Column], attributes: dict[str, Column] | None = None) -> DataFrame:
    pairs = [p for name, c in (attributes or {}).items() for p in (F.lit(name), c.cast("string"))]
    attrs = F.create_map(*pairs) if pairs else F.create_map()
    return df.select(
        F.lit(kind).alias("type"), F.col("organization_id").cast("string").alias("org"),
        F.lit(src[0]).alias("src_label"), src[1].cast("string").alias("src"),
        F.lit(dst[0]).alias("dst_label"), dst[1].cast("string").alias("dst"),
        attrs.cast("map<string,string>").alias("attributes"),
    )


def graph_edges(tables: dict[str, DataFrame]) -> DataFrame:
    """The nine kinds of edges of the ledger tables present."""
    c = F.col
    parts = []
    v = tables.get("versions")
    if v is not None:
        facts = v.select("organization_id", "fact_id", "entity_type", "external_id").distinct()
        parts += [
            _edge(facts, "OF_ENTITY", ("Fact", c("fact_id")), ("Entity", entity_id())),
            _edge(v, "VERSION_OF", ("FactVersion", c("id")), ("Fact", c("fact_id"))),
            _edge(v, "ASSERTED_BY", ("FactVersion", c("id")), ("Source", c("source_id"))),
            _edge(v.where(c("supersedes_id").isNotNull()), "SUPERSEDES", ("FactVersion", c("id")), ("FactVersion", c("supersedes_id"))),
        ]
    if tables.get("evidence") is not None:
        parts.append(_edge(tables["evidence"], "FROM_SOURCE", ("Evidence", c("id")), ("Source", c("source_id"))))
    if tables.get("links") is not None:
        parts.append(
            _edge(tables["links"], "EVIDENCE_FOR", ("Evidence", c("evidence_id")), ("FactVersion", c("fact_version_id")),
                  {"relation": c("relation"), "linked_at": sc.utc_iso(c("linked_at"))})
        )
    if tables.get("snapshot_facts") is not None:
        parts.append(
            _edge(tables["snapshot_facts"], "INCLUDED", ("Snapshot", c("snapshot_id")), ("FactVersion", c("fact_version_id")),
                  {"position": c("position")})
        )
    if tables.get("decisions") is not None:
        parts.append(_edge(tables["decisions"], "BASED_ON", ("Decision", c("id")), ("Snapshot", c("snapshot_id"))))
    if tables.get("decision_facts") is not None:
        parts.append(
            _edge(tables["decision_facts"], "RELIED_ON", ("Decision", c("decision_id")), ("FactVersion", c("fact_version_id")))
        )
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Add an empty node for every edge end that is not projected yet.

    A node projected later replaces its placeholder, and applying the same rows twice changes
    nothing, because a key keeps one row and real rows win.
    """
    ends = edges.select(F.col("src_label").alias("label"), F.col("src").alias("id"), "org").unionByName(
        edges.select(F.col("dst_label").alias("label"), F.col("dst").alias("id"), "org")
    ).distinct()
    real = nodes.where(~F.col("placeholder")).dropDuplicates(["label", "org", "id"])
    missing = ends.join(real, ["label", "org", "id"], "left_anti").select(
        "label", "id", "org", F.create_map().cast("map<string,string>").alias("attributes"), F.lit(True).alias("placeholder")
    )
    return real.unionByName(missing)


def project_changes(changes: DataFrame, tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The current rows behind a change log ``table_name, organization_id, key`` (map of key columns).

    Repeated changes of a row collapse, then each table is read once through a semi-join.
    """
    out = {}
    for name, columns in keys.items():
        if tables.get(name) is None:
            continue
        t = tables[name]
        wanted = (
            changes.where(F.col("table_name") == name)
            .select(
                F.col("organization_id").cast(t.schema["organization_id"].dataType).alias("organization_id"),
                *[F.col("key")[c].cast(t.schema[c].dataType).alias(c) for c in columns],
            )
            .distinct()
        )
        out[name] = t.join(wanted, ["organization_id", *columns], "left_semi")
    return out


def exists(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked (label, org, id) rows that are known nodes."""
    return asked.join(nodes.select("label", "org", "id"), ["label", "org", "id"], "left_semi")


def pending(changes: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Per tenant how many changes are not processed yet; keys are unique within a tenant."""
    return (
        changes.join(done.select("organization_id", key), ["organization_id", key], "left_anti")
        .groupBy("organization_id")
        .agg(F.count(F.lit(1)).alias("pending_events"))
    )


# --- impact ------------------------------------------------------------------------------------------


def _decision_refs(decisions: DataFrame) -> DataFrame:
    return decisions.select("organization_id", F.col("id").alias("decision_id"), "snapshot_id", "action", "decided_at")


def impact_of_version(version_ids: DataFrame, decisions: DataFrame, snapshot_facts: DataFrame, decision_facts: DataFrame) -> DataFrame:
    """Decisions that relied on each version, or only had it in their context.

    Relying counts by itself: a version relied on without a row in the context is reported too.
    """
    asked = version_ids.select("organization_id", F.col("id").alias("fact_version_id")).distinct()
    refs = _decision_refs(decisions)
    held = (
        snapshot_facts.select("organization_id", "snapshot_id", "fact_version_id")
        .join(asked, ["organization_id", "fact_version_id"], "left_semi")
        .join(refs, ["organization_id", "snapshot_id"])
        .select(*refs.columns, "fact_version_id", F.lit(False).alias("__r"))
    )
    relied = (
        decision_facts.select("organization_id", "decision_id", "fact_version_id")
        .join(asked, ["organization_id", "fact_version_id"], "left_semi")
        .join(refs, ["organization_id", "decision_id"])
        .select(*refs.columns, "fact_version_id", F.lit(True).alias("__r"))
    )
    return (
        held.unionByName(relied)
        .groupBy("organization_id", "fact_version_id", "decision_id", "action", "decided_at")
        .agg(F.when(F.max("__r"), "relied_on").otherwise("in_context").alias("via"))
        .select("organization_id", "fact_version_id", "via", "decision_id", "action", "decided_at")
    )


def superseded_range(versions: DataFrame, version_ids: DataFrame) -> DataFrame:
    """``first_later..last_later``: the numbers of the versions that replaced each asked one, one row each.

    A chain is linear, so these are all the higher numbers; versions that nothing replaced are left out.
    """
    asked = version_ids.select("organization_id", F.col("id").alias("subject_id")).distinct()
    subject = versions.select("organization_id", F.col("id").alias("subject_id"), "fact_id", F.col("version").alias("__v")).join(
        asked, ["organization_id", "subject_id"], "left_semi"
    )
    last = versions.groupBy(*FACT).agg(F.max("version").alias("last_later"))
    return subject.join(last, FACT).where(F.col("last_later") > F.col("__v")).select(
        "organization_id", "subject_id", "fact_id", (F.col("__v") + 1).alias("first_later"), "last_later"
    )


def superseded_by(versions: DataFrame, version_ids: DataFrame) -> DataFrame:
    """The rows behind :func:`superseded_range`, one per asked and later version; ask for few versions of one fact."""
    spans = superseded_range(versions, version_ids)
    later = versions.select(*FACT, F.col("version").alias("later_version"), F.col("id").alias("later_id"))
    return spans.join(later, FACT).where(F.col("later_version") >= F.col("first_later")).select(
        "organization_id", "subject_id", "fact_id", "later_id", "later_version"
    )


def versions_behind_source(source_ids: DataFrame, versions: DataFrame, links: DataFrame, evidence: DataFrame) -> DataFrame:
    """(source, version, via): asserted by the source, or supported by evidence from it."""
    asked = source_ids.select("organization_id", F.col("id").alias("source_id"))
    asserted = versions.select("organization_id", "source_id", F.col("id").alias("fact_version_id")).join(
        asked, ["organization_id", "source_id"], "left_semi"
    )
    e = evidence.select("organization_id", F.col("id").alias("evidence_id"), "source_id").join(
        asked, ["organization_id", "source_id"], "left_semi"
    )
    known = versions.select("organization_id", F.col("id").alias("fact_version_id"))
    supported = (
        links.where(F.col("relation") == "SUPPORTS")
        .join(e, ["organization_id", "evidence_id"])
        .select("organization_id", "source_id", "fact_version_id")
        .distinct()
        .join(known, ["organization_id", "fact_version_id"], "left_semi")
    )
    return asserted.withColumn("via", F.lit("asserted_by_source")).unionByName(
        supported.withColumn("via", F.lit("supported_by_source_evidence"))
    )


def _relying(affected: DataFrame, decisions: DataFrame, decision_facts: DataFrame) -> DataFrame:
    """Add the relying decisions; a version nothing relies on keeps one row with null.

    An inner join plus the versions without a match, instead of an outer join: a version that very
    many decisions relied on can then be split from either side.
    """
    d = decision_facts.select("organization_id", "decision_id", "fact_version_id").join(
        _decision_refs(decisions).drop("snapshot_id"), ["organization_id", "decision_id"]
    )
    on = ["organization_id", "fact_version_id"]
    used = affected.join(d, on)
    unused = affected.join(d.select(*on).distinct(), on, "left_anti")
    return used.unionByName(unused, allowMissingColumns=True)


def impact_of_source(source_ids, versions, links, evidence, decisions, decision_facts) -> DataFrame:
    """(source, version, via, decision): what depends on a source; decision is null for unused versions."""
    return _relying(versions_behind_source(source_ids, versions, links, evidence), decisions, decision_facts)


def impact_of_evidence(evidence_ids, versions, links, decisions, decision_facts) -> DataFrame:
    """(evidence, version, via, decision): via is the relation of the link, lower-cased."""
    asked = evidence_ids.select("organization_id", F.col("id").alias("evidence_id"))
    known = versions.select("organization_id", F.col("id").alias("fact_version_id"))
    affected = (
        links.join(asked, ["organization_id", "evidence_id"], "left_semi")
        .join(known, ["organization_id", "fact_version_id"], "left_semi")
        .select("organization_id", "evidence_id", "fact_version_id", F.lower("relation").alias("via"))
    )
    return _relying(affected, decisions, decision_facts)


def group_impact(rows: DataFrame, subject: str) -> tuple[DataFrame, DataFrame]:
    """Distinct affected versions per subject, and distinct (decision, version, via) reasons.

    Both stay rows. Order for display: decided_at (null last), decision, version, via.
    """
    versions = rows.select("organization_id", subject, "fact_version_id").distinct()
    reasons = (
        rows.where(F.col("decision_id").isNotNull())
        .select("organization_id", subject, "decision_id", "action", "decided_at", "fact_version_id", "via")
        .distinct()
    )
    return versions, reasons


def impact_summary(rows: DataFrame, subject: str) -> DataFrame:
    """Per subject: affected versions and decisions, counted through partial aggregates."""
    versions, reasons = group_impact(rows, subject)
    v = versions.groupBy("organization_id", subject).agg(F.count(F.lit(1)).alias("affected_versions"))
    d = (
        reasons.select("organization_id", subject, "decision_id")
        .distinct()
        .groupBy("organization_id", subject)
        .agg(F.count(F.lit(1)).alias("affected_decisions"))
    )
    return v.join(d, ["organization_id", subject], "left").fillna(0, subset=["affected_decisions"])


def decision_lineage(
    decision_ids: DataFrame, decision_facts: DataFrame, versions: DataFrame, sources: DataFrame, ceiling: str
) -> DataFrame:
    """Per decision the relied-on versions with entity, property and source; redacted above the ceiling."""
    asked = decision_ids.select("organization_id", F.col("id").alias("decision_id"))
    s = sources.select("organization_id", F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    v = versions.select(
        "organization_id", F.col("id").alias("fact_version_id"), "privacy_scope", "entity_type", "external_id", "property", "source_id"
    ).join(s, ["organization_id", "source_id"])
    steps = (
        decision_facts.select("organization_id", "decision_id", "fact_version_id")
        .join(asked, ["organization_id", "decision_id"], "left_semi")
        .join(v, ["organization_id", "fact_version_id"])
    )
    return redact(steps, ceiling, ["entity_type", "external_id", "property", "source_id", "source_name"])


def lineage_evidence(steps: DataFrame, links: DataFrame, evidence: DataFrame) -> DataFrame:
    """The evidence behind each visible step of a decision's lineage, with its own source."""
    e = evidence.select("organization_id", F.col("id").alias("evidence_id"), F.col("source_id").alias("evidence_source_id"))
    return (
        steps.where(~F.col("redacted"))
        .select("organization_id", "decision_id", "fact_version_id")
        .join(links.select("organization_id", "fact_version_id", "evidence_id", "relation"), ["organization_id", "fact_version_id"])
        .join(e, ["organization_id", "evidence_id"], "left")
    )
