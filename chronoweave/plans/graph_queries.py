"""Registered queries: decisions and receipts, provenance, impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.operators import decisions as dr, provenance as pg
from chronoweave.operators.temporal import latest_versions
from chronoweave.plans import fixtures as fx
from chronoweave.plans.common import (
    dec, evidence, flat, led, links, ordinal, relied, revs, snap, snapshots, sql, src, stored, t,
)

# --- decisions -----------------------------------------------------------------------------------


def _receipts(s, d):
    return dr.receipt_sha256(dec(s, d), snapshots(s, d), snap(s, d), relied(s, d), led(s, d))


def _iso(c):
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"


_RECEIPTS = f"""
with lines as (
 select s.snapshot_id, string_agg('{{"fact_version_id":"' || s.fact_version_id || '","position":' || s.position || ',"relied_on":' ||
   case when r.decision_id is null then 'false' else 'true' end || ',"value_sha256":"' || sha256(l.value) || '"}}', ',' order by s.position) as facts
 from snap s join led l on l.id = s.fact_version_id left join relied r on r.decision_id = s.snapshot_id and r.fact_version_id = s.fact_version_id
 group by 1),
doc as (
 select d.organization_id, d.id, '{{"context":{{"embedding_model":"fixture:64","known_at":"' || {_iso('d.decided_at')} ||
  '","privacy_scopes":["CONFIDENTIAL","INTERNAL","PUBLIC","RESTRICTED"],"query":"facts of user ' || d.user_id || '","snapshot_id":"' || d.id ||
  '","valid_at":"' || {_iso('d.decided_at')} || '","vector_search":"unavailable"}},"decision":{{"action":"order.approve","agent":null,"decided_at":"' ||
  {_iso('d.decided_at')} || '","decided_by_user_id":"' || d.decided_by_user_id || '","id":"' || d.id || '","outcome":' || d.outcome ||
  ',"rationale":null}},"facts":[' || coalesce(facts, '') || '],"organization_id":"' || d.organization_id || '","schema":"chronoweave.receipt.v1"}}' as body
 from dec d left join lines on lines.snapshot_id = d.snapshot_id)"""


def _sealed(s, d):
    """Decisions with their stored receipt; every seventh decision was tampered with after sealing."""
    sealed = stored(s, d, "sealed_decisions", lambda: dec(s, d).join(_receipts(s, d), ["organization_id", "id"]))
    return sealed.withColumn("action", F.when(F.col("id") % 7 == 0, "order.refuse").otherwise(F.col("action")))


def _verify(s, d):
    return dr.verify_receipts(_sealed(s, d), snapshots(s, d), snap(s, d), relied(s, d), led(s, d)).select("id", "integrity_verified")


def _receipt_facts(s, d):
    f = dr.receipt_facts(dec(s, d), snapshots(s, d), snap(s, d), relied(s, d), led(s, d), src(s, d), revs(s, d), "CONFIDENTIAL")
    return flat(f.select("decision_id", "position", "fact_version_id", "relied_on", "redacted", "property", "value", "source_name", "valid_until", "revoked_at"))


def _receipt_evidence(s, d):
    """Receipts of the cited evidence; documents name their own sources, registered by name."""
    f = dr.receipt_facts(dec(s, d), snapshots(s, d), snap(s, d), relied(s, d), led(s, d), src(s, d), None, "CONFIDENTIAL")
    names = evidence(s, d).select("organization_id", F.col("source_id").alias("id"), F.col("source_id").alias("name")).distinct()
    return dr.receipt_evidence(f, links(s, d), evidence(s, d), names, "CONFIDENTIAL").select(
        "decision_id", "fact_version_id", "evidence_id", "relation", "evidence_source", "content_sha256"
    )


def _requests(s, d):
    """Decision requests over the stored contexts, with faults of every kind."""
    i = F.col("id")
    facts = relied(s, d).groupBy("organization_id", F.col("decision_id").alias("id")).agg(
        F.sort_array(F.collect_list("fact_version_id")).alias("ids")  # at most two facts each
    )
    none = F.array().cast("array<bigint>")
    base = dec(s, d).join(facts, ["organization_id", "id"], "left").withColumn("ids", F.coalesce("ids", none))
    cite = (
        F.when((i % 7 == 0) & (F.size("ids") > 0), F.concat("ids", F.slice("ids", 1, 1)))
        .when(i % 11 == 0, F.concat("ids", F.array(F.lit(-1).cast("long"))))
        .when(i % 13 == 0, F.transform(F.sequence(F.lit(1), F.lit(51)), lambda x: x.cast("long")))
        .otherwise(F.col("ids"))
    )
    return base.select(
        "organization_id", "id", F.when(i % 17 == 0, F.lit(-5).cast("long")).otherwise(F.col("snapshot_id")).alias("snapshot_id"),
        "decided_by_user_id", F.when(i % 3 == 0, "  credit   agent ").alias("agent"),
        F.when(i % 19 == 0, "Not an action").otherwise(" Order.Approve ").alias("action"),
        F.when(i % 23 == 0, "null").otherwise(F.col("outcome")).alias("outcome"), F.when(i % 2 == 0, "  because  ").otherwise("  ").alias("rationale"),
        cite.alias("relied_on"), "decided_at",
    )


def _record(s, d):
    ok, _, bad = dr.record_decisions(_requests(s, d), snapshots(s, d), snap(s, d), led(s, d))
    cols = ["id", "action", "agent", "rationale"]
    return ok.select(*cols, F.lit(None).cast("string").alias("reason"), (F.length("receipt_sha256") == 64).alias("sealed")).unionByName(
        bad.select("id", *[F.lit(None).cast("string").alias(c) for c in cols[1:]], "reason", F.lit(False).alias("sealed"))
    )


_RECORD = """
with n as (select snapshot_id, count(*) as n from relied group by 1),
r as (select d.id, case when d.id % 19 = 0 then 'bad_action' when d.id % 23 = 0 then 'bad_outcome' when d.id % 17 = 0 then 'snapshot_not_found'
  when d.id % 7 = 0 and n.n > 0 then 'duplicate_relied_on' when d.id % 11 = 0 then 'relied_on_outside_snapshot' when d.id % 13 = 0 then 'too_many_relied_on' end as reason
 from dec d left join n on n.snapshot_id = d.id)
select id, reason, reason is null as sealed, case when reason is null then 'order.approve' end as action,
 case when reason is null and id % 3 = 0 then 'credit agent' end as agent, case when reason is null and id % 2 = 0 then 'because' end as rationale from r"""


def _relied_check(s, d):
    return dr.validate_relied_on(_requests(s, d).withColumn("snapshot_id", F.col("id")), snap(s, d)).select("id", "problem")


_RELIED_CHECK = """
with n as (select snapshot_id, count(*) as n from relied group by 1)
select d.id, case when d.id % 7 = 0 and n.n > 0 then 'duplicate_relied_on' when d.id % 11 = 0 then 'relied_on_outside_snapshot'
 when d.id % 13 = 0 then 'too_many_relied_on' end as problem from dec d left join n on n.snapshot_id = d.id"""


# --- graph -------------------------------------------------------------------------------------------


def _tables(s, d):
    return {
        "versions": led(s, d), "sources": src(s, d), "evidence": evidence(s, d), "links": links(s, d), "snapshots": snapshots(s, d),
        "snapshot_facts": snap(s, d), "decision_facts": relied(s, d),
        "decisions": dec(s, d).withColumn("receipt_sha256", F.lit(None).cast("string")),
    }


def _nodes(s, d):
    n = pg.graph_nodes(_tables(s, d))
    a = F.col("attributes")
    return n.select("label", "id", "org", a["version"].alias("version"), a["value_sha256"].alias("value_sha256"),
                    a["privacy_scope"].alias("privacy_scope"), a["content_sha256"].alias("content_sha256"), a["decided_at"].alias("decided_at"))


_N = "null, null, null, null, null"
_NODES = f"""
select 'Entity' as label, 'user/' || external_id as id, cast(organization_id as varchar) as org, null as version, null as value_sha256, null as privacy_scope,
  null as content_sha256, null as decided_at from (select distinct organization_id, external_id from led) e
union all select 'Fact', fact_id, cast(organization_id as varchar), {_N} from (select distinct organization_id, fact_id from led) f
union all select 'FactVersion', cast(id as varchar), cast(organization_id as varchar), cast(version as varchar), sha256(value), privacy_scope, null, null from led
union all select 'Source', cast(id as varchar), cast(organization_id as varchar), {_N} from src
union all select 'Evidence', cast(id as varchar), cast(organization_id as varchar), null, null, privacy_scope, content_sha256, null from evid
union all select 'Snapshot', cast(id as varchar), cast(organization_id as varchar), {_N} from dec
union all select 'Decision', cast(id as varchar), cast(organization_id as varchar), null, null, null, null, {_iso('decided_at')} from dec"""


def _edges(s, d):
    e = pg.graph_edges(_tables(s, d))
    a = F.col("attributes")
    return e.select("type", "org", "src_label", "src", "dst_label", "dst", a["relation"].alias("relation"), a["position"].alias("position"))


_V = lambda c: f"cast({c} as varchar)"
_EDGES = f"""
select 'OF_ENTITY' as type, {_V('organization_id')} as org, 'Fact' as src_label, fact_id as src, 'Entity' as dst_label, 'user/' || external_id as dst,
  null as relation, null as position from (select distinct organization_id, fact_id, external_id from led) f
union all select 'VERSION_OF', {_V('organization_id')}, 'FactVersion', {_V('id')}, 'Fact', fact_id, null, null from led
union all select 'ASSERTED_BY', {_V('organization_id')}, 'FactVersion', {_V('id')}, 'Source', {_V('source_id')}, null, null from led
union all select 'SUPERSEDES', {_V('organization_id')}, 'FactVersion', {_V('id')}, 'FactVersion', {_V('supersedes_id')}, null, null from led where supersedes_id is not null
union all select 'FROM_SOURCE', {_V('organization_id')}, 'Evidence', {_V('id')}, 'Source', {_V('source_id')}, null, null from evid
union all select 'EVIDENCE_FOR', {_V('organization_id')}, 'Evidence', {_V('evidence_id')}, 'FactVersion', {_V('fact_version_id')}, relation, null from links
union all select 'INCLUDED', {_V('organization_id')}, 'Snapshot', {_V('snapshot_id')}, 'FactVersion', {_V('fact_version_id')}, null, {_V('position')} from snap
union all select 'BASED_ON', {_V('organization_id')}, 'Decision', {_V('id')}, 'Snapshot', {_V('snapshot_id')}, null, null from dec
union all select 'RELIED_ON', {_V('organization_id')}, 'Decision', {_V('decision_id')}, 'FactVersion', {_V('fact_version_id')}, null, null from relied"""


def _placeholders(s, d):
    """A graph where only versions of two properties are projected yet, but every edge is."""
    tables = _tables(s, d)
    early = {"versions": tables["versions"].where("property in ('click', 'view')"), "decisions": tables["decisions"]}
    nodes = pg.graph_nodes(early)
    full = pg.with_placeholders(nodes.unionByName(nodes), pg.graph_edges(tables))
    return full.groupBy("label", "placeholder").agg(F.count(F.lit(1)).alias("nodes"))


_PLACEHOLDERS = f"""
with ends as (
 select distinct label, org, id from (
  select src_label as label, org, src as id from edges union all select dst_label, org, dst from edges) q),
real as (select 'FactVersion' as label, {_V('organization_id')} as org, {_V('id')} as id from led where property in ('click', 'view')
 union select 'Fact', {_V('organization_id')}, fact_id from led where property in ('click', 'view')
 union select 'Entity', {_V('organization_id')}, 'user/' || external_id from led where property in ('click', 'view')
 union select 'Decision', {_V('organization_id')}, {_V('id')} from dec)
select label, false as placeholder, count(*) as nodes from real group by 1
union all select label, true, count(*) from ends where not exists (from real r where r.label = ends.label and r.org = ends.org and r.id = ends.id) group by 1"""


def _changes(s, d):
    """A change log naming every version twice and every relied-on pair once."""
    v = led(s, d).select(F.lit("versions").alias("table_name"), "organization_id", F.create_map(F.lit("id"), F.col("id").cast("string")).alias("key"))
    r = relied(s, d).select(
        F.lit("decision_facts").alias("table_name"), "organization_id",
        F.create_map(F.lit("decision_id"), F.col("decision_id").cast("string"), F.lit("fact_version_id"), F.col("fact_version_id").cast("string")).alias("key"),
    )
    return v.unionByName(v).unionByName(r)


def _projected(s, d):
    rows = pg.project_changes(
        _changes(s, d), _tables(s, d), {"versions": ["id"], "decision_facts": ["decision_id", "fact_version_id"]}
    )
    parts = [df.groupBy("organization_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(n)) for n, df in rows.items()]
    return parts[0].unionByName(parts[1])


def _pending(s, d):
    """Versions published up to the middle of the month are done."""
    changes = led(s, d).select("organization_id", "id")
    done = led(s, d).where(F.col("recorded_at") <= F.lit("2024-01-15").cast("timestamp")).select("organization_id", "id")
    return pg.pending(changes, done)


def _exists(s, d):
    """Every version id asked for in its own and in the next tenant."""
    v = led(s, d)
    ask = v.select(F.lit("FactVersion").alias("label"), F.col("organization_id").cast("string").alias("org"), F.col("id").cast("string").alias("id"))
    other = v.select(F.lit("FactVersion").alias("label"), ((F.col("organization_id") + 1) % 4).cast("string").alias("org"), F.col("id").cast("string").alias("id"))
    found = pg.exists(pg.graph_nodes({"versions": v}), ask.unionByName(other))
    return found.groupBy("org").agg(F.count(F.lit(1)).alias("known"))


# --- impact ------------------------------------------------------------------------------------------

_ids = lambda df: df.select("organization_id", "id")


def _impact_version(s, d):
    return pg.impact_of_version(_ids(led(s, d)), dec(s, d), snap(s, d), relied(s, d)).select("fact_version_id", "via", "decision_id")


def _superseded(s, d):
    first = led(s, d).where("version = 1")
    return pg.superseded_by(led(s, d), _ids(first)).select("subject_id", "later_id", "later_version")


def _sources_of_both(s, d):
    """Documents' evidence counted for the ledger's sources: source n of a tenant speaks for src n."""
    return evidence(s, d).withColumn("source_id", (F.regexp_extract("source_id", "([0-9]+)", 1).cast("int") % 5).cast("long"))


def _impact_source(s, d):
    return pg.impact_of_source(_ids(src(s, d)), led(s, d), links(s, d), _sources_of_both(s, d), dec(s, d), relied(s, d))


_IMPACT_SOURCE = """
with ev as (select *, cast(regexp_extract(source_id, '([0-9]+)', 1) as int) % 5 as sid from evid),
av as (select organization_id, source_id, id as fact_version_id, 'asserted_by_source' as via from led
 union all select distinct l.organization_id, ev.sid, l.fact_version_id, 'supported_by_source_evidence' from links l
  join ev on ev.id = l.evidence_id and ev.organization_id = l.organization_id where l.relation = 'SUPPORTS'),
im as (select av.*, r.decision_id, d.decided_at from av left join relied r on r.fact_version_id = av.fact_version_id left join dec d on d.id = r.decision_id)"""


def _impact_evidence(s, d):
    return pg.impact_of_evidence(_ids(evidence(s, d)), led(s, d), links(s, d), dec(s, d), relied(s, d)).select(
        "evidence_id", "fact_version_id", "via", "decision_id"
    )


def _grouped(s, d):
    _, reasons = pg.group_impact(_impact_source(s, d), "source_id")
    return flat(reasons.select("organization_id", "source_id", "decision_id", "decided_at", "fact_version_id", "via"))


def _lineage(s, d):
    return pg.decision_lineage(_ids(dec(s, d)), relied(s, d), led(s, d), src(s, d), "INTERNAL")


def _lineage_evidence(s, d):
    return pg.lineage_evidence(_lineage(s, d), links(s, d), evidence(s, d)).select(
        "decision_id", "fact_version_id", "evidence_id", "relation", "evidence_source_id"
    )


def _provenance(s, d):
    head, _ = pg.provenance(led(s, d), src(s, d), links(s, d), evidence(s, d), "CONFIDENTIAL")
    return head.select("id", "source_name", "source_type", "evidence_shown", "withheld_evidence")


QUERIES = {
    "dr3_validate_relied_on": (_relied_check, sql(_RELIED_CHECK, "relied")),
    "dr4_record_decisions": (_record, sql(_RECORD, "relied")),
    "dr5_receipt_sha256": (
        lambda s, d: _receipts(s, d).select("id", "receipt_sha256"), sql(_RECEIPTS + "\nselect id, sha256(body) as receipt_sha256 from doc", "relied"),
    ),
    "dr6_receipt_facts": (
        _receipt_facts,
        sql(
            f"""select s.snapshot_id as decision_id, s.position, s.fact_version_id, s.relied_on, l.privacy_scope = 'RESTRICTED' as redacted,
 case when l.privacy_scope <> 'RESTRICTED' then l.property end as property, case when l.privacy_scope <> 'RESTRICTED' then l.value end as value,
 case when l.privacy_scope <> 'RESTRICTED' then 'source-' || l.source_id end as source_name,
 case when l.privacy_scope <> 'RESTRICTED' and l.valid_until_recorded_at <= d.decided_at then {t('l.valid_until')} end as valid_until,
 case when l.privacy_scope <> 'RESTRICTED' then {t('v.revoked_at')} end as revoked_at
 from snap s join led l on l.id = s.fact_version_id join dec d on d.id = s.snapshot_id left join revs v on v.fact_version_id = l.id""",
            "relied", "revs",
        ),
    ),
    "dr6_receipt_evidence": (
        _receipt_evidence,
        sql(
            """select s.snapshot_id as decision_id, s.fact_version_id, k.evidence_id, k.relation, e.source_id as evidence_source, e.content_sha256
 from snap s join led l on l.id = s.fact_version_id join dec d on d.id = s.snapshot_id join links k on k.fact_version_id = l.id join evid e on e.id = k.evidence_id
 where l.privacy_scope <> 'RESTRICTED' and e.privacy_scope <> 'RESTRICTED' and k.linked_at <= d.decided_at""", "relied", "links",
        ),
    ),
    "dr6_receipts": (
        lambda s, d: dr.receipts(_sealed(s, d), snapshots(s, d), snap(s, d), relied(s, d), led(s, d), src(s, d))[0].select(
            "organization_id", "id", "snapshot_id", "action", "query", "vector_search", "integrity_verified"
        ),
        sql("select organization_id, id, snapshot_id, case when id % 7 = 0 then 'order.refuse' else action end as action, 'facts of user ' || user_id as query, 'unavailable' as vector_search, id % 7 <> 0 as integrity_verified from dec", "dec"),
    ),
    "dr7_verify_receipts": (_verify, sql("select id, id % 7 <> 0 as integrity_verified from dec", "dec")),
    "dr8_decisions_relying_on": (
        lambda s, d: flat(dr.decisions_relying_on(dec(s, d), relied(s, d), revs(s, d).select("organization_id", "id"))
                          .select("fact_version_id", "decision_id", "decided_at")),
        sql(
            f"""select r.fact_version_id, r.decision_id, {t('d.decided_at')} as decided_at from relied r join revs v on v.fact_version_id = r.fact_version_id
 join dec d on d.id = r.decision_id""", "relied", "revs",
        ),
    ),
    "dr9_snapshot_rows": (
        lambda s, d: dr.snapshot_rows(snap(s, d), led(s, d), src(s, d)).select("snapshot_id", "position", "fact_version_id", "property", "external_id", "source_name"),
        sql(
            """select s.snapshot_id, s.position, s.fact_version_id, l.property, l.external_id, 'source-' || l.source_id as source_name
 from snap s join led l on l.id = s.fact_version_id""", "snap",
        ),
    ),
    "dr10_revocation_marks": (
        lambda s, d: flat(snap(s, d).join(revs(s, d), ["organization_id", "fact_version_id"]).select("snapshot_id", "fact_version_id", "revoked_at")),
        sql(f"select s.snapshot_id, s.fact_version_id, {t('r.revoked_at')} as revoked_at from snap s join revs r using (fact_version_id)", "snap"),
    ),
    "pg1_version_provenance": (
        _provenance,
        sql(
            f"""with c as (select k.fact_version_id, count(*) filter ({ordinal('e.privacy_scope')} <= 2) as shown, count(*) filter ({ordinal('e.privacy_scope')} > 2) as withheld
  from links k join evid e on e.id = k.evidence_id group by 1)
select l.id, 'source-' || l.source_id as source_name, (['SYSTEM_OF_RECORD','API','DOCUMENT','HUMAN','AGENT'])[l.source_id + 1] as source_type,
 coalesce(shown, 0) as evidence_shown, coalesce(withheld, 0) as withheld_evidence from led l left join c on c.fact_version_id = l.id where {ordinal('l.privacy_scope')} <= 2""",
            "led", "links",
        ),
    ),
    "pg2_list_sources": (
        lambda s, d: _source_use(s, d),
        sql("select s.organization_id, s.name, s.source_type, count(l.id) as versions from src s left join led l on l.organization_id = s.organization_id and l.source_id = s.id group by 1, 2, 3", "src", "led"),
    ),
    "pg3_graph_nodes": (_nodes, sql(_NODES, "led", "src", "evid", "dec")),
    "pg4_graph_edges": (_edges, sql(_EDGES, "relied", "links")),
    "pg5_placeholder_nodes": (
        _placeholders, sql(_PLACEHOLDERS.replace("with ends", f"with edges as ({_EDGES.strip()}),\nends"), "relied", "links"),
    ),
    "pg6_project_changes": (
        _projected,
        sql(
            """select organization_id, count(*) as rows, 'versions' as table_name from led group by 1
union all select organization_id, count(*), 'decision_facts' from relied group by 1""", "relied",
        ),
    ),
    "pg7_impact_of_versions": (
        _impact_version,
        sql(
            "select fact_version_id, case when relied_on then 'relied_on' else 'in_context' end as via, snapshot_id as decision_id from snap", "snap",
        ),
    ),
    "pg8_superseded_range": (
        lambda s, d: pg.superseded_range(led(s, d), _ids(led(s, d))).select("subject_id", "first_later", "last_later"),
        sql(
            """select id as subject_id, version + 1 as first_later, last as last_later
 from (select *, max(version) over (partition by fact_id) as last from led) where version < last""", "led",
        ),
    ),
    "pg8_superseded_by": (
        _superseded,
        sql(
            """select f.id as subject_id, l.id as later_id, l.version as later_version from led f join led l on l.fact_id = f.fact_id and l.version > 1 where f.version = 1""", "led",
        ),
    ),
    "pg9_impact_of_sources": (
        lambda s, d: _impact_source(s, d).select("organization_id", "source_id", "fact_version_id", "via", "decision_id"),
        sql(_IMPACT_SOURCE + "\nselect organization_id, source_id, fact_version_id, via, decision_id from im", "relied", "links"),
    ),
    "pg10_impact_of_evidence": (
        _impact_evidence,
        sql("select k.evidence_id, k.fact_version_id, lower(k.relation) as via, r.decision_id from links k left join relied r using (fact_version_id)", "relied", "links"),
    ),
    "pg11_grouped_impact": (
        _grouped,
        sql(
            _IMPACT_SOURCE + f"\nselect distinct organization_id, source_id, decision_id, {t('decided_at')} as decided_at, fact_version_id, via from im where decision_id is not null",
            "relied", "links",
        ),
    ),
    "pg11_impact_summary": (
        lambda s, d: pg.impact_summary(_impact_source(s, d), "source_id"),
        sql(
            _IMPACT_SOURCE + """
select organization_id, source_id, count(distinct fact_version_id) as affected_versions, count(distinct decision_id) as affected_decisions from im group by 1, 2""",
            "relied", "links",
        ),
    ),
    "pg12_decision_lineage": (
        lambda s, d: _lineage(s, d).select("decision_id", "fact_version_id", "privacy_scope", "redacted", "external_id", "property", "source_id", "source_name"),
        sql(
            f"""with m as (select r.decision_id, l.*, {ordinal('l.privacy_scope')} > 1 as redacted from relied r join led l on l.id = r.fact_version_id)
select decision_id, id as fact_version_id, privacy_scope, redacted, case when not redacted then external_id end as external_id,
 case when not redacted then property end as property, case when not redacted then source_id end as source_id,
 case when not redacted then 'source-' || source_id end as source_name from m""", "relied",
        ),
    ),
    "pg12_lineage_evidence": (
        _lineage_evidence,
        sql(
            f"""select r.decision_id, r.fact_version_id, k.evidence_id, k.relation, e.source_id as evidence_source_id from relied r join led l on l.id = r.fact_version_id
 join links k on k.fact_version_id = l.id join evid e on e.id = k.evidence_id where {ordinal('l.privacy_scope')} <= 1""", "relied", "links",
        ),
    ),
    "pg13_exists": (
        _exists, sql("select cast(organization_id as varchar) as org, count(*) as known from led group by 1", "led"),
    ),
    "pg14_pending": (
        _pending, sql("select organization_id, count(*) as pending_events from led where recorded_at > TIMESTAMP '2024-01-15' group by 1", "led"),
    ),
}


def _source_use(s, d):
    used = led(s, d).groupBy("organization_id", F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("versions"))
    return pg.list_sources(src(s, d).join(used, ["organization_id", "id"], "left").fillna(0, subset=["versions"])).select(
        "organization_id", "name", "source_type", "versions"
    )
