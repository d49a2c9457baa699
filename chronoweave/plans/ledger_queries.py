"""Registered queries: building the ledger, evidence, revocations, contradictions, audits, scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweave.functions import scalars as sc
from chronoweave.operators import audit as au, build, contradictions as cd, revocations as rv
from chronoweave.operators.temporal import FACT
from chronoweave.plans import fixtures as fx
from chronoweave.plans.common import (
    SCOPE_OF, conflicts, dec, evidence, flat, led, links, ordinal, relied, revs, snap, snapshots, sql, src, t,
)
from chronoweave.session import cut_lineage

# --- planning ------------------------------------------------------------------------------------


def _fixed_claims(s, d):
    """Claims where every third has a fixed end 1..50 hours after its start."""
    i = F.col("id")
    return fx.claims(s, d).withColumn(
        "valid_until",
        F.when(i % 3 == 0, F.col("valid_from") + F.make_dt_interval(F.lit(0), (i % 50 + 1).cast("int"))),
    )


def _built(claims):
    b = build.build_versions(claims)
    return flat(
        b.versions.select("id", "version", "supersedes_id", "recorded_at", "valid_until", "valid_until_recorded_at")
    )


def _built_for_two(s, d):
    """The same claims, ids and all, made in two sets of tenants."""
    claims = _fixed_claims(s, d)
    twice = claims.unionByName(claims.withColumn("organization_id", F.col("organization_id") + 4))
    return flat(build.build_versions(twice).versions.select("organization_id", "id", "version", "supersedes_id", "recorded_at", "valid_until"))


_PLAN = f"""
with oc as (select *, row_number() over (partition by fact_id order by arrival, id) as n,
  max(valid_from) over (partition by fact_id order by arrival, id rows between unbounded preceding and 1 preceding) as before from claims),
ok as (select *, row_number() over (partition by fact_id order by n) as version from oc where before is null or valid_from > before),
tm as (select *, max(arrival - INTERVAL '0.000001' SECOND * version) over (partition by fact_id order by version rows unbounded preceding)
  + INTERVAL '0.000001' SECOND * version as recorded_at from ok),
built as (select *, lag(id) over w as supersedes_id, lead(valid_from) over w as valid_until, lead(recorded_at) over w as valid_until_recorded_at
  from tm window w as (partition by fact_id order by version))"""
_FOLD = """
with fc as (select *, epoch_us(valid_from) as s, case when id % 3 = 0 then valid_from + INTERVAL '1' HOUR * (id % 50 + 1) end as own_end,
  row_number() over (partition by fact_id order by arrival, id) as n from claims),
fe as (select *, coalesce(epoch_us(own_end), s + 1) as e from fc),
fold as (select fact_id, n, id, true as ok, e as thr from fe where n = 1 union all
  select fe.fact_id, fe.n, fe.id, fe.s >= fold.thr, case when fe.s >= fold.thr then fe.e else fold.thr end
  from fold join fe on fe.fact_id = fold.fact_id and fe.n = fold.n + 1),
ok as (select fe.*, row_number() over (partition by fe.fact_id order by fe.n) as version from fe join fold using (fact_id, n) where fold.ok),
tm as (select *, max(arrival - INTERVAL '0.000001' SECOND * version) over (partition by fact_id order by version rows unbounded preceding)
  + INTERVAL '0.000001' SECOND * version as recorded_at from ok),
built as (select *, lag(id) over w as supersedes_id, coalesce(own_end, lead(valid_from) over w) as valid_until,
  case when own_end is not null then recorded_at else lead(recorded_at) over w end as valid_until_recorded_at
  from tm window w as (partition by fact_id order by version))"""
_BUILT = (
    f"\nselect id, version, supersedes_id, {t('recorded_at')} as recorded_at, {t('valid_until')} as valid_until, "
    f"{t('valid_until_recorded_at')} as valid_until_recorded_at from built"
)


def _closures(s, d):
    return flat(build.build_versions(fx.claims(s, d)).closures.select("fact_version_id", "valid_until", "recorded_at"))


def _rejects(s, d):
    return build.build_versions(_fixed_claims(s, d)).rejects.select("id", "reason")


def _dimensions(s, d):
    e, f = build.upsert_dimensions(fx.claims(s, d))
    return f.join(e.select(F.col("id").alias("entity_id"), F.lit(1).alias("k")), "entity_id").select(
        "organization_id", "external_id", "property", "entity_id", "id"
    )


def _source_requests(s, d):
    doc = fx.table(s, d, "documents")
    i = F.col("doc_id")
    return doc.select(
        (i % 4).alias("organization_id"), i.alias("id"), F.concat(F.lit("  "), F.col("source"), F.lit("   feed ")).alias("name"),
        F.when(i % 11 == 0, "GUESS").otherwise("DOCUMENT").alias("source_type"),
        F.when(i % 13 == 0, "ftp://host/x").when(i % 2 == 0, " https://host/x ").alias("uri"),
        F.when(i % 3 == 0, (i % 120).cast("int")).alias("default_authority"), F.lit("2024-01-01").cast("timestamp").alias("requested_at"),
    )


def _sources(s, d):
    existing = s.createDataFrame([(1, "src1 feed")], "organization_id long, name string")
    new, refused = build.register_sources(_source_requests(s, d), existing)
    return new.select("organization_id", "id", "name", F.lit("registered").alias("outcome")).unionByName(
        refused.select("organization_id", "id", "name", F.col("reason").alias("outcome"))
    )


_SOURCES = """
with r as (select doc_id % 4 as organization_id, doc_id as id, source || ' feed' as name,
  case when doc_id % 11 = 0 then 'bad_source_type' when doc_id % 13 = 0 then 'bad_uri'
   when doc_id % 3 = 0 and doc_id % 120 > 100 then 'bad_authority' end as reason from documents),
g as (select *, row_number() over (partition by organization_id, name, reason is null order by id) as k from r)
select organization_id, id, name, case when reason is not null then reason
 when (organization_id = 1 and name = 'src1 feed') or k > 1 then 'name_exists' else 'registered' end as outcome from g"""


def _defaults(s, d):
    i = F.col("id")
    c = fx.claims(s, d)
    c = (
        c.withColumn("authority", F.when(i % 2 == 0, F.col("authority")))
        .withColumn("confidence", F.when(i % 3 != 0, F.col("confidence")))
        .withColumn("privacy_scope", F.when(i % 5 != 0, F.col("privacy_scope")))
        .withColumn("observed_at", F.when(i % 7 != 0, F.col("observed_at")))
        .withColumn("source_id", F.when(i % 9 == 0, F.lit(77)).otherwise(F.col("source_id")))
    )
    ok, bad = build.apply_claim_defaults(c, src(s, d))
    cols = ["id", "authority", "confidence", "privacy_scope", "observed_at"]
    return flat(ok.select(*cols, F.lit(None).cast("string").alias("reason")).unionByName(bad.select(*cols, "reason")))


def _capture(s, d):
    _, outcome, _ = build.capture_evidence(fx.evidence_requests(s, d))
    return outcome.select("id", "evidence_id", "created", "content_sha256")


def _capture_rejects(s, d):
    return build.capture_evidence(fx.evidence_requests(s, d))[2].select("id", "reason")


def _link_requests(s, d):
    """Every link asked for twice, once with the other relation for some; plus foreign tenants."""
    base = fx.evidence_links(s, d)
    again = base.withColumn("linked_at", F.col("linked_at") + F.expr("INTERVAL '1' DAY")).withColumn(
        "relation", F.when(F.col("evidence_id") % 4 == 0, F.lit("CONTRADICTS")).otherwise(F.col("relation"))
    )
    foreign = base.withColumn("organization_id", (F.col("organization_id") + 1) % 4)
    return base.unionByName(again).unionByName(foreign)


def _links(s, d):
    new, clash, missing = build.link_evidence(_link_requests(s, d), led(s, d), evidence(s, d))
    pair = ["organization_id", "fact_version_id", "evidence_id"]
    return (
        new.select(*pair, F.lit("linked").alias("outcome"))
        .unionByName(clash.select(*pair, F.lit("conflict").alias("outcome")))
        .unionByName(missing.select(*pair, F.col("reason").alias("outcome")))
    )


_LINKS = """
with base as (select d.doc_id % 4 as organization_id, d.doc_id as evidence_id, e.event_id as fact_version_id
  from documents d join events e on e.event_id = d.doc_id * 3 % (select count(*) from events) where d.doc_id % 4 = e.user_id % 4),
known as (select b.*, b.evidence_id in (select id from evid) as k from base b)
select organization_id, fact_version_id, evidence_id, 'linked' as outcome from known where k
union all select organization_id, fact_version_id, evidence_id, 'conflict' from known where k and evidence_id % 4 = 0 and evidence_id % 5 <> 0
union all select organization_id, fact_version_id, evidence_id, 'unknown_evidence' from known where not k
union all select organization_id, fact_version_id, evidence_id, 'unknown_evidence' from known where not k
union all select (organization_id + 1) % 4, fact_version_id, evidence_id, 'unknown_version' from known"""


def _atomic_evidence(s, d):
    """Claims cite one document each; those citing a document that was not captured are refused whole."""
    n = fx.table(s, d, "documents").agg(F.count(F.lit(1)).alias("n")).scalar()
    doc = F.floor((F.col("id") * 4 + F.col("organization_id")) % n)
    c = fx.claims(s, d).withColumn("evidence_ids", F.array(doc))
    b = build.build_versions(c, known_evidence=evidence(s, d))
    return b.rejects.where("reason = 'unknown_evidence'").select("id", "reason")


# --- revocations -----------------------------------------------------------------------------------


def _revocation_requests(s, d):
    """Every RESTRICTED version is asked to be revoked twice, the latest of its fact by default once."""
    v = led(s, d).where("privacy_scope = 'RESTRICTED'")
    at = lambda h: F.lit("2024-02-01").cast("timestamp") + F.expr(f"INTERVAL '{h}' HOUR")
    ask = lambda n, vid, h, why: v.select(
        "organization_id", (F.col("id") * 4 + n).alias("id"), "fact_id", vid.alias("version_id"), F.lit(why).alias("reason"),
        F.lit("auditor").alias("revoked_by_user_id"), at(h).alias("requested_at"),
    )
    none = F.lit(None).cast("long")
    return (
        ask(0, F.col("id"), 1, " wrong ").unionByName(ask(1, F.col("id"), 2, "again"))
        .unionByName(ask(2, none, 3, "latest is wrong")).unionByName(ask(3, F.col("id"), 0, "   "))
    )


def _revoke(s, d):
    done, refused = rv.record_revocations(_revocation_requests(s, d), led(s, d), revs(s, d))
    return done.select("id", "fact_version_id", F.lit("revoked").alias("outcome")).unionByName(
        refused.select("id", F.lit(None).cast("long").alias("fact_version_id"), F.col("problem").alias("outcome"))
    )


_REVOKE = """
with v as (select * from led where privacy_scope = 'RESTRICTED'), latest as (select fact_id, max_by(id, version) as top from led group by 1),
rq as (select id * 4 + n as id, case when n = 2 then top else v.id end as fact_version_id, n,
  (case n when 0 then 1 when 1 then 2 when 2 then 3 else 0 end) as hr from v join latest using (fact_id), (values (0), (1), (2), (3)) q(n)),
g as (select *, case when n = 3 then 'bad_reason' when fact_version_id in (select fact_version_id from revs) then 'already_revoked' end as problem from rq),
w as (select *, row_number() over (partition by fact_version_id, (problem is null) order by hr, id) as k from g)
select id, case when problem is null and k = 1 then fact_version_id end as fact_version_id,
 coalesce(problem, case when k = 1 then 'revoked' else 'already_revoked' end) as outcome from w"""


def _impacts(s, d):
    return rv.impact_rows(revs(s, d), snap(s, d), dec(s, d), relied(s, d))


def _early_revs(s, d):
    """Revocations dated in the middle of the decisions, so that both sides of the date occur."""
    return revs(s, d).withColumn("revoked_at", F.col("revoked_at") + F.expr("INTERVAL '2' DAY"))


_HELD = """
with er as (select id as revocation_id, fact_version_id, organization_id, revoked_at + INTERVAL '2' DAY as revoked_at from revs),
held as (select er.*, d.id as decision_id, d.decided_at, s.relied_on
  from er join snap s on s.fact_version_id = er.fact_version_id join dec d on d.snapshot_id = s.snapshot_id)"""


def _report_rows(s, d):
    r = _early_revs(s, d)
    impacts = rv.impact_rows(r.withColumn("revoked_at", F.col("revoked_at") - F.expr("INTERVAL '4' DAY")), snap(s, d), dec(s, d), relied(s, d))
    return rv.revocation_decisions(r, snap(s, d), dec(s, d), relied(s, d), impacts)


def _report(s, d):
    return rv.revocation_report(_early_revs(s, d), led(s, d), _report_rows(s, d))


_COUNTS = """select r.id as revocation_id, l.property, l.version, cast(count(h.decision_id) as bigint) as decisions_with_version_in_context,
 cast(count(*) filter (h.relied_on) as bigint) as decisions_relied_on,
 cast(count(*) filter (h.decided_at > h.revoked_at - INTERVAL '4' DAY) as bigint) as decided_after_revocation"""
_REPORT_COLS = ["revocation_id", "property", "version", "decisions_with_version_in_context", "decisions_relied_on", "decided_after_revocation"]

# --- contradictions ----------------------------------------------------------------------------------

_CONF_COLS = ["id", "left_version_id", "right_version_id", "preferred_version_id", "privacy_scope", "kind", "status", "detected_at"]
_CONF_SQL = f"id, left_version_id, right_version_id, preferred_version_id, privacy_scope, kind, status, {t('detected_at')} as detected_at"


def _findings(s, d):
    """Labelled current facts of every user, with findings between neighbouring labels."""
    from chronoweave.operators.temporal import latest_versions

    v = latest_versions(led(s, d)).withColumn("review_id", F.col("external_id"))
    place = F.row_number().over(Window.partitionBy("review_id").orderBy("property"))  # one review's facts
    labelled = v.withColumn("n", place).withColumn("label", F.concat(F.lit("F"), F.col("n").cast("string")))
    f = labelled.select(
        "review_id", F.col("label").alias("left_label"),
        F.explode(F.array(F.concat(F.lit("F"), (F.col("n") + 1).cast("string")), F.col("label"))).alias("right_label"),
        F.lit("they disagree").alias("explanation"), F.lit("2024-02-01").cast("timestamp").alias("found_at"),
    )
    existing = labelled.where(F.col("review_id") == "3").select("organization_id", "review_id", "id", "n")
    a, b = existing.alias("a"), existing.alias("b")
    known = a.join(b, (F.col("a.n") == 1) & (F.col("b.n") == 2)).select(
        F.col("a.organization_id").alias("organization_id"),
        F.when(F.col("a.id").cast("string") < F.col("b.id").cast("string"), F.col("a.id")).otherwise(F.col("b.id")).alias("left_version_id"),
        F.when(F.col("a.id").cast("string") < F.col("b.id").cast("string"), F.col("b.id")).otherwise(F.col("a.id")).alias("right_version_id"),
    )
    return cd.accept_findings(f, labelled, known, "review-v1")


_FINDINGS = f"""
with cur as (select *, row_number() over (partition by user_id order by property) as n from led where valid_until is null),
p as (select a.user_id, a.id as x, b.id as y, a.privacy_scope as xs, b.privacy_scope as ys, a.user_id = 3 and a.n = 1 as known
  from cur a join cur b on a.user_id = b.user_id and b.n = a.n + 1)"""


def _resolution_log(s, d):
    """Two entries per contradiction, the second too late; every fifth first entry has a bad status."""
    c = conflicts(s, d)
    key = F.col("right_version_id")
    at = lambda h: F.lit("2024-03-01").cast("timestamp") + F.expr(f"INTERVAL '{h}' HOUR")
    first = c.select(
        "organization_id", F.col("id").alias("contradiction_id"), (key * 2).alias("entry_id"),
        F.when(key % 5 == 0, "open").when(key % 2 == 0, "resolved").otherwise("dismissed").alias("status"),
        F.lit("seen").alias("note"), F.lit("ann").alias("user_id"), at(1).alias("at"),
    )
    second = first.withColumn("entry_id", F.col("entry_id") + 1).withColumn("status", F.lit("resolved")).withColumn("at", at(2))
    return first.unionByName(second)


def _resolved(s, d):
    now, _ = cd.apply_resolutions(conflicts(s, d), _resolution_log(s, d))
    return flat(now.select("id", "status", "resolved_at", "resolution_note"))


def _late_resolutions(s, d):
    _, refused = cd.apply_resolutions(conflicts(s, d), _resolution_log(s, d))
    return refused.select("entry_id", "problem")


def _view(s, d):
    v = cd.contradiction_view(conflicts(s, d), led(s, d), src(s, d))
    return v.select("id", "left_property", "left_version", "left_value", "left_source_name", "right_version", "right_value", "right_source_name")


# --- audits of a damaged ledger -----------------------------------------------------------------------


def _damaged(s, d):
    """The ledger with known faults: shifted starts, doubled numbers, lost links, odd values."""
    i = F.col("id")
    return (
        led(s, d)
        .withColumn("valid_from", F.when(i % 101 == 0, F.col("valid_from") - F.expr("INTERVAL '3' DAY")).otherwise(F.col("valid_from")))
        .withColumn("version", F.when(i % 103 == 0, F.col("version") - 1).otherwise(F.col("version")))
        .withColumn("supersedes_id", F.when(i % 107 == 0, F.lit(None)).otherwise(F.col("supersedes_id")))
        .withColumn("supersedes_id", F.when((i % 109 == 0) & F.col("supersedes_id").isNotNull(), F.col("id") + 1_000_000).otherwise(F.col("supersedes_id")))
        .withColumn("authority", F.when(i % 113 == 0, F.lit(101)).otherwise(F.col("authority")))
        .withColumn("confidence", F.when(i % 127 == 0, F.lit("1.5").cast("decimal(4,3)")).otherwise(F.col("confidence")))
        .withColumn("privacy_scope", F.when(i % 131 == 0, "SECRET").otherwise(F.col("privacy_scope")))
        .withColumn("value", F.when(i % 137 == 0, "null").otherwise(F.col("value")))
        .withColumn("valid_until_recorded_at", F.when(i % 139 == 0, F.lit(None).cast("timestamp")).otherwise(F.col("valid_until_recorded_at")))
    )


_DAMAGED = """
dam as (select organization_id, id, fact_id, case when id % 101 = 0 then valid_from - INTERVAL '3' DAY else valid_from end as valid_from, valid_until,
  cast(case when id % 103 = 0 then version - 1 else version end as int) as version,
  case when id % 107 = 0 or supersedes_id is null then null when id % 109 = 0 then id + 1000000 else supersedes_id end as supersedes_id,
  case when id % 113 = 0 then 101 else authority end as authority, case when id % 127 = 0 then 1.5 else confidence end as confidence,
  case when id % 131 = 0 then 'SECRET' else privacy_scope end as privacy_scope, case when id % 137 = 0 then 'null' else value end as value,
  case when id % 139 = 0 then null else valid_until_recorded_at end as valid_until_recorded_at from led)"""
_OVERLAP = f"""
with {_DAMAGED},
o as (select *, max(coalesce(valid_until, TIMESTAMP '9999-12-31 00:00:00')) over (partition by fact_id order by valid_from, version, id
  rows between unbounded preceding and 1 preceding) as ended from dam)
select 'overlapping_validity' as rule, organization_id || '|' || id as key from o where ended > valid_from"""
_NUMBERING = f"""
with {_DAMAGED},
z as (select 1)
select 'version_below_1' as rule, organization_id || '|' || id as key from dam where version < 1
union all select 'duplicate_version', organization_id || '|' || fact_id || '|' || version from dam group by organization_id, fact_id, version having count(*) > 1
union all select 'supersedes_missing_or_extra', organization_id || '|' || id from dam where (version = 1) <> (supersedes_id is null)
union all select 'superseded_twice', organization_id || '|' || supersedes_id from dam where supersedes_id is not null group by organization_id, supersedes_id having count(*) > 1
union all select 'supersedes_other_fact', organization_id || '|' || id from dam a where supersedes_id is not null
 and not exists (from dam b where b.fact_id = a.fact_id and b.id = a.supersedes_id)"""
_VALUES = f"""
with {_DAMAGED},
z as (select 1)
select 'empty_window' as rule, organization_id || '|' || id as key from dam where valid_until <= valid_from
union all select 'end_without_recording', organization_id || '|' || id from dam where (valid_until is null) <> (valid_until_recorded_at is null)
union all select 'authority_out_of_range', organization_id || '|' || id from dam where authority > 100
union all select 'confidence_out_of_range', organization_id || '|' || id from dam where confidence > 1
union all select 'unknown_scope', organization_id || '|' || id from dam where privacy_scope = 'SECRET'
union all select 'bad_value', organization_id || '|' || id from dam where value = 'null'"""


def _closure_faults(s, d):
    """Links moved to a foreign tenant."""
    moved = fx.evidence_links(s, d).withColumn(
        "organization_id", F.when(F.col("evidence_id") % 3 == 0, (F.col("organization_id") + 1) % 4).otherwise(F.col("organization_id"))
    )
    return au.tenant_closure(moved, "fact_version_id", led(s, d), "link_to_unknown_version").unionByName(
        au.tenant_closure(moved, "evidence_id", evidence(s, d), "link_to_unknown_evidence")
    )


def _outside(s, d):
    """Every decision also claims to rely on the version after each relied one."""
    extra = relied(s, d).withColumn("fact_version_id", F.col("fact_version_id") + 1)
    return au.cites_outside_snapshot(relied(s, d).unionByName(extra), snap(s, d))


def _evidence_faults(s, d):
    i = F.col("id")
    bad = (
        evidence(s, d)
        .withColumn("evidence_type", F.when(i % 7 == 0, "RUMOUR").otherwise(F.col("evidence_type")))
        .withColumn("content_sha256", F.when(i % 11 == 0, F.upper("content_sha256")).otherwise(F.col("content_sha256")))
        .withColumn("metadata", F.when(i % 13 == 0, "[1]").otherwise(F.col("metadata")))
    )
    return au.evidence_rules(bad)


def _embedding_faults(s, d):
    e = fx.table(s, d, "embeddings")
    rows = e.select(
        F.lit(0).alias("organization_id"), F.col("vec_id").alias("fact_version_id"), F.lit("m").alias("model"),
        F.when(F.col("vec_id") % 9 == 0, "xyz").otherwise(F.sha2(F.col("vec_id").cast("string"), 256)).alias("content_sha256"),
        F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")).alias("embedding"),
    )
    doubled = rows.where(F.col("fact_version_id") % 12 == 0)
    return au.embedding_rules(rows.unionByName(doubled), 64)


def _contradiction_faults(s, d):
    c = conflicts(s, d)
    k = F.col("right_version_id")
    bad = (
        c.withColumn("left_version_id", F.when(k % 5 == 0, k).otherwise(F.col("left_version_id")))
        .withColumn("kind", F.when(k % 7 == 0, "hunch").otherwise(F.col("kind")))
        .withColumn("status", F.when(k % 9 == 0, "resolved").when(k % 11 == 0, "unsure").otherwise(F.col("status")))
    )
    return au.contradiction_rules(bad.unionByName(bad.where(F.col("left_version_id") % 13 == 0)))


def _revocation_faults(s, d):
    r = revs(s, d)
    doubled = r.where(F.col("id") % 2 == 0).withColumn("reason", F.lit("  "))
    impacts = rv.impact_rows(r.withColumn("revoked_at", F.lit("2025-01-01").cast("timestamp")), snap(s, d), dec(s, d), relied(s, d))
    wrong = impacts.withColumn("fact_version_id", F.col("fact_version_id") + 1)
    return au.revocation_rules(r.unionByName(doubled), wrong, snap(s, d))


def _snapshot_faults(s, d):
    p = snap(s, d).withColumn(
        "position", F.when(F.col("snapshot_id") % 9 == 0, F.col("position") - 1).when(F.col("snapshot_id") % 10 == 0, F.lit(1)).otherwise(F.col("position"))
    )
    head = snapshots(s, d).withColumn("vector_search", F.when(F.col("id") % 50 == 0, "maybe").otherwise(F.col("vector_search")))
    return au.snapshot_rules(head, p)


def _changed(s, d):
    """Two copies: ends learned after a day are still open in the first; faults in the second."""
    i = F.col("id")
    later = F.coalesce(F.col("valid_until_recorded_at") > F.lit("2024-01-16"), F.lit(False))
    before = led(s, d).withColumn("valid_until", F.when(~later, F.col("valid_until"))).withColumn(
        "valid_until_recorded_at", F.when(~later, F.col("valid_until_recorded_at"))
    )
    after = (
        led(s, d).where(i % 211 != 0)
        .withColumn("value", F.when(i % 223 == 0, "0").otherwise(F.col("value")))
        .withColumn("valid_until", F.when(i % 227 == 0, F.col("valid_until") + F.expr("INTERVAL '1' HOUR")).otherwise(F.col("valid_until")))
    )
    return au.append_only(before, after)


def _no_admin(s, d):
    """Users of the events as members of their tenant; only even users of tenant 0 and 2 are admins."""
    m = led(s, d).select("organization_id", F.col("external_id").alias("user_id")).distinct()
    role = F.when((F.col("organization_id") % 2 == 0) & (F.col("user_id").cast("int") % 2 == 0), "ADMIN").otherwise("VIEWER")
    return au.tenants_without_admin(m.withColumn("role", role))


def _sound(s, d):
    """Every audit over the sound ledger: no rows. Source n of the documents speaks for source n % 5 of their tenant."""
    spoken = (F.regexp_extract("source_id", "([0-9]+)", 1).cast("int") % 5).cast("long")
    return au.audit(
        {
            "versions": led(s, d), "sources": src(s, d), "evidence": evidence(s, d).withColumn("source_id", spoken), "links": links(s, d), "decisions": dec(s, d),
            "snapshots": snapshots(s, d), "snapshot_facts": snap(s, d), "decision_facts": relied(s, d), "revocations": revs(s, d),
            "impacts": _impacts(s, d), "contradictions": conflicts(s, d),
        }
    )


# --- scalar rules over whole tables --------------------------------------------------------------------


def _raw_claims(s, d):
    """Claims with spellings to normalise and faults to find."""
    i = F.col("id")
    return fx.claims(s, d).select(
        "organization_id", "id",
        F.when(i % 17 == 0, " Us er ").otherwise(" User ").alias("entity_type"),
        F.when(i % 19 == 0, "a\u0007b").otherwise(F.concat(F.lit(" "), F.col("external_id"), F.lit("\n"))).alias("external_id"),
        F.when(i % 23 == 0, "9lives").otherwise(F.concat(F.lit("Billing."), F.col("property"))).alias("property"),
        F.when(i % 29 == 0, "{oops").when(i % 31 == 0, "null").otherwise(F.concat(F.lit('{"b":1.0,"a":'), F.col("value"), F.lit("}"))).alias("value"),
        "source_id", "valid_from", "valid_until", F.lit(None).cast("timestamp").alias("observed_at"), "authority",
        F.when(i % 37 == 0, "1.0006").when(i % 2 == 0, "0.12350").otherwise("0.1225").alias("confidence"),
        F.when(i % 41 == 0, "SECRET").when(i % 2 == 0, F.lit(None)).otherwise(F.col("privacy_scope")).alias("privacy_scope"),
    )


def _normalized(s, d):
    ok, bad = build.normalize_claims(_raw_claims(s, d))
    cols = ["id", "entity_type", "external_id", "property", "value", "confidence", "privacy_scope"]
    good = ok.select(*cols, F.lit(None).cast("string").alias("reason"))
    none = bad.select("id", *[F.lit(None).cast(ok.schema[c].dataType).alias(c) for c in cols[1:]], "reason")
    return flat(good.unionByName(none))


_NORMALIZED = f"""
with n as (select id, external_id, property, value,
  case when id % 17 = 0 then 'bad_entity_type' when id % 19 = 0 then 'bad_external_id' when id % 23 = 0 then 'bad_property'
   when id % 29 = 0 or id % 31 = 0 then 'bad_value' when id % 37 = 0 then 'bad_confidence' when id % 41 = 0 then 'bad_privacy_scope' end as reason,
  case when id % 2 = 0 then 'INTERNAL' else privacy_scope end as privacy_scope from claims)
select id, reason, case when reason is null then 'user' end as entity_type, case when reason is null then external_id end as external_id,
 case when reason is null then 'billing.' || property end as property, case when reason is null then '{{"a":' || value || ',"b":1}}' end as value,
 cast(case when reason is null then case when id % 2 = 0 then 0.124 else 0.122 end end as double) as confidence,
 case when reason is null then privacy_scope end as privacy_scope from n"""


def _names(s, d):
    """Slugs, e-mails and names derived from documents."""
    doc = fx.table(s, d, "documents")
    i = F.col("doc_id")
    slug = sc.normalize_slug(F.concat(F.lit(" "), F.upper("source"), F.when(i % 3 == 0, "-").otherwise("-x"), F.lit(" ")))
    mail = sc.normalize_email(F.concat(F.upper("source"), F.when(i % 4 == 0, " at ").otherwise("@"), F.lit("Host.org ")))
    name = sc.normalize_name(F.when(i % 5 == 0, "  ").otherwise(F.concat(F.col("lang"), F.lit(" \t "), F.col("source"))))
    return doc.select(
        i.alias("id"), slug.alias("slug"), sc.slug_ok(slug).alias("slug_ok"), mail.alias("email"), sc.email_ok(mail).alias("email_ok"),
        name.alias("name"), sc.name_ok(name).alias("name_ok"),
    )


def _props(s, d):
    """The JSON of every event: canonical text, hash, allowed or not."""
    e = fx.table(s, d, "events")
    canonical = sc.canonical_json(F.concat(F.lit('{"z": [1, 2.50, "x y"], "p": '), F.col("props"), F.lit(', "a": "é"}')))
    return e.select(
        F.col("event_id").alias("id"), canonical.alias("canonical"), sc.value_sha256(canonical).alias("sha"),
        sc.fact_value_ok(canonical).alias("ok"), sc.escaped_bytes(canonical).alias("bytes"),
    )


def _excerpts(s, d):
    x = sc.normalize_excerpt(F.col("text"))
    return fx.table(s, d, "documents").select(
        F.col("doc_id").alias("id"), F.length(x).alias("chars"), sc.content_hash(x).alias("sha"), sc.excerpt_problem(x).alias("problem")
    )


def _instants(s, d):
    e = fx.table(s, d, "events")
    whole = F.date_trunc("second", "ts")
    inside = sc.window_contains(F.col("ts"), F.col("ts") + F.make_dt_interval(F.lit(0), (F.col("event_id") % 30).cast("int")), F.lit("2024-01-15").cast("timestamp"))
    return e.select(F.col("event_id").alias("id"), sc.utc_iso(F.col("ts")).alias("iso"), sc.utc_iso(whole).alias("iso_whole"), inside.alias("inside"))


def _tokens(s, d):
    w = fx.table(s, d, "documents").select(F.explode(sc.tokens(F.col("text"))).alias("token"))
    return w.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


_TOK = "select unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from documents"


def _limits(s, d):
    e = fx.table(s, d, "events")
    i = F.col("event_id")
    uri = sc.normalize_uri(F.when(i % 3 == 0, " s3://b/k ").when(i % 3 == 1, "ftp://x"))
    meta = F.when(i % 4 == 0, F.col("props")).when(i % 4 == 1, "[1]").when(i % 4 == 2, "{bad")
    why = sc.normalize_rationale(F.when(i % 2 == 0, F.concat(F.lit("  "), F.col("event_type"), F.lit(" "))).otherwise("   "))
    return e.select(
        i.alias("id"), uri.alias("uri"), sc.uri_ok(uri).alias("uri_ok"), sc.authority_ok(i % 150).alias("authority_ok"),
        sc.metadata_ok(meta).alias("metadata_ok"), why.alias("rationale"),
    )


QUERIES = {
    "lb1_build_versions": (lambda s, d: _built(fx.claims(s, d)), sql(_PLAN + _BUILT, "claims")),
    "lb1_build_versions_fixed_ends": (lambda s, d: _built(_fixed_claims(s, d)), sql(_FOLD + _BUILT, "claims", recursive=True)),
    "lb1_build_versions_two_tenants": (
        _built_for_two,
        sql(
            _FOLD + f"""
select organization_id + 4 * k.k as organization_id, id, version, supersedes_id, {t('recorded_at')} as recorded_at, {t('valid_until')} as valid_until
 from built, (select 0 as k union all select 1) k""", "claims", recursive=True,
        ),
    ),
    "lb1_rejected_claims": (
        _rejects,
        sql(_FOLD + "\nselect id, 'starts_before_latest_allows' as reason from fold where not ok", "claims", recursive=True),
    ),
    "lb2_transaction_time": (
        lambda s, d: flat(led(s, d).select("id", "version", "recorded_at")),
        sql(f"select id, version, {t('recorded_at')} as recorded_at from led", "led"),
    ),
    "lb3_closures": (
        _closures,
        sql(
            _PLAN + f"\nselect id as fact_version_id, {t('valid_until')} as valid_until, {t('valid_until_recorded_at')} as recorded_at from built where valid_until is not null",
            "claims",
        ),
    ),
    "lb4_dimensions": (
        _dimensions,
        sql(
            """select distinct organization_id, external_id, property, sha256('["' || organization_id || '","user","' || external_id || '"]') as entity_id,
 sha256('["' || organization_id || '","user","' || external_id || '","' || property || '"]') as id from claims""", "claims",
        ),
    ),
    "lb5_register_sources": (_sources, _SOURCES.strip()),
    "lb6_claim_defaults": (
        _defaults,
        sql(
            f"""select id, cast(case when id % 2 = 0 then authority when id % 9 = 0 then null else 50 + 10 * source_id end as int) as authority,
 cast(case when id % 3 <> 0 then confidence else 1.0 end as double) as confidence, case when id % 5 <> 0 then privacy_scope else 'INTERNAL' end as privacy_scope,
 {t('case when id % 7 <> 0 then observed_at else valid_from end')} as observed_at, case when id % 9 = 0 then 'unknown_source' end as reason from claims""", "claims",
        ),
    ),
    "lb7_capture_evidence": (
        _capture,
        sql(
            """select x.id, e.id as evidence_id, x.id = e.id as created, e.content_sha256 from excerpts x
 join evid e on e.organization_id = x.organization_id and e.source_id = x.source_id and e.content_sha256 = sha256(x.excerpt)""", "evid",
        ),
    ),
    "lb7_rejected_evidence": (
        _capture_rejects,
        sql(
            """select id, case when length(excerpt) = 0 then 'empty_excerpt' else 'excerpt_too_long' end as reason from excerpts
 where length(excerpt) not between 1 and 8000""", "excerpts",
        ),
    ),
    "lb8_link_evidence": (_links, sql(_LINKS, "evid")),
    "lb9_atomic_evidence": (
        _atomic_evidence,
        sql(
            """with n as (select count(*) as n from documents)
select c.id, 'unknown_evidence' as reason from claims c, n
 where not exists (from evid e where e.organization_id = c.organization_id and e.id = (c.id * 4 + c.organization_id) % n.n)""", "claims", "evid",
        ),
    ),
    "lb15_record_revocations": (_revoke, sql(_REVOKE, "revs")),
    "lb16_impact_rows": (
        lambda s, d: _impacts(s, d).select("revocation_id", "decision_id", "fact_version_id", "relied_on"),
        sql(
            """select r.id as revocation_id, d.id as decision_id, r.fact_version_id, s.relied_on from revs r
 join snap s on s.fact_version_id = r.fact_version_id join dec d on d.snapshot_id = s.snapshot_id and d.decided_at <= r.revoked_at""", "snap", "revs",
        ),
    ),
    "lb17_apply_resolutions": (
        _resolved,
        sql(
            """select id, case when right_version_id % 5 = 0 or right_version_id % 2 = 0 then 'resolved' else 'dismissed' end as status,
 case when right_version_id % 5 = 0 then '2024-03-01 02:00:00.000000' else '2024-03-01 01:00:00.000000' end as resolved_at, 'seen' as resolution_note from conf""", "conf",
        ),
    ),
    "lb17_refused_resolutions": (
        _late_resolutions,
        sql(
            """select case when right_version_id % 5 = 0 then right_version_id * 2 else right_version_id * 2 + 1 end as entry_id,
 case when right_version_id % 5 = 0 then 'bad_status' else 'already_closed' end as problem from conf""", "conf",
        ),
    ),
    "rv1_revocation_report": (
        lambda s, d: _report(s, d).select(*_REPORT_COLS),
        sql(
            _HELD + "\n" + _COUNTS + " from revs r join led l on l.id = r.fact_version_id left join held h on h.revocation_id = r.id group by 1, 2, 3", "relied", "revs",
        ),
    ),
    "rv1_decisions_of_revocations": (
        lambda s, d: _report_rows(s, d).select("revocation_id", "decision_id", "relied_on", "recorded_at_revocation", "decided_after_revocation"),
        sql(
            _HELD + """
select revocation_id, decision_id, relied_on, decided_at <= revoked_at - INTERVAL '4' DAY as recorded_at_revocation,
 decided_at > revoked_at - INTERVAL '4' DAY as decided_after_revocation from held""", "relied", "revs",
        ),
    ),
    "rv2_impact_of_facts": (
        lambda s, d: rv.impact_of_fact(_report(s, d), led(s, d).where("property = 'view'").select(*FACT).distinct(), "INTERNAL").select(*_REPORT_COLS),
        sql(
            _HELD + "\n" + _COUNTS + f""" from revs r join led l on l.id = r.fact_version_id left join held h on h.revocation_id = r.id
 where l.property = 'view' and {ordinal('l.privacy_scope')} <= 1 group by 1, 2, 3""", "relied", "revs",
        ),
    ),
    "rv3_latest_revocations": (
        lambda s, d: flat(rv.list_revocations(_report(s, d), "CONFIDENTIAL", 100).select("revocation_id", "revoked_at", "decisions_relied_on")),
        sql(
            _HELD + f"""
select r.id as revocation_id, {t("r.revoked_at + INTERVAL '2' DAY")} as revoked_at, cast(count(*) filter (h.relied_on) as bigint) as decisions_relied_on
 from revs r join led l on l.id = r.fact_version_id left join held h on h.revocation_id = r.id where {ordinal('l.privacy_scope')} <= 2
 group by r.id, r.revoked_at order by r.revoked_at desc, r.id limit 100""", "relied", "revs",
        ),
    ),
    "cd1_value_conflicts": (
        lambda s, d: flat(cd.value_conflicts(led(s, d)).select(*_CONF_COLS)), sql(f"select {_CONF_SQL} from conf", "conf"),
    ),
    "cd2_preferred_versions": (
        lambda s, d: conflicts(s, d).groupBy((F.col("preferred_version_id") == F.col("left_version_id")).alias("keeps_previous")).agg(F.count(F.lit(1)).alias("n")),
        sql("select preferred_version_id = left_version_id as keeps_previous, count(*) as n from conf group by 1", "conf"),
    ),
    "cd3_accepted_findings": (
        lambda s, d: _findings(s, d)[0].select("left_version_id", "right_version_id", "privacy_scope", "kind"),
        sql(
            _FINDINGS + f"""
select case when cast(x as varchar) < cast(y as varchar) then x else y end as left_version_id, case when cast(x as varchar) < cast(y as varchar) then y else x end as right_version_id,
 case when {ordinal('xs')} >= {ordinal('ys')} then xs else ys end as privacy_scope, 'semantic' as kind from p where not known""", "led",
        ),
    ),
    "cd3_review_counts": (
        lambda s, d: _findings(s, d)[1],
        sql(
            _FINDINGS + """,
c as (select user_id, count(*) as facts, max(n) as top from cur group by 1), k as (select user_id, count(*) as pairs, count(*) filter (known) as known from p group by 1)
select cast(user_id as varchar) as review_id, coalesce(pairs - known, 0) as created, coalesce(known, 0) as known, facts + 1 as rejected from c left join k using (user_id)""", "led",
        ),
    ),
    "cd4_list_contradictions": (
        lambda s, d: flat(cd.list_contradictions(conflicts(s, d), "CONFIDENTIAL", status="open", entity_type="user", limit=200).select("id", "detected_at")),
        sql(f"select id, {t('detected_at')} as detected_at from conf where privacy_scope <> 'RESTRICTED' order by conf.detected_at desc, id limit 200", "conf"),
    ),
    "cd5_two_sided_view": (
        _view,
        sql(
            """select c.id, l.property as left_property, l.version as left_version, l.value as left_value, 'source-' || l.source_id as left_source_name,
 r.version as right_version, r.value as right_value, 'source-' || r.source_id as right_source_name
 from conf c join led l on l.id = c.left_version_id join led r on r.id = c.right_version_id""", "conf",
        ),
    ),
    "au1_overlapping_validity": (lambda s, d: au.overlapping_validity(_damaged(s, d)), sql(_OVERLAP, "led")),
    "au2_version_numbering": (lambda s, d: au.version_numbering(_damaged(s, d)), sql(_NUMBERING, "led")),
    "au3_version_values": (lambda s, d: au.version_values(_damaged(s, d)), sql(_VALUES, "led")),
    "au4_tenant_closure": (
        _closure_faults,
        sql(
            """with moved as (select d.doc_id as evidence_id, e.event_id as fact_version_id, d.doc_id % 4 as org,
  case when d.doc_id % 3 = 0 then (d.doc_id % 4 + 1) % 4 else d.doc_id % 4 end as claimed
  from documents d join events e on e.event_id = d.doc_id * 3 % (select count(*) from events) where d.doc_id % 4 = e.user_id % 4)
select 'link_to_unknown_version' as rule, claimed || '|' || fact_version_id as key from moved where claimed <> org
union all select 'link_to_unknown_evidence', claimed || '|' || evidence_id from moved where claimed <> org or evidence_id not in (select id from evid)""", "evid",
        ),
    ),
    "au5_cites_outside_snapshot": (
        _outside,
        sql(
            """select 'cites_outside_snapshot' as rule, organization_id || '|' || decision_id || '|' || (fact_version_id + 1) as key from relied r
 where not exists (from snap s where s.snapshot_id = r.snapshot_id and s.fact_version_id = r.fact_version_id + 1)""", "relied",
        ),
    ),
    "au6_evidence": (
        _evidence_faults,
        sql(
            """select 'unknown_evidence_type' as rule, organization_id || '|' || id as key from evid where id % 7 = 0
union all select 'bad_content_hash', organization_id || '|' || id from evid where id % 11 = 0
union all select 'metadata_not_an_object', organization_id || '|' || id from evid where id % 13 = 0""", "evid",
        ),
    ),
    "au7_embeddings": (
        _embedding_faults,
        """with e as (select vec_id from embeddings union all select vec_id from embeddings where vec_id % 12 = 0)
select 'bad_content_hash' as rule, '0|' || vec_id || '|m' as key from e where vec_id % 9 = 0
union all select 'wrong_dimension', '0|' || vec_id || '|m' from e where vec_id % 10 = 0
union all select 'duplicate_embedding', vec_id || '|m' from e group by vec_id having count(*) > 1""",
    ),
    "au8_contradictions": (
        _contradiction_faults,
        sql(
            """with c as (select organization_id, id, right_version_id as k, case when right_version_id % 5 = 0 then right_version_id else left_version_id end as l from conf),
e as (select * from c union all select * from c where l % 13 = 0)
select 'same_version_twice' as rule, organization_id || '|' || id as key from e where l = k
union all select 'unknown_kind', organization_id || '|' || id from e where k % 7 = 0
union all select 'unknown_status', organization_id || '|' || id from e where k % 11 = 0 and k % 9 <> 0
union all select 'open_and_resolved', organization_id || '|' || id from e where k % 9 = 0 or k % 11 = 0
union all select 'duplicate_pair', organization_id || '|' || l || '|' || k from e group by organization_id, l, k having count(*) > 1""", "conf",
        ),
    ),
    "au9_revocations": (
        _revocation_faults,
        sql(
            """select 'revoked_twice' as rule, organization_id || '|' || fact_version_id as key from revs where id % 2 = 0
union all select 'blank_reason', organization_id || '|' || fact_version_id from revs where id % 2 = 0
union all select 'impact_not_in_context', s.organization_id || '|' || s.snapshot_id || '|' || (s.fact_version_id + 1) from snap s
 join revs r on r.fact_version_id = s.fact_version_id
 where not exists (from snap o where o.snapshot_id = s.snapshot_id and o.fact_version_id = s.fact_version_id + 1)""", "snap",
        ),
    ),
    "au10_snapshots": (
        _snapshot_faults,
        sql(
            """with p as (select organization_id, snapshot_id, case when snapshot_id % 9 = 0 then position - 1 when snapshot_id % 10 = 0 then 1 else position end as position from snap)
select 'position_below_1' as rule, organization_id || '|' || snapshot_id || '|' || position as key from p where position < 1
union all select 'duplicate_position', organization_id || '|' || snapshot_id || '|' || position from p group by organization_id, snapshot_id, position having count(*) > 1
union all select 'unknown_vector_search', organization_id || '|' || id from dec where id % 50 = 0""", "snap",
        ),
    ),
    "au11_append_only": (
        _changed,
        sql(
            """select case when id % 211 = 0 then 'version_vanished' when id % 223 = 0 and value <> '0' then 'version_changed' else 'end_changed_twice' end as rule,
 organization_id || '|' || id as key from led where id % 211 = 0 or (id % 223 = 0 and value <> '0')
 or (id % 227 = 0 and valid_until_recorded_at <= TIMESTAMP '2024-01-16 00:00:00')""", "led",
        ),
    ),
    "au12_tenants_without_admin": (
        _no_admin,
        """select 'no_admin' as rule, cast(user_id % 4 as varchar) as key from events group by user_id % 4
 having count(*) filter ((user_id % 4) % 2 = 0 and user_id % 2 = 0) = 0""",
    ),
    "au_sound_ledger": (_sound, "select 'x' as rule, 'x' as key from region where false"),
    "sc1_sc5_normalize_claims": (_normalized, sql(_NORMALIZED, "claims")),
    "sc3_slugs_emails_names": (
        _names,
        """select doc_id as id, lower(source) || case when doc_id % 3 = 0 then '-' else '-x' end as slug, doc_id % 3 <> 0 as slug_ok,
 lower(source) || case when doc_id % 4 = 0 then ' at ' else '@' end || 'host.org' as email, doc_id % 4 <> 0 as email_ok,
 case when doc_id % 5 = 0 then '' else lang || ' ' || source end as name, doc_id % 5 <> 0 as name_ok from documents""",
    ),
    "sc4_sc8_canonical_json": (
        _props,
        """with p as (select event_id as id, '{"a":"é","p":' || replace(props, ' ', '') || ',"z":[1,2.5,"x y"]}' as canonical from events)
select id, canonical, sha256(canonical) as sha, true as ok, cast(length(canonical) + 5 as int) as bytes from p""",
    ),
    "sc6_sc7_sc10_limits": (
        _limits,
        """select event_id as id, case event_id % 3 when 0 then 's3://b/k' when 1 then 'ftp://x' end as uri, event_id % 3 <> 1 as uri_ok,
 event_id % 150 <= 100 as authority_ok, event_id % 4 in (0, 3) as metadata_ok, case when event_id % 2 = 0 then event_type end as rationale from events""",
    ),
    "sc7_excerpts": (
        _excerpts,
        sql(
            """select id, cast(length(excerpt) as int) as chars, sha256(excerpt) as sha, case when length(excerpt) = 0 then 'empty_excerpt'
 when length(excerpt) > 8000 then 'excerpt_too_long' end as problem from excerpts""", "excerpts",
        ),
    ),
    "sc9_sc12_instants": (
        _instants,
        """select event_id as id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when epoch_us(ts) % 1000000 = 0 then '' else strftime(ts, '.%f') end || '+00:00' as iso,
 strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' as iso_whole, ts <= TIMESTAMP '2024-01-15' and ts + INTERVAL '1' HOUR * (event_id % 30) > TIMESTAMP '2024-01-15' as inside from events""",
    ),
    "sc13_tokens": (_tokens, f"select token, count(*) as n from ({_TOK}) w group by 1"),
}
