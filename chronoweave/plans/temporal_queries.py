"""Registered queries: bitemporal questions, privacy views and the ledger itself."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronoweave.functions.privacy import max_scope, visible_ordinal, visible
from chronoweave.ledger import empty, tenant_scoped
from chronoweave.operators import access, temporal as tq
from chronoweave.plans import fixtures as fx
from chronoweave.plans.common import dec, flat, led, ordinal, revs, sql, t
from chronoweave.session import checkpoint_root
from chronoweave.sources.ledger_io import append_closures, append_versions, load_ledger

T_TEXT, K_TEXT = "2024-01-15 00:00:00", "2024-01-16 00:00:00"
T = lambda: F.lit(T_TEXT).cast("timestamp")
K = lambda: F.lit(K_TEXT).cast("timestamp")
VALID = f"""recorded_at <= TIMESTAMP '{K_TEXT}' and valid_from <= TIMESTAMP '{T_TEXT}'
 and (valid_until is null or valid_until_recorded_at > TIMESTAMP '{K_TEXT}' or valid_until > TIMESTAMP '{T_TEXT}')"""
STANDING = f"id not in (select fact_version_id from revs where revoked_at <= TIMESTAMP '{K_TEXT}')"
MASKED = lambda c, k="known_at", p="": f"case when {k} is null or {p}valid_until_recorded_at <= {k} then {p}{c} end"


def _row(df, *extra):
    return flat(
        df.select(
            *extra, "organization_id", "id", "fact_id", "property", "version", "value", "valid_from", "valid_until",
            "recorded_at", "valid_until_recorded_at",
        )
    )


_ROW = f"organization_id, id, fact_id, property, version, value, {t('valid_from')} as valid_from, {t('recorded_at')} as recorded_at"


def _asks(s, d):
    """One ask per decision, with K missing, half a day after or six hours before T."""
    k = F.col("id") % 3
    return dec(s, d).select(
        F.col("id").alias("ask_id"), "organization_id", F.lit("user").alias("entity_type"),
        F.col("user_id").cast("string").alias("external_id"), F.col("decided_at").alias("valid_at"),
        F.when(k == 1, F.col("decided_at") + F.expr("INTERVAL '12' HOUR"))
        .when(k == 2, F.col("decided_at") - F.expr("INTERVAL '6' HOUR"))
        .alias("known_at"),
    )


_ASKS = """asks as (
 select id as ask_id, organization_id, user_id, decided_at as valid_at,
  case id % 3 when 1 then decided_at + INTERVAL '12' HOUR when 2 then decided_at - INTERVAL '6' HOUR end as known_at from dec)"""
_AT = """l.valid_from <= a.valid_at and (a.known_at is null or l.recorded_at <= a.known_at)
  and (l.valid_until is null or l.valid_until > a.valid_at or coalesce(l.valid_until_recorded_at > a.known_at, false))"""


def _fact_asks(s, d):
    """Every fact asked for its history as known on two days."""
    facts = led(s, d).select("organization_id", "fact_id", "entity_type", "external_id").distinct()
    days = F.explode(F.array(F.lit("2024-01-10"), F.lit("2024-01-20"))).alias("day")
    return facts.select("*", days).select(
        "*", F.concat_ws("@", "fact_id", "day").alias("ask_id"), F.col("day").cast("timestamp").alias("known_at")
    )


_FACT_ASKS = """fa as (
 select fact_id || '@' || day as ask_id, f.organization_id, f.fact_id, f.user_id, cast(day as timestamp) as known_at
 from (select distinct organization_id, fact_id, user_id from led) f, (values ('2024-01-10'), ('2024-01-20')) v(day))"""


def _history(s, d):
    return _row(tq.history(led(s, d), _fact_asks(s, d)), "ask_id")


def _entity_asks(s, d):
    users = led(s, d).select("organization_id", "entity_type", "external_id").distinct()
    return users.select("*", F.concat(F.lit("u"), "external_id").alias("ask_id"), F.lit("2024-01-18").cast("timestamp").alias("known_at"))


def _timeline(s, d):
    return _row(tq.timeline(led(s, d), _entity_asks(s, d)), "ask_id")


def _change_asks(s, d):
    a = dec(s, d)
    return a.select(
        F.col("id").alias("ask_id"), "organization_id", F.lit("user").alias("entity_type"),
        F.col("user_id").cast("string").alias("external_id"), F.col("decided_at").alias("start_at"),
        (F.col("decided_at") + F.expr("INTERVAL '2' DAY")).alias("end_at"),
        F.when(F.col("id") % 2 == 0, F.col("decided_at") + F.expr("INTERVAL '3' DAY")).alias("known_at"),
    )


def _changes(s, d):
    c = tq.changes_between(led(s, d), _change_asks(s, d))
    return c.select("ask_id", "fact_id", "before_id", "after_id", F.col("transitions").cast("long").alias("transitions"),
                    "first_transition", "last_transition")


_CHANGES = """ca as (select id as ask_id, user_id, decided_at as start_at, decided_at + INTERVAL '2' DAY as end_at,
  case when id % 2 = 0 then decided_at + INTERVAL '3' DAY end as known_at from dec),
known as (select a.ask_id, a.start_at, a.end_at, l.fact_id, l.id, l.version, l.valid_from, l.privacy_scope,
  case when a.known_at is null or l.valid_until_recorded_at <= a.known_at then l.valid_until end as valid_until
 from ca a join led l on l.user_id = a.user_id and (a.known_at is null or l.recorded_at <= a.known_at)),
marks as (select *, valid_from <= start_at and (valid_until is null or valid_until > start_at) as b,
  valid_from <= end_at and (valid_until is null or valid_until > end_at) as e, valid_from > start_at and valid_from <= end_at as tr from known),
ch as (select ask_id, fact_id, max(case when b then id end) as before_id, max(case when e then id end) as after_id,
  count(*) filter (tr) as transitions, min(version) filter (tr) as first_transition, max(version) filter (tr) as last_transition,
  bool_and(not (b or e or tr) or privacy_scope in ('PUBLIC', 'INTERNAL', 'CONFIDENTIAL')) as all_visible
 from marks group by ask_id, fact_id having max(case when b then id end) is distinct from max(case when e then id end) or count(*) filter (tr) > 0)"""


def _lineage_summary(s, d):
    return tq.lineage_summary(led(s, d)).select("id", "version", "supersedes_id", "superseded_by", "ancestors", "descendants")


def _lineage(s, d):
    heads = tq.latest_versions(led(s, d)).select("organization_id", "id")
    return tq.lineage(led(s, d), heads).select("subject_id", "id", "version", "role", "superseded_by")


def _hidden_lineage(s, d):
    heads = tq.latest_versions(led(s, d)).select("organization_id", "id")
    shown = tq.hide_partial_lineage(tq.lineage(led(s, d), heads), led(s, d), "CONFIDENTIAL")
    return shown.groupBy("subject_id").agg(F.count(F.lit(1)).alias("shown"))


def _stretched(s, d):
    """A damaged ledger: every end moved a day later, so neighbours overlap."""
    return led(s, d).withColumn("valid_until", F.col("valid_until") + F.expr("INTERVAL '1' DAY"))


def _visible(s, d):
    _, counts = tq.with_visibility(
        tq.facts_at_instant(led(s, d), T(), K(), revs(s, d)), "INTERNAL", ["organization_id", "external_id"]
    )
    return counts


def _memberships(s, d):
    """Three members of each tenant: one of every role, the viewer inactive in odd tenants."""
    orgs = led(s, d).select("organization_id").distinct()
    roles = F.explode(F.array(*[F.lit(r) for r in ("ADMIN", "ENGINEER", "VIEWER")])).alias("role")
    m = orgs.select("organization_id", roles)
    return m.select(
        "organization_id", F.concat(F.lower("role"), F.lit("-"), F.col("organization_id").cast("string")).alias("user_id"), "role",
        (~((F.col("role") == "VIEWER") & (F.col("organization_id") % 2 == 1))).alias("is_active"),
    )


def _access_requests(s, d):
    """One request per event: a rotating member asks for a rotating permission, some with a token."""
    e = fx.table(s, d, "events")
    pick = lambda c, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (c % len(xs) + 1).cast("int"))
    i, org = F.col("event_id"), F.col("user_id") % 4
    return e.select(
        i.alias("request_id"), org.alias("organization_id"),
        F.concat(pick(i, "admin", "engineer", "viewer", "stranger"), F.lit("-"), org.cast("string")).alias("user_id"),
        pick(F.floor(i / 4), "facts:read", "facts:write", "members:manage", "decisions:record", "audit:read").alias("permission"),
        F.when(i % 7 == 0, F.array(F.lit("facts:read"), F.lit("facts:write"))).alias("token_scopes"),
    )


def _authorize(s, d):
    ok, no = access.authorize(_access_requests(s, d), _memberships(s, d))
    return ok.select("request_id", "role", F.lit("allowed").alias("outcome")).unionByName(
        no.select("request_id", "role", F.col("reason").alias("outcome"))
    )


_AUTHORIZE = """
with req as (select event_id as request_id, user_id % 4 as org, (['admin','engineer','viewer','stranger'])[event_id % 4 + 1] as who,
  (['facts:read','facts:write','members:manage','decisions:record','audit:read'])[(event_id // 4) % 5 + 1] as permission, event_id % 7 = 0 as token
 from events),
r as (select *, case when who = 'stranger' or (who = 'viewer' and org % 2 = 1) then null else upper(who) end as role from req)
select request_id, role, case when role is null then 'not_a_member'
 when not (role = 'ADMIN' or permission = 'facts:read' or (role = 'ENGINEER' and permission in ('facts:write', 'decisions:record'))) then 'role_lacks_permission'
 when token and permission not in ('facts:read', 'facts:write') then 'token_scope_lacks_permission' else 'allowed' end as outcome from r"""


def _redact(s, d):
    return access.redact(
        led(s, d).select("id", "privacy_scope", "property", "value", "version"), "INTERNAL", ["property", "value", "version"]
    )


def _max_scope(s, d):
    v = led(s, d)
    prev = v.select(*tq.FACT, (F.col("version") + 1).alias("version"), F.col("privacy_scope").alias("p"))
    j = v.join(prev, [*tq.FACT, "version"])
    return j.groupBy(max_scope(F.col("p"), F.col("privacy_scope")).alias("pair_scope")).agg(F.count(F.lit(1)).alias("pairs"))


def _scopes(s, d):
    r = _access_requests(s, d).join(_memberships(s, d), ["organization_id", "user_id"])
    cap = F.when(F.col("request_id") % 5 == 0, F.lit("PUBLIC")).when(F.col("request_id") % 5 == 1, F.lit("CONFIDENTIAL"))
    return r.select("request_id", visible_ordinal(F.col("role"), cap).alias("ceiling"))


def _stored_ledger(s, d):
    """Versions without their later ends, and the closings, appended in the stored layout; loaded for two tenants."""
    folder = f"{checkpoint_root(s)}/chronoweave/{s.sparkContext.applicationId}/ledger-{uuid.uuid4().hex}"
    kinds = {f.name: f.dataType for f in empty(s, "versions").schema.fields}
    rows = led(s, d).select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
    none = F.lit(None).cast("timestamp")
    append_versions(rows.withColumns({"valid_until": none, "valid_until_recorded_at": none}), folder)
    append_closures(
        rows.where("valid_until is not null").select(
            "organization_id", F.col("id").alias("fact_version_id"), "valid_until", F.col("valid_until_recorded_at").alias("recorded_at")
        ), folder,
    )
    return tenant_scoped(load_ledger(s, folder), ["1", "2"])


def _loaded(s, d):
    v = _stored_ledger(s, d).versions
    return flat(v.select("organization_id", "id", "fact_id", "version", "valid_until", "valid_until_recorded_at", "supersedes_id"))


def _loaded_facts(s, d):
    """A question to the loaded tenants: what was valid at the instant, by latest knowledge."""
    return flat(tq.facts_at_instant(_stored_ledger(s, d).versions, T(), None, None).select("id", "fact_id", "version", "valid_until"))


QUERIES = {
    "io1_load_two_tenants": (
        _loaded,
        sql(
            f"""select cast(organization_id as varchar) as organization_id, cast(id as varchar) as id, fact_id, version, {t('valid_until')} as valid_until,
 {t('valid_until_recorded_at')} as valid_until_recorded_at, cast(supersedes_id as varchar) as supersedes_id from led where organization_id in (1, 2)""", "led",
        ),
    ),
    "pv3_tenant_facts_from_store": (
        _loaded_facts,
        sql(
            f"""select cast(id as varchar) as id, fact_id, version, {t('valid_until')} as valid_until from led where organization_id in (1, 2)
 and valid_from <= TIMESTAMP '{T_TEXT}' and (valid_until is null or valid_until > TIMESTAMP '{T_TEXT}')""", "led",
        ),
    ),
    "tq11_versions_by_id": (
        lambda s, d: flat(
            tq.versions_by_id(led(s, d), revs(s, d).select("organization_id", F.col("fact_version_id").alias("id")))
            .select("organization_id", "id", "fact_id", "version", "value", "valid_from", "recorded_at")
        ),
        sql(
            f"""select organization_id, id, fact_id, version, value, {t('valid_from')} as valid_from, {t('recorded_at')} as recorded_at from led
 where id in (select fact_version_id from revs)""", "revs",
        ),
    ),
    "io1_ledger_versions": (
        lambda s, d: _row(led(s, d)),
        sql(f"select {_ROW}, {t('valid_until')} as valid_until, {t('valid_until_recorded_at')} as valid_until_recorded_at from led", "led"),
    ),
    "tq1_valid_at_latest_knowledge": (
        lambda s, d: flat(tq.facts_at_instant(led(s, d), T(), None, revs(s, d)).select("id", "fact_id", "version", "valid_until")),
        sql(
            f"""select id, fact_id, version, {t('valid_until')} as valid_until from led where valid_from <= TIMESTAMP '{T_TEXT}'
 and (valid_until is null or valid_until > TIMESTAMP '{T_TEXT}') and id not in (select fact_version_id from revs)""", "revs",
        ),
    ),
    "tq2_not_revoked": (
        lambda s, d: tq.not_revoked(led(s, d), revs(s, d), K()).groupBy("organization_id").agg(F.count(F.lit(1)).alias("versions"), F.sum("id").alias("ids")),
        sql(f"select organization_id, count(*) as versions, cast(sum(id) as bigint) as ids from led where {STANDING} group by 1", "revs"),
    ),
    "tq3_as_known": (
        lambda s, d: flat(tq.as_known(led(s, d), K()).select("id", "valid_until", "valid_until_recorded_at")),
        sql(
            f"""select id, case when valid_until_recorded_at <= TIMESTAMP '{K_TEXT}' then {t('valid_until')} end as valid_until,
 case when valid_until_recorded_at <= TIMESTAMP '{K_TEXT}' then {t('valid_until_recorded_at')} end as valid_until_recorded_at from led""", "led",
        ),
    ),
    "tq4_facts_at_instant": (
        lambda s, d: _row(tq.facts_at_instant(led(s, d), T(), K(), revs(s, d))),
        sql(
            f"""select {_ROW}, case when valid_until_recorded_at <= TIMESTAMP '{K_TEXT}' then {t('valid_until')} end as valid_until,
 case when valid_until_recorded_at <= TIMESTAMP '{K_TEXT}' then {t('valid_until_recorded_at')} end as valid_until_recorded_at
 from led where {VALID} and {STANDING}""", "revs",
        ),
    ),
    "tq4_facts_at_asks": (
        lambda s, d: flat(tq.facts_at(led(s, d), _asks(s, d), revs(s, d)).select("ask_id", "id", "fact_id", "version", "valid_until")),
        sql(
            f"""with {_ASKS}
select a.ask_id, l.id, l.fact_id, l.version, {t(MASKED('valid_until', 'a.known_at', 'l.'))} as valid_until
 from asks a join led l on l.user_id = a.user_id and {_AT} left join revs r on r.fact_version_id = l.id
 where r.fact_version_id is null or coalesce(r.revoked_at > a.known_at, false)""", "dec", "led", "revs",
        ),
    ),
    "tq5_ambiguous_facts": (
        lambda s, d: tq.ambiguous(_stretched(s, d), T(), K(), revs(s, d)),
        sql(
            f"""select organization_id, fact_id, count(*) as matches, min(version) as first_version, max(version) as last_version
 from (select * replace (valid_until + INTERVAL '1' DAY as valid_until) from led) l where {VALID} and {STANDING} group by 1, 2 having count(*) > 1""", "revs",
        ),
    ),
    "tq6_history_as_known": (
        _history,
        sql(
            f"""with {_FACT_ASKS}
select ask_id, l.organization_id, id, l.fact_id, property, version, value, {t('valid_from')} as valid_from, {t('recorded_at')} as recorded_at,
 {t(MASKED('valid_until'))} as valid_until, {t(MASKED('valid_until_recorded_at'))} as valid_until_recorded_at
 from fa join led l on l.fact_id = fa.fact_id where recorded_at <= known_at""", "led",
        ),
    ),
    "tq7_changes_between": (
        _changes,
        sql(f"with {_CHANGES}\nselect ask_id, fact_id, before_id, after_id, transitions, first_transition, last_transition from ch", "dec", "led"),
    ),
    "tq7_transitions": (
        lambda s, d: tq.transitions_of(led(s, d), tq.changes_between(led(s, d), _change_asks(s, d))).select("ask_id", "id", "version"),
        sql(f"with {_CHANGES}\nselect ask_id, id, version from marks where tr", "dec", "led"),
    ),
    "tq8_lineage_summary": (
        _lineage_summary,
        sql(
            """select id, version, supersedes_id, lead(id) over w as superseded_by, version - 1 as ancestors,
 count(*) over (partition by fact_id) - version as descendants from led window w as (partition by fact_id order by version)""", "led",
        ),
    ),
    "tq8_lineage_of_current": (
        _lineage,
        sql(
            """with h as (select fact_id, max_by(id, version) as subject_id, max(version) as top from led group by 1)
select subject_id, id, version, 'ancestor' as role, version = top + 1 as superseded_by from h join led using (fact_id) where version <> top""", "led",
        ),
    ),
    "tq9_entity_timeline": (
        _timeline,
        sql(
            f"""with a as (select *, TIMESTAMP '2024-01-18 00:00:00' as known_at from led)
select 'u' || external_id as ask_id, {_ROW}, {t(MASKED('valid_until'))} as valid_until,
 {t(MASKED('valid_until_recorded_at'))} as valid_until_recorded_at from a where recorded_at <= known_at""", "led",
        ),
    ),
    "tq10_latest_versions": (
        lambda s, d: _row(tq.latest_versions(led(s, d))),
        sql(
            f"""select {_ROW}, cast(null as varchar) as valid_until, cast(null as varchar) as valid_until_recorded_at
 from led where valid_until is null""", "led",
        ),
    ),
    "tq11_versions_of_facts": (
        lambda s, d: tq.versions_of(
            led(s, d), led(s, d).where("privacy_scope = 'RESTRICTED'").select("organization_id", "fact_id").distinct()
        ).groupBy("fact_id").agg(F.count(F.lit(1)).alias("versions"), F.sum("id").alias("ids")),
        sql(
            """select fact_id, count(*) as versions, cast(sum(id) as bigint) as ids from led
 where fact_id in (select fact_id from led where privacy_scope = 'RESTRICTED') group by 1""", "led",
        ),
    ),
    "tq12_visible_and_withheld": (
        _visible,
        sql(
            f"""select organization_id, external_id, count(*) filter ({ordinal('privacy_scope')} <= 1) as shown,
 count(*) filter ({ordinal('privacy_scope')} > 1) as withheld_by_privacy_scope from led where {VALID} and {STANDING} group by 1, 2""", "revs",
        ),
    ),
    "tq13_hide_partial_changes": (
        lambda s, d: tq.hide_partial_changes(led(s, d), tq.changes_between(led(s, d), _change_asks(s, d)), "CONFIDENTIAL").select("ask_id", "fact_id"),
        sql(f"with {_CHANGES}\nselect ask_id, fact_id from ch where all_visible", "dec", "led"),
    ),
    "tq13_hide_partial_lineage": (
        _hidden_lineage,
        sql(
            """with f as (select fact_id, max_by(id, version) as subject_id, count(*) as n, bool_or(privacy_scope = 'RESTRICTED') as hidden from led group by 1)
select subject_id, n - 1 as shown from f where n > 1 and not hidden""", "led",
        ),
    ),
    "pv1_visible_scopes": (
        _scopes,
        """with req as (select event_id as request_id, user_id % 4 as org, (['ADMIN','ENGINEER','VIEWER','STRANGER'])[event_id % 4 + 1] as role from events)
select request_id, cast(least(case role when 'ADMIN' then 3 when 'ENGINEER' then 2 else 1 end,
 case request_id % 5 when 0 then 0 when 1 then 2 else 3 end) as int) as ceiling from req where role <> 'STRANGER'""",
    ),
    "pv2_authorize": (_authorize, _AUTHORIZE.strip()),
    "pv3_tenant_scope": (
        lambda s, d: led(s, d).join(revs(s, d).select("organization_id", F.col("fact_version_id").alias("id")), ["organization_id", "id"])
        .groupBy("organization_id").agg(F.count(F.lit(1)).alias("revoked")),
        sql("select organization_id, count(*) as revoked from led join revs using (organization_id, id) group by 1", "revs"),
    ),
    "pv4_max_scope": (
        _max_scope,
        sql(
            f"""with p as (select privacy_scope, lag(privacy_scope) over (partition by fact_id order by version) as before from led)
select case when {ordinal('before')} >= {ordinal('privacy_scope')} then before else privacy_scope end as pair_scope, count(*) as pairs
 from p where before is not null group by 1""", "led",
        ),
    ),
    "pv5_redact": (
        _redact,
        sql(
            f"""select id, privacy_scope, case when {ordinal('privacy_scope')} <= 1 then property end as property,
 case when {ordinal('privacy_scope')} <= 1 then value end as value, case when {ordinal('privacy_scope')} <= 1 then version end as version,
 {ordinal('privacy_scope')} > 1 as redacted from led""", "led",
        ),
    ),
    "pv6_members_by_role": (
        lambda s, d: access.members(_memberships(s, d)),
        """select organization_id, role, count(*) as members from (select distinct user_id % 4 as organization_id from events) o,
 (values ('ADMIN'), ('ENGINEER'), ('VIEWER')) r(role) group by 1, 2""",
    ),
}
