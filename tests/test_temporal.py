"""Golden examples and a randomised comparison with a plain model of the rules."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import temporal as tq

DAY = datetime(2026, 9, 23)
SCHEMA = (
    "organization_id string, id string, fact_id string, entity_type string, external_id string, property string, version int, "
    "value string, source_id string, valid_from timestamp, valid_until timestamp, observed_at timestamp, recorded_at timestamp, "
    "valid_until_recorded_at timestamp, supersedes_id string, authority int, confidence decimal(4,3), privacy_scope string"
)


def at(h, m=0, us=0):
    return DAY + timedelta(hours=h, minutes=m, microseconds=us)


def version(fact, n, start, end, recorded, learned, scope="INTERNAL", org="o", ext="c1"):
    return dict(
        organization_id=org, id=f"{fact}-{n}", fact_id=fact, entity_type="customer", external_id=ext, property=fact, version=n,
        value=str(n), source_id="s", valid_from=start, valid_until=end, observed_at=start, recorded_at=recorded,
        valid_until_recorded_at=learned, supersedes_id=None if n == 1 else f"{fact}-{n-1}", authority=50, confidence=None, privacy_scope=scope,
    )


def frame(spark, rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def limit(spark):
    """2000 from 10:30 (recorded 10:31), replaced by 5000 from 14:15 (recorded 16:00)."""
    return frame(
        spark,
        [version("limit", 1, at(10, 30), at(14, 15), at(10, 31), at(16)), version("limit", 2, at(14, 15), None, at(16), None)],
    )


def resolve(df, t, k, revs=None):
    K = None if k is None else F.lit(k)
    return [(r.version, r.valid_until) for r in tq.facts_at_instant(df, F.lit(t), K, revs).collect()]


def test_two_version_history(limit):
    assert resolve(limit, at(10, 30), None) == [(1, at(14, 15))]
    assert resolve(limit, at(10, 29), None) == []
    assert resolve(limit, at(14, 15), None) == [(2, None)]
    assert resolve(limit, at(15), at(15)) == [(1, None)]  # the change was not known yet
    assert resolve(limit, at(15), at(16)) == [(2, None)]
    assert resolve(limit, at(11), at(10, 30)) == []  # nothing was known yet
    assert resolve(limit, at(11), at(15)) == [(1, None)]


def test_revocation_counts_only_when_known(spark, limit):
    revs = spark.createDataFrame([("o", "limit-2", at(18))], "organization_id string, fact_version_id string, revoked_at timestamp")
    assert resolve(limit, at(17), None, revs) == []
    assert resolve(limit, at(17), at(17), revs) == [(2, None)]
    assert resolve(limit, at(17), at(18), revs) == []
    asks = spark.createDataFrame(
        [(1, "o", "customer", "c1", at(17), None), (2, "o", "customer", "c1", at(17), at(17)), (3, "o", "customer", "c1", at(17), at(18))],
        "ask_id int, organization_id string, entity_type string, external_id string, valid_at timestamp, known_at timestamp",
    )
    assert [r.ask_id for r in tq.facts_at(limit, asks, revs).collect()] == [2]


def test_other_tenant_sees_nothing(spark, limit):
    asks = spark.createDataFrame(
        [(1, "other", "customer", "c1", at(17), None)],
        "ask_id int, organization_id string, entity_type string, external_id string, valid_at timestamp, known_at timestamp",
    )
    assert tq.facts_at(limit, asks).count() == 0


def random_history(seed):
    rng = random.Random(seed)
    rows = []
    for p in range(6):
        start, recorded = at(8) + timedelta(minutes=rng.randrange(60)), None
        chain = []
        for n in range(1, rng.randint(1, 6) + 1):
            start += timedelta(minutes=rng.randint(1, 90))
            recorded = max(start + timedelta(minutes=rng.randint(0, 240)), (recorded or at(0)) + timedelta(microseconds=1))
            end = start + timedelta(minutes=rng.randint(1, 60)) if rng.random() < 0.3 else None
            if chain and chain[-1]["valid_until"] is None:
                chain[-1]["valid_until"], chain[-1]["valid_until_recorded_at"] = start, recorded
            chain.append(version(f"p{p}", n, start, end, recorded, recorded if end else None, rng.choice(["PUBLIC", "INTERNAL", "RESTRICTED"])))
            start = end or start
        rows += chain
    return rows


def model(rows, t, k):
    """The rules, row by row."""
    out = {}
    for r in rows:
        if k is not None and r["recorded_at"] > k:
            continue
        end = r["valid_until"]
        if k is not None and r["valid_until_recorded_at"] is not None and r["valid_until_recorded_at"] > k:
            end = None
        if r["valid_from"] <= t and (end is None or t < end):
            assert r["fact_id"] not in out
            out[r["fact_id"]] = (r["id"], end)
    return out


@pytest.mark.parametrize("hot_rows", [3, 1_000_000])
def test_random_histories_match_the_model(spark, hot_rows):
    rows = random_history(20260923)
    df = frame(spark, rows)
    rng = random.Random(1)
    tick = timedelta(microseconds=1)
    marks = [x for r in rows for x in (r["valid_from"], r["valid_until"], r["recorded_at"], r["valid_until_recorded_at"]) if x]
    edges = [m + d for m in marks for d in (-tick, timedelta(0), tick)]
    asks = [(i, "o", "customer", "c1", rng.choice(edges), rng.choice(edges + [None])) for i in range(250)]
    a = spark.createDataFrame(
        asks, "ask_id int, organization_id string, entity_type string, external_id string, valid_at timestamp, known_at timestamp"
    )
    got = {}
    for r in tq.facts_at(df, a, hot_rows=hot_rows).collect():
        got.setdefault(r.ask_id, {})[r.fact_id] = (r.id, r.valid_until)
    for i, _, _, _, t, k in asks:
        assert got.get(i, {}) == model(rows, t, k), (t, k)


def test_changes_match_the_model(spark):
    rows = random_history(7)
    df = frame(spark, rows)
    rng = random.Random(4)
    marks = [r["valid_from"] for r in rows] + [r["recorded_at"] for r in rows]
    asks = []
    for i in range(120):
        s, e = sorted(rng.sample(marks, 2))
        asks.append((i, "o", "customer", "c1", s, e if e > s else s + timedelta(minutes=1), rng.choice(marks + [None])))
    a = spark.createDataFrame(
        asks, "ask_id int, organization_id string, entity_type string, external_id string, start_at timestamp, end_at timestamp, known_at timestamp"
    )
    changes = tq.changes_between(df, a, hot_rows=4)
    got = {(r.ask_id, r.fact_id): (r.before_id, r.after_id, r.transitions) for r in changes.collect()}
    listed = {}
    for r in tq.transitions_of(df, changes).collect():
        listed.setdefault((r.ask_id, r.fact_id), set()).add(r.id)
    want, moved = {}, {}
    for i, _, _, _, s, e, k in asks:
        before, after = model(rows, s, k), model(rows, e, k)
        for fact in {r["fact_id"] for r in rows}:
            tr = {r["id"] for r in rows if r["fact_id"] == fact and (k is None or r["recorded_at"] <= k) and s < r["valid_from"] <= e}
            b, f = before.get(fact, (None,))[0], after.get(fact, (None,))[0]
            if b != f or tr:
                want[(i, fact)] = (b, f, len(tr))
            if tr:
                moved[(i, fact)] = tr
    assert got == want and listed == moved
    hidden = {(r.ask_id, r.fact_id) for r in tq.hide_partial_changes(df, changes, "INTERNAL").collect()}
    scope = {r["id"]: r["privacy_scope"] for r in rows}
    shown = {
        key for key, (b, f, _) in want.items()
        if all(scope[x] != "RESTRICTED" for x in {b, f, *moved.get(key, ())} - {None})
    }
    assert hidden == shown


def test_history_and_timeline_ignore_revocations_and_mask_ends(spark, limit):
    asks = spark.createDataFrame([("a", "o", "limit", at(12))], "ask_id string, organization_id string, fact_id string, known_at timestamp")
    rows = tq.history(limit, asks).collect()
    assert [(r.version, r.valid_until) for r in rows] == [(1, None)]
    full = spark.createDataFrame([("a", "o", "customer", "c1", None)], "ask_id string, organization_id string, entity_type string, external_id string, known_at timestamp")
    assert tq.timeline(limit, full).count() == 2


def test_overlaps_are_reported_not_chosen(spark):
    df = frame(spark, [version("f", 1, at(1), at(5), at(1), at(1)), version("f", 2, at(3), None, at(3), None)])
    assert [r.matches for r in tq.ambiguous(df, F.lit(at(4))).collect()] == [2]


def test_lineage(limit, spark):
    asked = spark.createDataFrame([("o", "limit-1")], "organization_id string, id string")
    rows = tq.lineage(limit, asked).collect()
    assert [(r.id, r.role, r.superseded_by) for r in rows] == [("limit-2", "descendant", True)]
    assert tq.latest_versions(limit).first().id == "limit-2"


def test_changes_by_entity_and_by_fact_agree(spark):
    """Scanned by entity, where no version is looked up again, and by fact: the same rows, asks that come twice and nulls included."""
    rows = random_history(11) + [r | {"id": r["id"] + "/2", "external_id": "c2", "fact_id": r["fact_id"] + "/2"} for r in random_history(12)]
    rows += [r | {"id": r["id"] + "/none", "fact_id": r["fact_id"] + "/none", "external_id": None} for r in random_history(13)]
    df = frame(spark, rows)
    rng = random.Random(5)
    marks = [r["valid_from"] for r in rows] + [r["recorded_at"] for r in rows] + [None]
    asks = [(i % 90 if i % 9 else None, "o", "customer", rng.choice(["c1", "c2", "c3", None]), *rng.choices(marks, k=3)) for i in range(200)]
    schema = "ask_id int, organization_id string, entity_type string, external_id string, start_at timestamp, end_at timestamp, known_at timestamp"
    a = spark.createDataFrame(asks + asks[:40], schema)
    assert tq._ends_by_entity(df, a, tq.HOT_ROWS) is not None and tq._ends_by_entity(df, a, 4) is None
    found, want = tq.changes_between(df, a), tq.changes_between(df, a, hot_rows=4)
    assert found.schema.simpleString() == want.schema.simpleString()
    order = lambda x: sorted(x.collect(), key=str)
    assert order(found) == order(want) and found.count()
    twice = df.unionByName(df.where("version % 2 = 0"))
    assert tq._ends_by_entity(twice, a, tq.HOT_ROWS) is None
    assert order(tq.changes_between(twice, a)) == order(tq.changes_between(twice, a, hot_rows=4))
    shared = df.withColumn("fact_id", F.regexp_replace("fact_id", "/2", "")).where("external_id is not null")
    assert tq._ends_by_entity(shared, a, tq.HOT_ROWS) is None


def test_changes_look_no_version_up_again(spark):
    """Asks meet their entity's facts, and changes the scan of their fact, once each."""
    df = frame(spark, random_history(7))
    at = F.lit("2024-01-01").cast("timestamp")
    a = spark.range(3).select(
        F.col("id").alias("ask_id"), F.lit("o").alias("organization_id"), F.lit("customer").alias("entity_type"), F.concat(F.lit("c"), F.col("id")).alias("external_id"),
        at.alias("start_at"), (at + F.expr("INTERVAL '9' DAY")).alias("end_at"), F.lit(None).cast("timestamp").alias("known_at"))
    changes = tq.changes_between(df, a)
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert plan(changes).count("Join ") == 1 and plan(tq.hide_partial_changes(df, changes, "INTERNAL")).count("Join ") == 2
