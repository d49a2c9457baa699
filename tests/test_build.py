import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronoweave.ledger import with_closures
from chronoweave.operators import build, contradictions as cd, revocations as rv
from chronoweave.operators.temporal import latest_versions

BASE = datetime(2024, 1, 1)
CLAIM = (
    "organization_id string, id long, fact_id string, entity_type string, external_id string, property string, value string, "
    "source_id string, valid_from timestamp, valid_until timestamp, observed_at timestamp, arrival timestamp, authority int, "
    "confidence decimal(4,3), privacy_scope string"
)


def hours(h):
    return BASE + timedelta(hours=h)


def claim(i, fact, start, end, arrival, source="s1", value="1", observed=None):
    return (
        "o", i, fact, "user", fact, "p", value, source, hours(start), None if end is None else hours(end),
        hours(start if observed is None else observed), hours(arrival), 50, None, "INTERNAL",
    )


def model(claims):
    """Sequential planning per fact: accepted (version, closed_at), rejected ids, recorded times."""
    latest, versions, rejected = {}, {}, set()
    for c in sorted(claims, key=lambda c: (c[11], c[1])):
        fact, start, end = c[2], c[8], c[9]
        if end is not None and end <= start:
            rejected.add(c[1])
            continue
        prev = latest.get(fact)
        if prev is not None:
            p = versions[prev]
            if start <= p["from"] or (p["until"] is not None and not p["closed"] and start < p["until"]):
                rejected.add(c[1])
                continue
            recorded = max(c[11], p["recorded"] + timedelta(microseconds=1))
            if p["until"] is None:
                p["until"], p["closed"], p["learned"] = start, True, recorded
        else:
            recorded = c[11]
        versions[c[1]] = {
            "n": 1 if prev is None else versions[prev]["n"] + 1, "from": start, "until": end, "closed": False,
            "recorded": recorded, "learned": recorded if end else None, "prev": prev,
        }
        latest[fact] = c[1]
    return versions, rejected


def check(built, claims):
    versions, rejected = model(claims)
    got = {
        r.id: (r.version, r.valid_from, r.valid_until, r.recorded_at, r.valid_until_recorded_at, r.supersedes_id)
        for r in built.versions.collect()
    }
    want = {i: (v["n"], v["from"], v["until"], v["recorded"], v["learned"], v["prev"]) for i, v in versions.items()}
    assert got == want
    assert {r.id for r in built.rejects.collect()} == rejected


def random_claims(seed, n=260):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        fact = "hot" if i % 3 == 0 else f"f{rng.randrange(8)}"
        start = rng.randrange(0, 300) / 2
        end = start + rng.randrange(0, 40) if rng.random() < (0.4 if fact in ("hot", "f1", "f2") else 0.0) else None
        out.append(claim(i, fact, start, end, start * 0.7 + rng.randrange(0, 60)))
    return out


@pytest.mark.parametrize("seed,hot_rows,chunk_rows", [(1, 1_000_000, 4096), (2, 10, 4), (3, 10, 1), (4, 5, 16)])
def test_planning_equals_the_sequential_rule(spark, seed, hot_rows, chunk_rows):
    claims = random_claims(seed)
    built = build.build_versions(spark.createDataFrame(claims, CLAIM), hot_rows=hot_rows, chunk_rows=chunk_rows)
    check(built, claims)


def test_outcome_steps_equal_running_the_claims():
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randint(1, 12)
        starts = [rng.randrange(30) for _ in range(n)]
        ends = [s + rng.randint(1, 10) for s in starts]
        bounds, outs = build._outcomes(starts, ends)
        assert bounds == sorted(bounds)
        for t in range(-1, 45):
            want = t
            for s, e in zip(starts, ends):
                want = e if s >= want else want
            k = next((i for i, b in enumerate(bounds) if b >= t), None)
            assert (t if k is None else outs[k]) == want


@pytest.mark.parametrize("cut", [40.0, 75.0])
def test_building_in_two_batches_equals_one(spark, cut):
    claims = random_claims(11)
    first = [c for c in claims if c[11] < hours(cut)]
    second = [c for c in claims if c[11] >= hours(cut)]
    one = build.build_versions(spark.createDataFrame(first, CLAIM))
    heads = latest_versions(one.versions)
    two = build.build_versions(spark.createDataFrame(second, CLAIM), heads, hot_rows=5, chunk_rows=3)
    names = ["id", "version", "valid_from", "valid_until", "recorded_at", "valid_until_recorded_at", "supersedes_id", "organization_id"]
    base = one.versions.select(*names).unionByName(two.versions.select(*names))
    whole = with_closures(base, one.closures.unionByName(two.closures))
    versions, rejected = model(claims)
    got = {r.id: (r.version, r.valid_until, r.recorded_at, r.valid_until_recorded_at, r.supersedes_id) for r in whole.collect()}
    assert got == {i: (v["n"], v["until"], v["recorded"], v["learned"], v["prev"]) for i, v in versions.items()}
    assert {r.id for r in one.rejects.unionByName(two.rejects).collect()} == rejected


def test_gaps_are_fine_overlaps_are_not(spark):
    claims = [claim(1, "f", 0, 10, 0), claim(2, "f", 9, None, 1), claim(3, "f", 10, None, 2), claim(4, "f", 10, None, 3), claim(5, "f", 20, 25, 4)]
    built = build.build_versions(spark.createDataFrame(claims, CLAIM))
    check(built, claims)
    assert {r.id for r in built.rejects.collect()} == {2, 4}


def test_unknown_evidence_refuses_the_whole_claim(spark):
    df = spark.createDataFrame([claim(1, "f", 0, None, 0), claim(2, "f", 1, None, 1)], CLAIM).withColumn(
        "evidence_ids", F.when(F.col("id") == 1, F.array(F.lit("e1"), F.lit("nope"))).otherwise(F.array(F.lit("e1")))
    )
    built = build.build_versions(df, known_evidence=spark.createDataFrame([("o", "e1")], "organization_id string, id string"))
    assert [(r.id, r.version) for r in built.versions.collect()] == [(2, 1)]
    assert [(r.id, r.reason) for r in built.rejects.collect()] == [(1, "unknown_evidence")]


def test_value_conflict_rule(spark):
    rows = [
        claim(1, "a", 0, None, 0, "crm", '"ACTIVE"', observed=12), claim(2, "a", 10, None, 13, "billing", '"SUSPENDED"'),  # conflict
        claim(3, "b", 0, None, 0, "crm", "1", observed=5), claim(4, "b", 10, None, 11, "billing", "2"),  # ordinary update
        claim(5, "c", 0, None, 0, "crm", "1", observed=12), claim(6, "c", 10, None, 13, "crm", "2"),  # same source
        claim(7, "d", 0, None, 0, "crm", '{"a":1,"b":2.0}', observed=12), claim(8, "d", 10, None, 13, "erp", '{"b":2,"a":1}'),  # same value
        claim(9, "e", 0, 8, 0, "crm", "1", observed=9), claim(10, "e", 8, None, 13, "erp", "2"),  # observed after its own end
    ]
    v = build.build_versions(spark.createDataFrame(rows, CLAIM)).versions
    got = cd.value_conflicts(v, chunk_rows=1).collect()
    assert [(r.left_version_id, r.right_version_id, r.preferred_version_id) for r in got] == [(1, 2, 1)]
    assert "observed a different value at 2024-01-01T12:00:00+00:00" in got[0].explanation


def test_evidence_is_stored_once_per_source(spark):
    rows = [
        ("o", 1, "s", "DOCUMENT_EXCERPT", " same\r\ntext ", None, None, "PUBLIC", hours(2)),
        ("o", 2, "s", "DOCUMENT_EXCERPT", "same\ntext", None, None, "PUBLIC", hours(1)),
        ("o", 3, "t", "DOCUMENT_EXCERPT", "same\ntext", None, "{}", "PUBLIC", hours(1)),
        ("p", 4, "s", "DOCUMENT_EXCERPT", "same\ntext", "s3://x", None, "PUBLIC", hours(1)),
        ("o", 5, "s", "DOCUMENT_EXCERPT", "x" * 8001, None, None, "PUBLIC", hours(1)),
        ("o", 6, "s", "DOCUMENT_EXCERPT", " \n ", None, None, "PUBLIC", hours(1)),
        ("o", 7, "s", "DOCUMENT_EXCERPT", "a\x00b", None, None, "PUBLIC", hours(1)),
        ("o", 8, "s", "DOCUMENT_EXCERPT", "fine", "ftp://x", None, "PUBLIC", hours(1)),
    ]
    df = spark.createDataFrame(
        rows, "organization_id string, id int, source_id string, evidence_type string, excerpt string, uri string, metadata string, privacy_scope string, captured_at timestamp"
    )
    evidence, outcome, rejects = build.capture_evidence(df)
    assert sorted(r.id for r in evidence.collect()) == [2, 3, 4]
    assert {(r.id, r.evidence_id, r.created) for r in outcome.collect()} == {(1, 2, False), (2, 2, True), (3, 3, True), (4, 4, True)}
    assert {r.id: r.reason for r in rejects.collect()} == {5: "excerpt_too_long", 6: "empty_excerpt", 7: "excerpt_has_nul", 8: "bad_uri"}
    again, outcome, _ = build.capture_evidence(df.where("id = 1"), evidence)
    assert again.count() == 0 and [(r.evidence_id, r.created) for r in outcome.collect()] == [(2, False)]


def test_revocations_first_wins(spark):
    v = build.build_versions(spark.createDataFrame([claim(1, "f", 0, None, 0), claim(2, "f", 1, None, 1)], CLAIM)).versions
    asks = spark.createDataFrame(
        [("o", "a", "f", None, "bad", "u", hours(5)), ("o", "b", "f", 2, "bad", "u", hours(4)), ("o", "c", "f", 1, "  ", "u", hours(1)),
         ("o", "d", "g", None, "bad", "u", hours(1)), ("o", "e", "f", 9, "bad", "u", hours(1))],
        "organization_id string, id string, fact_id string, version_id long, reason string, revoked_by_user_id string, requested_at timestamp",
    )
    done, refused = rv.record_revocations(asks, v)
    assert [(r.id, r.fact_version_id) for r in done.collect()] == [("b", 2)]
    assert {r.id: r.problem for r in refused.collect()} == {
        "a": "already_revoked", "c": "bad_reason", "d": "fact_not_found", "e": "version_not_found"
    }


@pytest.mark.parametrize("chunk_rows", [4, 4096])
def test_tenants_may_use_the_same_claim_ids(spark, chunk_rows):
    claims = [c for c in random_claims(6, 80)]
    twice = claims + [("q", *c[1:]) for c in claims]
    built = build.build_versions(spark.createDataFrame(twice, CLAIM), hot_rows=10, chunk_rows=chunk_rows)
    rows = built.versions.collect()
    mine = lambda org: sorted((r.id, r.version, str(r.valid_until), str(r.recorded_at), r.supersedes_id) for r in rows if r.organization_id == org)
    alone = build.build_versions(spark.createDataFrame(claims, CLAIM)).versions.collect()
    want = sorted((r.id, r.version, str(r.valid_until), str(r.recorded_at), r.supersedes_id) for r in alone)
    assert mine("o") == mine("q") == want
    refused = built.rejects.collect()
    assert len(rows) + len(refused) == len(twice)
