"""Contexts of decisions: the scan laid out by entity against the scan by fact, and receipts of ids that repeat."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from chronoweave.operators import decisions as dr
from chronoweave.operators.temporal import _facts_by_entity, facts_at
from chronoweave.plans import fixtures as fx

START = datetime(2024, 1, 1)
VERSION = (
    "organization_id long, id long, fact_id string, entity_type string, external_id string, property string, version int, value string, source_id long, "
    "valid_from timestamp, valid_until timestamp, recorded_at timestamp, valid_until_recorded_at timestamp, authority int, confidence decimal(4,3)"
)


def chains(spark, users=6, twice=False):
    rng, rows, n = random.Random(5), [], 0
    for user in range(users):
        for prop in ("a", "b"):
            starts = sorted(rng.sample(range(200), 5))
            recorded = sorted(rng.sample(range(240), 5))
            for k in range(5):
                at, ends = START + timedelta(hours=starts[k]), START + timedelta(hours=starts[k + 1]) if k < 4 else None
                known, learned = START + timedelta(hours=recorded[k]), START + timedelta(hours=recorded[k + 1]) if k < 4 else None
                row = (user % 2, n, f"{user}:{prop}", "user", str(user), prop, k + 1, str(n), n % 3, at, ends, known, learned, 50 + n % 4, 0.5)
                rows += [row] * (2 if twice and n % 7 == 0 else 1)
                n += 1
    rows.append((0, n, None, "user", "0", "a", 1, "x", 0, START, None, START, None, 50, 0.5))
    rows.append((0, n + 1, "0:a", "user", "0", "a", None, "x", 0, START, None, START, None, 50, 0.5))
    return spark.createDataFrame([(*r[:-1], Decimal("0.500")) for r in rows], VERSION)


def asks(spark, users=6):
    rows = [(100 + i, (i % users) % 2, "user", str(i % users), START + timedelta(hours=9 * i)) for i in range(30)]
    rows += [(900, 0, "user", "0", None), (901, 0, "user", None, START), (105, 1, "user", "5", START + timedelta(hours=45))]
    return spark.createDataFrame(rows, "ask_id long, organization_id long, entity_type string, external_id string, valid_at timestamp").withColumn("known_at", F.col("valid_at"))


def gone(versions):
    some = versions.where("id % 4 = 0").select("organization_id", F.col("id").alias("fact_version_id"), (F.col("recorded_at") + F.expr("interval 1 day")).alias("revoked_at"))
    return some.unionByName(some.where("id % 8 = 0").withColumn("revoked_at", F.col("revoked_at") + F.expr("interval 2 days")))


def rows_of(df):
    return sorted(map(tuple, df.select("ask_id", "id", "valid_until", "valid_until_recorded_at", "property").collect()), key=repr)


def test_by_entity_equals_by_fact(spark):
    for twice in (False, True):
        v = chains(spark, twice=twice)
        q, r = asks(spark), gone(v)
        assert _facts_by_entity(v, q, r, v.columns, 10**6) is not None
        found = rows_of(facts_at(v, q, r, same_instant=True))
        # the scan by fact drops a probe that comes twice where it has two times to look up: it is asked apart
        once = q.dropDuplicates()
        again = q.exceptAll(once)
        assert found == sorted(rows_of(facts_at(v, once, r)) + rows_of(facts_at(v, again, r)), key=repr) and found
        assert rows_of(facts_at(v, q, r, same_instant=True, hot_rows=3)) == found


def test_fact_of_two_entities(spark):
    v = chains(spark).withColumn("external_id", F.when((F.col("fact_id") == "3:a") & (F.col("version") == 2), "5").otherwise(F.col("external_id")))
    q = asks(spark).dropDuplicates()
    assert _facts_by_entity(v, q, None, v.columns, 10**6) is None
    assert rows_of(facts_at(v, q, same_instant=True)) == rows_of(facts_at(v, q))


def test_snapshots_shuffle_asks_and_versions_once(spark):
    v = chains(spark)
    dec = asks(spark).where("external_id is not null").select("organization_id", F.col("ask_id").alias("id"), F.col("external_id").cast("long").alias("user_id"), F.col("valid_at").alias("decided_at"))
    plan = fx.snapshot_facts(v, gone(v), dec)._jdf.queryExecution().executedPlan().toString()
    scanned, below = plan.split("Union", 1)
    assert "Exchange" not in scanned and below.count("REPARTITION_BY_COL") == 1  # the scan and the ranking stay where asks and versions met


def test_receipts_of_ids_that_repeat(spark):
    v = chains(spark, twice=True).withColumn("value", F.when(F.col("id") == 2, F.repeat(F.lit("9"), 40)).otherwise(F.col("value")))
    held = spark.createDataFrame([(0, 1, 0, 1), (0, 1, 1, 2), (0, 1, 2, 3), (1, 2, 10, 1)], "organization_id long, snapshot_id long, fact_version_id long, position int")
    heads = spark.createDataFrame([(0, 1), (1, 2), (1, 3)], "organization_id long, id long").select(
        "*", F.lit("q").alias("query"), F.lit(START).alias("valid_at"), F.lit(START).alias("known_at"), F.lit("m").alias("embedding_model"),
        F.lit("used").alias("vector_search"), F.array(F.lit("PUBLIC")).alias("privacy_scopes"),
    )
    d = spark.createDataFrame([(0, 7, 1), (1, 8, 2), (1, 9, 3), (0, 6, 1)], "organization_id long, id long, snapshot_id long").select(
        "*", F.lit("a.b").alias("action"), F.lit(None).cast("string").alias("agent"), F.lit(START).alias("decided_at"),
        F.lit("u").alias("decided_by_user_id"), F.lit("1").alias("outcome"), F.lit(None).cast("string").alias("rationale"),
    )
    cited = spark.createDataFrame([(0, 7, 1), (0, 7, 1), (1, 8, 10), (1, 9, 10)], "organization_id long, decision_id long, fact_version_id long")
    sealed = lambda x: sorted(map(tuple, dr.receipt_sha256(x, heads, held, cited, v).collect()))
    listed = {r["id"]: len(r["__facts"] or []) for r in dr._with_facts(d, heads.withColumnRenamed("id", "snapshot_id"), held, cited, v).collect()}
    joined = {r["id"]: len(r["__facts"]) for r in dr._joined_facts(d, held, cited, v).collect()}
    assert joined == {k: n for k, n in listed.items() if n} and listed[7] == listed[6] + 1 and listed[9] == 0
    hashes = lambda df: {(r["id"], f["fact"]["fact_version_id"], f["fact"]["value_sha256"]) for r in df.collect() for f in r["__facts"] or []}
    assert hashes(dr._with_facts(d, heads.withColumnRenamed("id", "snapshot_id"), held, cited, v)) == hashes(dr._joined_facts(d, held, cited, v))
    one = sealed(d)
    again = sealed(d.unionByName(d.where("id = 8")))  # the other path; the repeated id has other facts
    assert [r for r in one if r[1] != 8] == [r for r in again if r[1] != 8] and len(one) == 4 and len(again) == 5
    stored = d.join(dr.receipt_sha256(d, heads, held, cited, v), ["organization_id", "id"])
    lost = stored.where("id = 6").withColumn("id", F.lit(5).cast("long")).withColumn("snapshot_id", F.lit(-1).cast("long"))
    stored = stored.unionByName(lost).withColumn("action", F.when(F.col("id") == 9, "c.d").otherwise(F.col("action")))
    for rows in (stored, stored.unionByName(stored.where("id = 5"))):
        checked = dr.verify_receipts(rows, heads, held, cited, v).collect()
        assert {(r["id"], r["integrity_verified"], r["recomputed"] is None) for r in checked} == {
            (5, False, True), (6, True, False), (7, True, False), (8, True, False), (9, False, False)}


def test_tasks_follow_the_rows_scanned(spark, monkeypatch):
    v, q = chains(spark), asks(spark).withColumn("entity_type", F.lit("user"))
    whole = rows_of(facts_at(v, q, gone(v), same_instant=True))
    monkeypatch.setattr("chronoweave.operators.temporal.SCAN_ROWS", 10, raising=False)
    found = facts_at(v, q, gone(v), same_instant=True)
    assert found.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows_of(found) == whole
