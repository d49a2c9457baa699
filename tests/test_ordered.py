import random

from datetime import datetime, timedelta
import pytest
from pyspark.sql import functions as F

from chronoweave.operators.ordered import (
    asof_ranks, chunked_scan, keep_top, nth_smallest, number_and_time, with_neighbours,
)


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds a third of the rows."""
    rng = random.Random(5)
    data = [("hot" if i % 3 == 0 else f"k{rng.randrange(20)}", i, rng.randrange(1000), rng.randrange(500)) for i in range(900)]
    return spark.createDataFrame(data, "key string, id long, at long, x long")


def _expected(rows):
    pdf = rows.toPandas().sort_values(["key", "at", "id"])
    g = pdf.groupby("key")
    pdf["n"] = g.cumcount() + 1
    pdf["mx"] = g["x"].cummax()
    pdf["sm"] = g["x"].cumsum()
    pdf["before"] = g["mx"].shift(1)
    pdf["top"] = g["x"].transform("max")
    return pdf


@pytest.mark.parametrize("hot_rows", [10, 100, 1_000_000])
def test_chunked_scan_equals_a_plain_scan(rows, hot_rows):
    got = chunked_scan(
        rows, ["key"], F.floor(F.col("at") / 50), [F.col("at"), F.col("id")], number="n", running_max={"mx": F.col("x")},
        max_before={"before": F.col("x")}, running_sum={"sm": F.col("x")}, key_max={"top": F.col("x")}, hot_rows=hot_rows,
    ).toPandas().set_index("id")
    want = _expected(rows).set_index("id")
    for c in ("n", "mx", "sm", "top"):
        assert got[c].to_dict() == want[c].to_dict(), c
    assert got["before"].fillna(-1).to_dict() == want["before"].fillna(-1).to_dict()


def test_chunked_scan_without_keys(rows):
    got = chunked_scan(rows, [], F.floor(F.col("id") / 64), [F.col("id")], number="n").select("id", "n").collect()
    assert all(r.n == r.id + 1 for r in got)


@pytest.mark.parametrize("chunk", [1, 2, 7, 4096])
def test_neighbours_across_blocks(spark, chunk):
    data = [("a", n, n * 10) for n in range(1, 30)] + [("b", 1, 5), ("c", 1, 1), ("c", 2, 2)]
    df = spark.createDataFrame(data, "key string, pos int, v int")
    got = {
        (r.key, r.pos): (r.p, r.f)
        for r in with_neighbours(df, ["key"], "pos", previous={"p": "v"}, following={"f": "v"}, chunk_rows=chunk).collect()
    }
    by = {(k, p): v for k, p, v in data}
    assert got == {(k, p): (by.get((k, p - 1)), by.get((k, p + 1))) for k, p, _ in data}


@pytest.mark.parametrize("hot_rows", [5, 1_000_000])
def test_number_and_time_is_strictly_increasing(spark, hot_rows):
    rng = random.Random(2)
    base = datetime(2024, 1, 1)
    data = [("h" if i % 2 else "c", i, base + timedelta(microseconds=rng.randrange(30))) for i in range(200)]
    df = spark.createDataFrame(data, "key string, id int, arrival timestamp")
    got = number_and_time(
        df, ["key"], F.floor(F.col("id") / 16), [F.col("id")], arrival="arrival", number="n", out="t", hot_rows=hot_rows
    ).select("key", "id", "n", F.unix_micros("arrival").alias("a"), F.unix_micros("t").alias("t")).collect()
    for key in ("h", "c"):
        last, n = None, 0
        for r in sorted((r for r in got if r.key == key), key=lambda r: r.id):
            n += 1
            want = r.a if last is None else max(r.a, last + 1)
            assert (r.n, r.t) == (n, want)
            last = want


@pytest.mark.parametrize("hot_rows", [4, 1_000_000])
def test_asof_ranks(spark, hot_rows):
    rng = random.Random(3)
    base = datetime(2024, 1, 1)
    hours = lambda h: base + timedelta(hours=h)
    versions, times = [], {}
    for key, n in (("hot", 60), ("x", 3), ("y", 1)):
        hs = sorted(rng.sample(range(0, 200), n))
        times[key] = hs
        versions += [(key, i + 1, hours(h)) for i, h in enumerate(hs)]
    probes = [(i, rng.choice(["hot", "hot", "x", "y"]), rng.randrange(-5, 210)) for i in range(150)]
    v = spark.createDataFrame(versions, "key string, version int, at timestamp")
    p = spark.createDataFrame([(i, k, hours(h)) for i, k, h in probes] + [(999, "x", None)], "pid int, key string, when timestamp")
    p = p.withColumn("sure", F.coalesce("when", F.lit("2030-01-01").cast("timestamp")))
    got = {r.pid: r.r for r in asof_ranks(p, v, ["key"], {"r": ("when", "at"), "again": ("sure", "at")}, "version", hot_rows=hot_rows).collect()}
    assert got.pop(999) is None
    assert got == {i: sum(t <= h for t in times[k]) for i, k, h in probes}


def test_nth_smallest_is_exact(rows):
    got = {
        r.key: r.v
        for r in nth_smallest(rows, ["key"], "x", F.floor(F.col("__total") / 2) + 1, "v", chunk=F.floor(F.col("x") / 10), hot_rows=20).collect()
    }
    want = {k: sorted(g["x"])[len(g) // 2] for k, g in rows.toPandas().groupby("key")}
    assert got == want


def test_keep_top_cuts_before_the_shuffle(rows):
    top = keep_top(rows, ["key"], [F.col("x").desc(), F.col("id")], 3, "r")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert top.groupBy("key").count().agg(F.max("count")).first()[0] == 3
