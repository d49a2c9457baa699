"""Keyed state of streams: bounded reads, replays, and the streams built on it against the batch operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronoweave.streaming.keyed_log import KeyedLog


def rows(spark, values):
    return spark.createDataFrame(values, "k string, version int, v string")


def state(log, spark, keys, batch_id):
    found = log.find(spark, spark.createDataFrame([(k,) for k in keys], "k string"), batch_id)
    return None if found is None else sorted(tuple(r) for r in found.select("k", "version", "v").collect())


def read_files(log, spark, keys, batch_id):
    touched = log.touched(spark, spark.createDataFrame([(k,) for k in keys], "k string"), batch_id)
    return touched.select(F.input_file_name().alias("f")).distinct().count(), touched.count()


def test_latest_rows_by_key_and_bounded_reads(spark, tmp_path):
    log = KeyedLog(f"{tmp_path}/log", ["k"], latest="version", buckets=4, every=3)
    assert log.find(spark, spark.createDataFrame([("a",)], "k string"), 0) is None
    read = {}
    for b in range(12):
        log.append(rows(spark, [("a", b, f"a{b}"), ("b" if b % 2 else "c", b, f"x{b}")]), b)
        assert state(log, spark, ["a", "nobody"], b + 1) == [("a", b, f"a{b}")]
        read[b] = read_files(log, spark, ["a"], b + 1)
    assert state(log, spark, ["a", "b", "c"], 12) == [("a", 11, "a11"), ("b", 11, "x11"), ("c", 10, "x10")]
    assert max(n for n, _ in read.values()) <= 1 + 3 and max(r for _, r in read.values()) <= 2 * (1 + 3)
    assert read[11] <= max(read[b] for b in range(6))
    assert len(log.folders(spark, 12)) <= 4
    one = log.touched(spark, spark.createDataFrame([("a",)], "k string"), 12)
    assert one.select("bucket").distinct().count() == 1


@pytest.mark.parametrize("again", [1, 2, 3, 5])
def test_a_replayed_batch_sees_the_state_before_it(spark, tmp_path, again):
    """Whatever was written after a batch's reads, also a new base, its replay reads and leaves the same."""
    log = KeyedLog(f"{tmp_path}/log", ["k"], latest="version", buckets=2, every=2)
    before = {}
    for b in range(again + 1):
        before[b] = state(log, spark, ["a", "b"], b)
        log.append(rows(spark, [("a", b, f"first{b}"), ("b", b, "gone")] if b == again else [("a", b, f"v{b}")]), b)
    assert state(log, spark, ["a", "b"], again) == before[again]
    log.append(rows(spark, [("a", again, "second")]), again)
    assert state(log, spark, ["a", "b"], again + 1) == [("a", again, "second")]
    log.append(rows(spark, [("b", 0, "b0")]), again + 1)
    assert state(log, spark, ["a", "b"], again + 2) == [("a", again, "second"), ("b", 0, "b0")]


def test_keys_alone_and_empty_batches(spark, tmp_path):
    log = KeyedLog(f"{tmp_path}/ids", ["id"], buckets=3, every=2)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    log.append(ids(), 0)
    assert log.touched(spark, ids("a"), 1) is None
    for b, some in enumerate([("a", "b"), (), ("b", "c"), ("d",)], 1):
        log.append(ids(*some), b)
    assert sorted(r.id for r in log.find(spark, ids("a", "b", "c", "d", "e"), 9).collect()) == ["a", "b", "c", "d"]


def test_versions_of_many_batches_equal_one_batch(spark, tmp_path):
    """Claims of the same facts over many batches: heads come from compacted state, and the last batches read no more than the first."""
    from chronoweave.operators.build import build_versions
    from chronoweave.streaming.versions import VersionStore, apply_claims_batch

    start = datetime(2024, 1, 1)
    data = [
        ("o", f"c{i}", f"f{i % 5}", "user", f"u{i % 5}", "limit", f"{i}", "s", start + timedelta(hours=i), None, start + timedelta(hours=i), start + timedelta(hours=i), 50, 0.5, "PUBLIC")
        for i in range(30)
    ]
    schema = (
        "organization_id string, id string, fact_id string, entity_type string, external_id string, property string, value string, source_id string, valid_from timestamp, "
        "valid_until timestamp, observed_at timestamp, arrival timestamp, authority int, confidence double, privacy_scope string"
    )
    claims = spark.createDataFrame(data, schema).withColumn("confidence", F.col("confidence").cast("decimal(4,3)"))
    store = VersionStore(f"{tmp_path}/store", buckets=2, every=2)
    reads = []
    for b in range(6):
        part = claims.where(f"int(substr(id, 2)) div 5 = {b}")
        log = store.heads()
        reads.append(len(log.folders(spark, b)))
        apply_claims_batch(part, b, store)
    assert max(reads) <= 3
    order = ["id", "version", "valid_from", "recorded_at", "supersedes_id"]
    want = sorted(build_versions(claims).versions.select(*order).collect())
    assert sorted(store.read(spark, "versions").select(*order).collect()) == want
