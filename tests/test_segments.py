"""Segments and the bucketed search tables against the plain operators and brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_retrieval import VERSION

from chronoweave.operators import embedding as em, retrieval as rt, segments as sg
from chronoweave.sources.search_store import SearchStore

T = datetime(2024, 1, 1)
WORDS = ["red", "green", "blue", "stone", "river", "cloud"]


def ledger(spark, n=400, seed=1):
    """Versions of every length, some closed late, some open, two tenants of which one holds most."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        start = T + timedelta(hours=draw.randint(0, 2000))
        end = None if draw.random() < 0.3 else start + timedelta(minutes=draw.choice([1, 30, 600, 5000, 60000]))
        learned = None if end is None else end + timedelta(hours=draw.choice([0, 1, 300]))
        rows.append((
            "big" if draw.random() < 0.8 else "small", i, f"f{i}", draw.choice(["user", "order_item"]), f"e{i % 40}", draw.choice(WORDS), 1,
            f'"{" ".join(draw.choices(WORDS, k=draw.randint(0, 5)))}"', str(i % 5), start, end, start + timedelta(hours=draw.randint(0, 50)), learned,
            draw.randint(0, 100), draw.randint(0, 1000) / 1000, draw.choice(["PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED"]),
        ))
    versions = spark.createDataFrame(rows, VERSION.replace("confidence decimal(4,3)", "confidence double")).withColumn("confidence", F.col("confidence").cast("decimal(4,3)"))
    gone = versions.where("id % 17 = 0").select("organization_id", F.col("id").alias("fact_version_id"), (F.col("recorded_at") + F.expr("INTERVAL '3' DAY")).alias("revoked_at"))
    return versions, gone


def asks(spark, n=60, seed=2):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        at = T + timedelta(hours=draw.randint(-10, 2500))
        rows.append((
            f"q{i}", draw.choice(["big", "small", "none"]), " ".join(draw.choices([*WORDS, "order", "e7", "unknown"], k=draw.randint(1, 4))), at,
            None if draw.random() < 0.5 else at + timedelta(hours=draw.randint(-50, 400)), draw.choice(["VIEWER", "ENGINEER", "ADMIN"]), draw.choice([1, 3, 50]),
            "user" if draw.random() < 0.2 else None, ["e7", "e8", "no"] if draw.random() < 0.2 else None, ["red", "blue"] if draw.random() < 0.2 else None,
            ["1", "3"] if draw.random() < 0.2 else None, 40 if draw.random() < 0.2 else None, 0.5 if draw.random() < 0.2 else None,
        ))
    schema = (
        "question_id string, organization_id string, query string, valid_at timestamp, known_at timestamp, role string, limit int, entity_type string, "
        "external_ids array<string>, properties array<string>, source_ids array<string>, min_authority int, min_confidence double"
    )
    q, bad = rt.normalize_questions(spark.createDataFrame(rows, schema))
    assert not bad.count()
    return q


@pytest.mark.parametrize(("size", "room"), [(16, 1 << 25), (64, 1), (4096, 1 << 25)])
def test_segments_give_what_the_joins_give(spark, tmp_path, monkeypatch, size, room):
    monkeypatch.setattr(sg, "QUESTION_BLOCK", 25)
    versions, gone = ledger(spark)
    rows, docs, q = rt.searchable(versions, gone), em.build_search_docs(versions), asks(spark)
    segments = sg.build(rows, docs, f"{tmp_path}/segments", size=size)
    assert segments.agg(F.sum("n")).first()[0] == 400 and segments.agg(F.max("n")).first()[0] <= size
    order = ["question_id", "organization_id", "id", "text_score", "text_rank"]
    want = sorted(rt.text_hits(rows, docs, q).select(*order).collect())
    asked = rt.asked_of_segments(q)
    got = sg.text_hits(sg.read(spark, f"{tmp_path}/segments"), asked, rt.MAX_POOL, question_bytes=room)
    assert sorted(got.select(*order).collect()) == want and want
    counts = {r.question_id: r.n for r in sg.eligible_counts(segments, asked, question_bytes=room).groupBy("question_id").agg(F.sum("versions").alias("n")).collect()}
    pairs = rows.join(q.select("question_id", "organization_id", *[F.col(c).alias(f"q_{c}") for c in rt._ASK_SIDE]), "organization_id").where(rt.eligible_pair())
    assert counts == {r.question_id: r["count"] for r in pairs.groupBy("question_id").count().collect()}


def test_bounds_and_full_pools_save_work(spark, tmp_path):
    """A long history of closed versions: who asks for now meets the open ones, and a full pool passes blocks over."""
    versions = spark.range(6000).selectExpr(
        "'a' as organization_id", "id", "concat('f', id) as fact_id", "'user' as entity_type", "concat('u', id % 7) as external_id", "'click' as property", "1 as version",
        "'1' as value", "'s' as source_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, id) as valid_from",
        "case when id % 2000 <> 0 then timestamp'2024-01-01' + make_interval(0, 0, 0, 0, id + 1 + id % 100) end as valid_until", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, id) as recorded_at",
        "case when id % 2000 <> 0 then timestamp'2024-01-01' + make_interval(0, 0, 0, 0, id + 1 + id % 100) end as valid_until_recorded_at",
        "50 as authority", "cast(0.5 as decimal(4,3)) as confidence", "'PUBLIC' as privacy_scope",
    )
    rows = rt.searchable(versions, None)
    segments = sg.build(rows, em.build_search_docs(versions), f"{tmp_path}/s", size=200)
    q = spark.createDataFrame([("now", "a", "click", datetime(2026, 1, 1), None), ("then", "a", "click", datetime(2024, 3, 1), None)], "question_id string, organization_id string, query string, valid_at timestamp, known_at timestamp")
    q, _ = rt.normalize_questions(q.withColumn("limit", F.lit(1)))
    work = {r.question_id: r for r in sg.text_work(segments, rt.asked_of_segments(q)).groupBy("question_id").agg(F.sum("versions").alias("v"), F.sum("looked").alias("l")).collect()}
    assert work["now"].v <= 200 and work["then"].v <= 6000 / 4
    whole = sg.build(rows, em.build_search_docs(versions), f"{tmp_path}/w", size=6000)
    for frame in (segments, whole):
        hits = sg.text_hits(frame, rt.asked_of_segments(q), rt.MAX_POOL).collect()
        assert {r.id for r in hits if r.question_id == "now"} == {0, 2000, 4000}
    open_ended = versions.withColumn("valid_until", F.lit(None).cast("timestamp")).withColumn("valid_until_recorded_at", F.lit(None).cast("timestamp"))
    one = sg.build(rt.searchable(open_ended, None), em.build_search_docs(open_ended), f"{tmp_path}/o", size=6000)
    full = sg.text_work(one, rt.asked_of_segments(q)).where("question_id = 'now'").first()
    assert full.held == 6000 and full.looked <= 2 * sg.POSTING_BLOCK


def test_segments_of_nothing(spark, tmp_path):
    versions, gone = ledger(spark, 20)
    none = sg.build(rt.searchable(versions.limit(0), gone), em.build_search_docs(versions.limit(0)), f"{tmp_path}/n")
    assert sg.text_hits(none, rt.asked_of_segments(asks(spark, 5)), rt.MAX_POOL).count() == 0
    some = sg.build(rt.searchable(versions, None), em.build_search_docs(versions), f"{tmp_path}/s")
    assert sg.text_hits(some, rt.asked_of_segments(asks(spark, 5)).limit(0), rt.MAX_POOL).count() == 0


def test_store_joins_without_a_shuffle_and_grows(spark, tmp_path):
    versions, gone = ledger(spark, 200)
    store = SearchStore(spark, f"{tmp_path}/store", buckets=4)
    store.append_versions(versions.where("id < 120"))
    first = store.embed(dims=16)
    store.append_versions(versions)
    assert sum(r.versions for r in first.collect()) == 120 and sum(r.versions for r in store.embed(dims=16).collect()) == 80
    assert sum(r.versions for r in store.embed(dims=16).collect() or []) == 0
    again = SearchStore(spark, f"{tmp_path}/store", buckets=4)
    for kind in ("versions", "docs", "vectors"):
        spark.sql(f"DROP TABLE {again._name(kind)}")  # as in a later session: the files stay
    assert again.versions().count() == again.docs().count() == again.vectors().count() == 200
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = again.vectors().select("organization_id", F.col("fact_version_id").alias("id"), "embedding")
        joined = again.versions().join(held, ["organization_id", "id"]).join(again.docs(), ["organization_id", "id"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        missing = em.missing_embeddings(again.versions(), again.vectors(), em.HASH_MODEL)
        assert "Exchange" not in missing._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    texts = em.render_documents(versions).groupBy("organization_id", "content_sha256").count().count()
    assert again.vectors().select("organization_id", "content_sha256", F.col("embedding").cast("string")).distinct().count() == texts
    rows = rt.searchable(again.versions(), gone)
    q = asks(spark, 20).withColumn("vector", em.hash_embed(F.split("query", " "), 16))
    hits = rt.vector_hits(rows, again.vectors(), q, model=em.HASH_MODEL, dims=16)
    plain, _ = em.embed_missing(versions, again.vectors().limit(0), dims=16)
    want = rt.vector_hits(rt.searchable(versions, gone), plain, q, model=em.HASH_MODEL, dims=16)
    order = ["question_id", "id", "vector_distance", "vector_rank"]
    assert sorted(hits.select(*order).collect()) == sorted(want.select(*order).collect())


@pytest.mark.parametrize("room", [1 << 25, 1])
def test_a_full_pool_of_earlier_segments_is_the_least_to_beat(spark, tmp_path, room):
    """Many segments of one task: exact, and no segment tells again what an earlier one has beaten."""
    versions, gone = ledger(spark, 600, seed=9)
    versions = versions.withColumn("valid_until", F.lit(None).cast("timestamp"))
    rows, docs = rt.searchable(versions, gone), em.build_search_docs(versions)
    q = asks(spark, 80, seed=4).withColumn("pool", F.lit(5))
    want = rt._joined_text_hits(rows, docs, q)
    asked = rt.asked_of_segments(q)
    segments = sg.build(rows, docs, f"{tmp_path}/s", size=20)
    order = ["question_id", "organization_id", "id", "text_score", "text_rank"]
    got = sg.text_hits(segments, asked, rt.MAX_POOL, question_bytes=room)
    assert sorted(got.select(*order).collect()) == sorted(want.select(*order).collect()) and want.count()
    again = rt.text_hits(rows, docs, q)
    assert sorted(again.select(*order).collect()) == sorted(want.select(*order).collect())


def test_beyond_the_room_no_segment_is_copied(spark, tmp_path):
    """Questions go to the segments of a task; segments are not sent once for every block of questions."""
    versions, gone = ledger(spark)
    segments = sg.build(rt.searchable(versions, gone), em.build_search_docs(versions), f"{tmp_path}/s", size=16)
    asked = rt.asked_of_segments(asks(spark))
    plan = sg.eligible_counts(segments, asked, question_bytes=1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "broadcast" in plan  # the questions and the bounds; the segments' rows meet nothing before the groups


def test_a_least_score_and_id_must_be_beaten(spark, tmp_path):
    versions, _ = ledger(spark, 300, seed=3)
    versions = versions.withColumn("organization_id", F.lit("a")).withColumn("valid_until", F.lit(None).cast("timestamp"))
    build = sg.build(rt.searchable(versions, None), em.build_search_docs(versions), f"{tmp_path}/s", size=4096)
    segment = sg.Segment(build.repartition(1).toArrow().combine_chunks().to_batches()[0], 0)
    q = {"pool": 300, "tokens": ["red", "stone"], "valid_us": sg.FAR - 1, "known_us": None, "ceiling": 3, "min_authority": None, "min_confidence": None,
         "entity_type": None, "external_ids": None, "properties": None, "source_ids": None}
    docs, scores, _ = segment.text_hits(q)
    every = sorted(zip((-scores).tolist(), segment.numbers()[docs].tolist(), strict=True))
    for cut in (0, 3, len(every) // 2, len(every) - 1):
        least = -every[cut][0], every[cut][1]
        docs, scores, _ = segment.text_hits(q, least)
        assert sorted(zip((-scores).tolist(), segment.numbers()[docs].tolist(), strict=True)) == every[:cut]


def test_rows_that_come_twice_add_up(spark):
    """Where an id comes twice, the tokens of its rows add up, as before."""
    versions, gone = ledger(spark, 100)
    twice = versions.unionByName(versions.where("id < 30"))
    rows, docs, q = rt.searchable(twice, gone), em.build_search_docs(twice), asks(spark, 20)
    order = ["question_id", "organization_id", "id", "text_score", "text_rank"]
    want = sorted(rt._joined_text_hits(rows, docs, q).select(*order).collect())
    assert sorted(rt.text_hits(rows, docs, q).select(*order).collect()) == want and want


def test_a_scope_nobody_knows_is_seen_by_none(spark, tmp_path):
    versions, _ = ledger(spark, 40)
    odd = versions.withColumn("privacy_scope", F.lit("SECRET"))
    segments = sg.build(rt.searchable(odd, None), em.build_search_docs(odd), f"{tmp_path}/s")
    assert segments.count() and sg.text_hits(segments, rt.asked_of_segments(asks(spark, 20)), rt.MAX_POOL).count() == 0


def test_a_group_of_segments_tells_one_pool(spark, tmp_path, monkeypatch):
    """What later segments of a task beat is not sent: a question's hits of a group are its pool at most."""
    versions, gone = ledger(spark, 600, seed=9)
    versions = versions.withColumn("valid_until", F.lit(None).cast("timestamp"))
    rows, docs = rt.searchable(versions, gone), em.build_search_docs(versions)
    asked = rt.asked_of_segments(asks(spark, 80, seed=4).withColumn("pool", F.lit(5)))
    segments = sg.build(rows, docs, f"{tmp_path}/s", size=20)
    sent, real = [], sg.keep_top
    monkeypatch.setattr(sg, "keep_top", lambda df, *a: sent.append(df.groupBy("question_id").count().agg(F.max("count")).first()[0]) or real(df, *a))
    assert sg.text_hits(segments, asked, rt.MAX_POOL, question_bytes=1).count() and sent == [5]


def test_many_questions_of_a_group_are_dealt_out(spark, tmp_path, monkeypatch):
    """More questions than one task should answer go to several, each with the segments of their group."""
    versions, gone = ledger(spark)
    segments = sg.build(rt.searchable(versions, gone), em.build_search_docs(versions), f"{tmp_path}/s", size=16)
    asked = rt.asked_of_segments(asks(spark))
    want = sorted(sg.text_hits(segments, asked, rt.MAX_POOL).collect())
    monkeypatch.setitem(sg.meet.__kwdefaults__, "group_questions", 7)
    assert sorted(sg.text_hits(segments, asked, rt.MAX_POOL, question_bytes=1).collect()) == want and want
    counts = lambda room: sorted(sg.eligible_counts(segments, asked, question_bytes=room).groupBy("question_id").agg(F.sum("versions")).collect())
    assert counts(1) == counts(1 << 25)


def test_segments_of_a_large_ledger_hold_more(spark, tmp_path, monkeypatch):
    versions, gone = ledger(spark, 600)
    for name, value in (("SEGMENT_ROWS", 10), ("MOST_ROWS", 50), ("SEGMENTS_A_CORE", 1), ("FILE_ROWS", 10)):
        monkeypatch.setattr(sg, name, value)
    rows, docs = rt.searchable(versions, gone), em.build_search_docs(versions)
    for cores, most in ((600 // 30, 30), (1, 50), (600, 10)):
        monkeypatch.setattr(sg, "SEGMENTS_A_CORE", cores / spark.sparkContext.defaultParallelism)
        assert sg.build(rows, docs, f"{tmp_path}/s{most}").agg(F.max("n")).first()[0] <= most


def test_many_different_filters_are_not_worked_out_for_all(spark, tmp_path, monkeypatch):
    """Filters of one question only are checked where its words lead, however many blocks those are."""
    versions, gone = ledger(spark, 400)
    segments = sg.build(rt.searchable(versions.withColumn("organization_id", F.lit("a")), gone), em.build_search_docs(versions.withColumn("organization_id", F.lit("a"))), f"{tmp_path}/s")
    monkeypatch.setattr(sg, "POSTING_BLOCK", 16)
    segment = sg.Segment(segments.drop("org_bucket").toArrow().to_batches()[0], 0)
    whole, real = [], sg.Segment.eligible
    monkeypatch.setattr(sg.Segment, "eligible", lambda self, q, docs: whole.append(isinstance(docs, slice)) or real(self, q, docs))
    for at in range(5):
        q = {"valid_us": 2**60 + at, "known_us": None, "ceiling": 3, "min_authority": None, "min_confidence": None, "pool": 400, "tokens": ["red", "user"],
             "entity_type": None, "external_ids": None, "properties": None, "source_ids": None}
        segment.text_hits(q)
    assert len(whole) > 5 and not any(whole)
