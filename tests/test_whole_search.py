"""The exact searches ask with every vector."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from chronoweave.operators import evaluation as ev, inverted_lists as il, retrieval as rt, segments as sg, vectors as vx
from chronoweave.operators.embedding import HASH_MODEL, build_search_docs
from chronoweave.plans import retrieval_queries as rq
from chronoweave.plans.common import led, revs, src
from chronoweave.session import cut_lineage


@pytest.mark.parametrize("name", ["rt6_nearest", "rt16_all_lists_probed"])
def test_every_vector_asks(spark, small, name):
    found = queries()[name](spark, small)
    vectors = spark.read.parquet(f"{small}/embeddings.parquet").count()
    assert found.select("question_id").distinct().count() == vectors
    assert "% 100" not in oracle_sql()[name]


def test_a_question_goes_to_a_bin_of_lists_once(spark, tmp_path, monkeypatch):
    """Beyond the room for questions, all lists probed by all vectors: exact, however the lists are put together."""
    rows = spark.range(600).select("id", F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.sin(F.col("id") * k * k).cast("float")).alias("embedding"))
    index = il.build(rows, f"{tmp_path}/i", 12, 6)
    asks = index.rows(spark).select(F.col("id").alias("question_id"), F.col("embedding").alias("vector"))
    order = ["question_id", "id", F.round("distance", 9).alias("distance"), "rank"]
    for gap in (3.0, 0.05):
        index.gap = gap
        want = sorted(il.search(index, asks, 4).select(*order).collect())
        for block in (20_000, 100):
            monkeypatch.setattr(il, "BLOCK_ROWS", block)
            assert sorted(il.search(index, asks, 4, question_bytes=1).select(*order).collect()) == want
        monkeypatch.undo()


def test_eligible_versions_are_counted_in_cells(spark, small):
    """No join of all versions of a tenant with all its questions: the tenant alone is the key of a broadcast only."""
    plan = queries()["rt2_eligible"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line and "q_valid_at" in line]
    assert joins and all("cell" in line or "rightHint=(strategy=broadcast)" in line for line in joins)


def test_rows_are_sent_once_to_all_questions_of_their_cell(spark):
    """Beyond the room for a broadcast, one block of rows meets all questions that see its cell; more than a task can hold are split."""
    rows = spark.range(300).select("id", F.lit("g").alias("g"), F.array(F.cos("id"), F.sin("id")).cast("array<float>").alias("embedding"))
    asked = spark.range(40).select(
        F.col("id").alias("question_id"), F.lit("g").alias("g"), F.array(F.cos(F.col("id") * 3), F.sin(F.col("id") * 3)).cast("array<float>").alias("vector"), F.lit(5).alias("pool"))

    def all_of_them(block, questions):
        assert len(questions) == 40
        return np.ones(len(questions), bool), lambda j, places: np.ones(len(places), bool)

    want = sorted(vx.nearest_blocks(rows, asked, group=["g"], dims=2).select("question_id", "id", "rank").collect())
    once = vx.nearest_blocks(rows, asked, group=["g"], dims=2, mask=all_of_them, question_bytes=1, block_rows=70)
    split = vx.nearest_blocks(rows, asked, group=["g"], dims=2, question_bytes=1, block_bytes=200, block_rows=70)
    for got in (once, split):
        assert sorted(got.select("question_id", "id", "rank").collect()) == want and len(want) == 200


def test_pairs_of_a_task_are_bounded(spark):
    """Beyond the room for a broadcast, questions that make many pairs with a block of rows are dealt to several tasks."""
    rows = spark.range(300).select("id", F.lit("g").alias("g"), F.array(F.cos("id"), F.sin("id")).cast("array<float>").alias("embedding"))
    asked = spark.range(40).select(
        F.col("id").alias("question_id"), F.lit("g").alias("g"), F.array(F.cos(F.col("id") * 3), F.sin(F.col("id") * 3)).cast("array<float>").alias("vector"), F.lit(5).alias("pool"))

    def few_of_them(block, questions):
        assert len(questions) < 30
        return np.ones(len(questions), bool), lambda j, places: np.ones(len(places), bool)

    want = sorted(vx.nearest_blocks(rows, asked, group=["g"], dims=2).select("question_id", "id", "rank").collect())
    split = vx.nearest_blocks(rows, asked, group=["g"], dims=2, mask=few_of_them, question_bytes=1, block_rows=70, block_pairs=(500, 500))
    assert sorted(split.select("question_id", "id", "rank").collect()) == want and len(want) == 200


def test_most_of_a_block_is_not_checked():
    """The nearest rows are checked first, and few others; what is found is exact, ties and rare filters included."""
    draw = np.random.default_rng(3)
    vectors = vx.unit(draw.integers(-2, 3, size=(6000, 6)) + 0.01)
    asked, ids = vx.unit(draw.normal(size=(5, 6))), draw.permutation(6000)
    for share in (0.7, 0.002, 0.0):
        open_to = draw.random((5, 6000)) < share
        checked = []

        def allowed(j, places, open_to=open_to, checked=checked):
            checked.append(len(places))
            return open_to[j, places]

        who, found, _ = vx.pick_nearest(ids, vectors, np.arange(5), asked, 20, np.full(5, np.inf), allowed)
        for j in range(5):
            some = np.flatnonzero(open_to[j])
            exact = np.round(1 - (vectors[some] * asked[j]).sum(axis=1), vx.PLACES)
            assert found[who == j].tolist() == ids[some][np.lexsort((ids[some], exact))][:20].tolist()
        assert share < 0.7 or sum(checked) < 5 * 6000 / 4


def test_questions_that_differ_in_trust_only_are_searched_once(spark, monkeypatch, small):
    """Three configurations of a question ask each branch once, and get what they would get alone."""
    s, d = spark, small
    plain = cut_lineage(rq.questions(s, d).orderBy("question_id").limit(30))
    seen = {}
    for name in ("text_hits", "vector_hits"):
        real = getattr(rt, name)
        monkeypatch.setattr(rt, name, lambda *a, _real=real, _name=name, **k: seen.update({_name: a[2].count()}) or _real(*a, **k))
    run = lambda q: rt.search(
        led(s, d), src(s, d), q, revocations=revs(s, d), embeddings=rq.embedded(s, d), docs=rq.docs(s, d), model=HASH_MODEL, dims=rq.DIMS
    ).select(F.substring_index("question_id", "#", 1).alias("q"), "id", "position", F.round("score", 9).alias("score"))
    asked = ev.with_configurations(plain)
    found = run(asked).collect()
    assert seen["text_hits"] <= 30 and seen["vector_hits"] <= plain.where("vector is not null").count()
    alone = [r for c in ev.CONFIGURATIONS for r in run(asked.where(F.col("configuration") == c)).collect()]
    assert sorted(found) == sorted(alone) and found


def test_filters_that_come_again_are_worked_out_once(spark, tmp_path, monkeypatch):
    """A segment keeps the versions that filters leave; questions with the same filters look them up."""
    versions = spark.range(900).selectExpr(
        "'a' as organization_id", "id", "concat('f', id) as fact_id", "'user' as entity_type", "concat('u', id % 7) as external_id", "'click' as property", "1 as version",
        "'1' as value", "'s' as source_id", "timestamp'2024-01-01' as valid_from", "cast(null as timestamp) as valid_until", "timestamp'2024-01-01' as recorded_at",
        "cast(null as timestamp) as valid_until_recorded_at", "cast(id % 90 as int) as authority", "cast(0.5 as decimal(4,3)) as confidence", "'PUBLIC' as privacy_scope",
    )
    segments = sg.build(rt.searchable(versions, None), build_search_docs(versions), f"{tmp_path}/s")
    segment = sg.Segment(segments.drop("org_bucket").toArrow().to_batches()[0], 0)
    calls, real = [], sg.Segment.eligible
    monkeypatch.setattr(sg.Segment, "eligible", lambda self, q, docs: calls.append(1) or real(self, q, docs))
    q = {"valid_us": 2**60, "known_us": None, "ceiling": 3, "min_authority": 45, "min_confidence": None, "pool": 40, "tokens": ["click", "u3"],
         "entity_type": None, "external_ids": None, "properties": None, "source_ids": None}
    first = [x.tolist() if hasattr(x, "tolist") else x for x in segment.text_hits(dict(q))]
    assert first[1][:2] == [2, 2]
    for _ in range(20):
        assert [x.tolist() if hasattr(x, "tolist") else x for x in segment.text_hits(dict(q))] == first
    assert len(calls) <= 2
