import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.functions import scalars as sc
from chronoweave.functions.stemming import stem
from chronoweave.operators import embedding as em, inverted_lists as il, retrieval as rt, vectors as vx

T = datetime(2024, 1, 10)
VERSION = (
    "organization_id string, id int, fact_id string, entity_type string, external_id string, property string, version int, value string, "
    "source_id string, valid_from timestamp, valid_until timestamp, recorded_at timestamp, valid_until_recorded_at timestamp, "
    "authority int, confidence decimal(4,3), privacy_scope string"
)
DIMS = 8


def fuse(spark, vector, text, trust, weight=0.3):
    v = spark.createDataFrame([("q", "o", i, d, r) for r, (i, d) in enumerate(vector, 1)], "question_id string, organization_id string, id int, vector_distance double, vector_rank int")
    t = spark.createDataFrame([("q", "o", i, s, r) for r, (i, s) in enumerate(text, 1)], "question_id string, organization_id string, id int, text_score double, text_rank int")
    tr = spark.createDataFrame([("o", i, x) for i, x in trust.items()], "organization_id string, id int, trust double")
    q = spark.createDataFrame([("q", 10, weight)], "question_id string, limit int, trust_weight double")
    return rt.fuse(v, t, tr, q).orderBy("position").collect()


def test_a_version_found_by_both_branches_wins(spark):
    rows = fuse(spark, [(1, 0.1), (2, 0.2)], [(2, 0.5), (3, 0.4)], {1: 1.0, 2: 1.0, 3: 1.0})
    assert [r.id for r in rows] == [2, 1, 3]
    assert rows[0].rrf_score == pytest.approx(1 / 62 + 1 / 61)
    assert rows[0].score == pytest.approx(rows[0].rrf_score)


def test_trust_scales_the_score(spark):
    rows = fuse(spark, [(1, 0.1), (2, 0.2)], [], {1: 0.1, 2: 1.0}, weight=1.0)
    assert [r.id for r in rows] == [2, 1] and rows[1].score == pytest.approx(0.1 / 61)
    assert [r.id for r in fuse(spark, [(1, 0.1), (2, 0.2)], [], {}, weight=1.0)] == [1, 2]  # unknown trust counts 0, ties by id
    assert [r.id for r in fuse(spark, [(1, 0.1), (2, 0.2)], [], {1: 0.1, 2: 1.0}, weight=0.0)] == [1, 2]


def test_pool_size(spark):
    df = spark.createDataFrame([(1,), (10,), (30,), (50,)], "n int")
    assert [r[0] for r in df.select(rt.pool_size(F.col("n"))).collect()] == [40, 40, 120, 200]


@pytest.fixture(scope="module")
def world(spark):
    """Versions of two tenants with every kind of filterable difference, vectors and questions."""
    rng = random.Random(8)
    hours = lambda h: T + timedelta(hours=h)
    versions, vectors = [], []
    for i in range(240):
        start = rng.randrange(-200, 20)
        end = start + rng.randrange(1, 250) if rng.random() < 0.5 else None
        rec = start + rng.randrange(0, 30)
        versions.append(
            (rng.choice("ab"), i, f"f{i}", rng.choice(["user", "order_item"]), str(i % 7), rng.choice(["credit_limit", "click.rate"]), 1,
             str(rng.randrange(100)), f"s{i % 3}", hours(start), None if end is None else hours(end), hours(rec),
             None if end is None else hours(rng.choice([rec, end])), rng.randrange(0, 101), None, rng.choice(["PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED"]))
        )
        vectors.append((versions[-1][0], i, "m", [float(x) for x in np.random.RandomState(i).normal(size=DIMS)]))
    v = spark.createDataFrame(versions, VERSION).withColumn("confidence", ((F.col("id") % 10 + 1) / 10).cast("decimal(4,3)"))
    e = spark.createDataFrame(vectors, "organization_id string, fact_version_id int, model string, embedding array<float>")
    gone = spark.createDataFrame([(versions[i][0], i, hours(rng.randrange(-50, 50))) for i in range(0, 240, 9)], "organization_id string, fact_version_id int, revoked_at timestamp")
    asked = []
    for j in range(40):
        asked.append(
            (f"q{j:02d}", rng.choice("ab"), rng.choice(["what is the credit limit of 3", "click rates", "user 5 clicking", "the of and"]),
             hours(rng.randrange(-20, 20)), hours(rng.randrange(-20, 30)) if rng.random() < 0.6 else None, rng.choice(["VIEWER", "ENGINEER", "ADMIN"]),
             rng.choice([None, None, "user"]), rng.choice([None, ["1", "2", "3"]]), rng.choice([None, ["credit_limit"]]), rng.choice([None, ["s1"]]),
             rng.choice([None, 40]), rng.choice([None, 0.4]), rng.choice([None, "PUBLIC"]), rng.choice([None, [float(x) for x in np.random.RandomState(900 + j).normal(size=DIMS)]]))
        )
    q = spark.createDataFrame(
        asked,
        "question_id string, organization_id string, query string, valid_at timestamp, known_at timestamp, role string, entity_type string, "
        "external_ids array<string>, properties array<string>, source_ids array<string>, min_authority int, min_confidence double, "
        "max_privacy_scope string, vector array<float>",
    )
    return v, e, gone, q


def allowed(v, gone, q):
    """The hard filters, pair by pair."""
    order = ["PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED"]
    cap = {"VIEWER": 1, "ENGINEER": 2, "ADMIN": 3}[q.role]
    if q.max_privacy_scope:
        cap = min(cap, order.index(q.max_privacy_scope))
    if v.organization_id != q.organization_id or order.index(v.privacy_scope) > cap:
        return False
    K = q.known_at
    if K is not None and v.recorded_at > K or v.valid_from > q.valid_at:
        return False
    end = v.valid_until
    if end is not None and K is not None and v.valid_until_recorded_at > K:
        end = None
    if end is not None and end <= q.valid_at:
        return False
    if v.id in gone and (K is None or gone[v.id] <= K):
        return False
    return (
        (q.entity_type in (None, v.entity_type)) and (q.external_ids is None or v.external_id in q.external_ids)
        and (q.properties is None or v.property in q.properties) and (q.source_ids is None or v.source_id in q.source_ids)
        and (q.min_authority is None or v.authority >= q.min_authority) and (q.min_confidence is None or float(v.confidence) >= q.min_confidence)
    )


def expected_text(world):
    v, _, gone, q = world
    revoked = {r.fact_version_id: r.revoked_at for r in gone.collect()}
    import re

    from chronoweave.functions.stemming import STOP_WORDS

    def toks(text):
        return [stem(w) for w in re.findall("[a-z0-9]+", text.lower()) if w not in STOP_WORDS]

    out = {}
    for ask in q.collect():
        terms = set(toks(ask.query))
        scored = []
        for row in v.collect():
            words = toks(f"{row.entity_type.replace('_', ' ')} {row.external_id} {row.property.replace('_', ' ').replace('.', ' ')} {row.value}")
            n = sum(w in terms for w in words)
            if n and allowed(row, revoked, ask):
                scored.append((-n, row.id))
        out[ask.question_id] = [i for _, i in sorted(scored)][:40]
    return out


@pytest.mark.parametrize("limit", [1_000_000, 0])  # broadcast terms; both sides shuffled by salted token
def test_text_hits_match_brute_force(world, limit):
    v, _, gone, q = world
    asks, _ = rt.normalize_questions(q)
    hits = rt.text_hits(rt.searchable(v, gone), em.build_search_docs(v), asks, broadcast_bytes=limit).orderBy("question_id", "text_rank").collect()
    got = {}
    for h in hits:
        got.setdefault(h.question_id, []).append(h.id)
    assert got == {k: ids for k, ids in expected_text(world).items() if ids}


@pytest.mark.parametrize("room", [1 << 30, 1])  # one broadcast block; many blocks of questions
def test_vector_hits_match_brute_force(world, room, monkeypatch):
    v, e, gone, q = world
    monkeypatch.setattr(rt, "nearest_blocks", lambda *a, **k: vx.nearest_blocks(*a, **k, question_bytes=room, block_rows=50))
    asks, _ = rt.normalize_questions(q)
    hits = rt.vector_hits(rt.searchable(v, gone), e, asks, model="m", dims=DIMS).collect()
    got = {}
    for h in sorted(hits, key=lambda h: (h.question_id, h.vector_rank)):
        got.setdefault(h.question_id, []).append(h.id)
    vec = {r.fact_version_id: np.array(r.embedding) for r in e.collect()}
    revoked = {r.fact_version_id: r.revoked_at for r in gone.collect()}
    rows = v.collect()
    for ask in q.collect():
        want = []
        if ask.vector is not None:
            a = np.array(ask.vector)
            near = [(1 - a @ vec[r.id] / np.linalg.norm(a) / np.linalg.norm(vec[r.id]), r.id) for r in rows if allowed(r, revoked, ask)]
            want = [i for _, i in sorted(near)][:40]
        assert got.get(ask.question_id, []) == want


def test_search_end_to_end(spark, world):
    v, e, gone, q = world
    sources = spark.createDataFrame([(o, s, f"name-{s}", "API") for o in "ab" for s in ("s0", "s1", "s2")], "organization_id string, id string, name string, source_type string")
    found = rt.search(v, sources, q, revocations=gone, embeddings=e, model="m", dims=DIMS).collect()
    revoked = {r.fact_version_id: r.revoked_at for r in gone.collect()}
    by_id, asks = {r.id: r for r in v.collect()}, {r.question_id: r for r in q.collect()}
    assert found
    for f in found:
        ask = asks[f.question_id]
        assert allowed(by_id[f.id], revoked, ask) and 1 <= f.position <= 10 and f.source_name == f"name-{f.source_id}"
        assert ask.vector is not None or f.vector_rank is None
        if f.valid_until is not None and ask.known_at is not None:
            assert f.valid_until_recorded_at <= ask.known_at


def clustered(spark, n=1500, centres=12, dims=16, noise=0.3, seed=3):
    draw = np.random.default_rng(seed)
    at = draw.normal(size=(centres, dims))
    points = (at[draw.integers(0, centres, n)] + noise * draw.normal(size=(n, dims))).astype(np.float32)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "id int, embedding array<float>")


def compared(spark, index, asks, n=10):
    one = F.lit(0).alias("g")
    exact = vx.nearest(index.rows(spark).select("id", "embedding", one), asks.select("*", one), n, index.dims, ["g"])
    return vx.ann_recall(il.search(index, asks, n), exact, n).agg(F.avg("recall")).first()[0]


def files(df):
    return df.select(F.col("_metadata.file_path")).distinct().count()


def test_lists_hold_every_row_and_few_are_read(spark, tmp_path):
    rows = clustered(spark)
    index = il.build(rows, f"{tmp_path}/lists", 24, 16)
    stored = index.rows(spark)
    assert sorted(r.id for r in stored.collect()) == list(range(1500))
    asks = rows.where("id < 60").selectExpr("id as question_id", "embedding as vector")
    assert compared(spark, index, asks) >= 0.95
    probes = il.probed(index, asks)
    lists = index.centroids(spark).count()
    assert probes.count() < 0.4 * 60 * lists
    read = [files(il.read_lists(index, spark, probes.where(f"question_id < {n}"))) for n in (1, 8, 60)]
    assert read[0] < read[1] <= read[2] and read[0] < 0.4 * files(stored)
    plan = il.read_lists(index, spark, probes.where("question_id = 0"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "list" in plan
    # nothing is left out once every list is within the gap, whether the questions travel or stay
    index.gap = 3.0
    assert compared(spark, index, asks) == 1.0
    blocks = il.search(index, asks, 10, question_bytes=1).select("question_id", "id", "rank").collect()
    assert sorted(blocks) == sorted(il.search(index, asks, 10).select("question_id", "id", "rank").collect())


def test_an_index_grows_and_loads_again(spark, tmp_path):
    rows = clustered(spark)
    index = il.build(rows.where("id < 1000"), f"{tmp_path}/lists", 16, 16)
    il.append(index, rows.where("id >= 1000"))
    again = il.load(spark, f"{tmp_path}/lists")
    assert (again.gap, again.coarse, again.outer) == (index.gap, index.coarse, index.outer)
    assert again.rows(spark).count() == 1500
    asks = rows.where("id >= 1450").selectExpr("id as question_id", "embedding as vector")
    assert compared(spark, again, asks) >= 0.95


def test_where_nothing_separates_more_lists_are_probed(spark, tmp_path):
    rows = clustered(spark, 900, centres=900, noise=1.0)
    index = il.build(rows, f"{tmp_path}/lists", 30, 16)
    asks = rows.where("id < 50").selectExpr("id as question_id", "embedding as vector")
    assert compared(spark, index, asks) >= 0.9
    near = il.build(clustered(spark, 900, noise=0.1), f"{tmp_path}/near", 30, 16)
    some = clustered(spark, 900, noise=0.1).where("id < 50").selectExpr("id as question_id", "embedding as vector")
    assert il.probed(near, some).count() < il.probed(index, asks).count()


def test_lists_of_little(spark, tmp_path):
    none = spark.createDataFrame([], "id int, embedding array<float>")
    asks = spark.createDataFrame([(0, [1.0, 0.0])], "question_id int, vector array<float>")
    assert il.search(il.build(none, f"{tmp_path}/none", 4, 2), asks, 5).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)] + [(40, [0.0, 0.0])], "id int, embedding array<float>")
    index = il.build(same, f"{tmp_path}/same", 4, 2)
    assert [r.id for r in il.search(index, asks, 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert il.search(index, asks.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        il.build(same, f"{tmp_path}/many", il.MAX_LISTS + 1, 2)


def test_hash_embedding(spark):
    df = spark.createDataFrame([("a", "Credit limit, credit LIMIT"), ("b", ""), ("c", "other words")], "id string, text string")
    rows = {r.id: np.array(r.v) for r in df.select("id", em.hash_embed(sc.tokens(F.col("text")), 32).alias("v")).collect()}
    assert all(np.linalg.norm(v) == pytest.approx(1.0, abs=1e-6) for v in rows.values())
    assert rows["b"][0] == 1.0 and np.count_nonzero(rows["b"]) == 1
    sparse = df.select("id", F.explode(em.hash_features(sc.tokens(F.col("text")), 32)).alias("f")).select("id", "f.*").collect()
    dense = np.zeros(32)
    for r in sparse:
        if r.id == "a":
            dense[r.slot] += r.sign
    assert np.allclose(dense / np.linalg.norm(dense), rows["a"], atol=1e-6)


def test_rendered_document_and_search_text(spark):
    df = spark.createDataFrame([("order_item", "A-1", "billing.credit_limit", '{"b":[1,"x,y"],"a":true}'), ("user", "u", "name", '"Ann Lee"')],
                               "entity_type string, external_id string, property string, value string")
    texts = [r[0] for r in df.select(em.rendered_document()).collect()]
    assert texts == ['order_item A-1\nbilling / credit limit: {"a": true, "b": [1, "x,y"]}', 'user u\nname: "Ann Lee"']
    assert df.select(em.search_text()).collect()[1][0] == "user u name Ann Lee"


def test_embedding_is_reused_within_a_tenant_only(spark):
    v = spark.createDataFrame(
        [("a", 1, "user", "u", "p", "1"), ("a", 2, "user", "u", "p", "1"), ("a", 3, "user", "u", "p", "2"), ("b", 4, "user", "u", "p", "1")],
        "organization_id string, id int, entity_type string, external_id string, property string, value string",
    ).withColumn("recorded_at", F.lit(T))
    sha = em.render_documents(v.where("id = 1")).first().content_sha256
    have = spark.createDataFrame([("a", 99, em.HASH_MODEL, sha, [0.5])], "organization_id string, fact_version_id int, model string, content_sha256 string, embedding array<float>")
    rows, stats = em.embed_missing(v, have, dims=8)
    assert {r.fact_version_id: (r.reused, len(r.embedding)) for r in rows.collect()} == {1: (True, 1), 2: (True, 1), 3: (False, 8), 4: (False, 8)}
    assert {r.organization_id: (r.versions, r.texts_reused, r.texts_embedded) for r in stats.collect()} == {"a": (3, 1, 1), "b": (1, 0, 1)}


@pytest.mark.parametrize(
    "word,want",
    [("consigned", "consign"), ("knightly", "knight"), ("hopping", "hop"), ("hoping", "hope"), ("ponies", "poni"), ("relational", "relat"),
     ("happiness", "happi"), ("limits", "limit"), ("news", "news"), ("dying", "die"), ("skies", "sky"), ("by", "by"), ("agreed", "agre"), ("purchases", "purchas")],
)
def test_stemmer(word, want):
    assert stem(word) == want


@pytest.mark.parametrize("room", [1, 1 << 25])
def test_many_equal_vectors_tie_by_id_in_any_plan(spark, room):
    """Copies of one vector have one distance, whatever blocks they are computed in, and any pool is given in full."""
    rows = spark.range(900).selectExpr("id", "id % 3 as g", "array(cast(0.1 + (id % 9) * 0.1 as float), cast(0.7 as float), cast(0.2 as float)) as embedding")
    asked = spark.range(6).selectExpr("id as question_id", "id % 3 as g", "array(0.3f, 0.7f, 0.2f) as vector", "250 as pool")
    got = vx.nearest_blocks(rows, asked, group=["g"], dims=3, question_bytes=room, block_rows=50).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.question_id, []).append((r.distance, r.id))
    assert all(len(v) == 250 and v == sorted(v) for v in by.values()) and len(by) == 6
    near = [i for _, i in by[0]]
    assert near[:100] == [i for i in range(900) if i % 3 == 0 and i % 9 == near[0] % 9][:100]


def test_blocks_out_of_bounds_are_not_asked(spark, world):
    """What a block's bounds rule out is not multiplied; what they let in is judged row by row, as by the joins."""
    v, _, gone, q = world
    asks, _ = rt.normalize_questions(q)
    us = lambda c: F.unix_micros(c)
    rows = rt.searchable(v, gone).where("organization_id = 'a'").select(
        "id", us("valid_from").alias("from_us"), us("valid_until").alias("until_us"), us("recorded_at").alias("recorded_us"),
        us("valid_until_recorded_at").alias("until_rec_us"), us("revoked_at").alias("revoked_us"), "scope", "authority",
        F.col("confidence").cast("double").alias("confidence"), "entity_type", "external_id", "property", "source_id",
    ).toPandas()
    asked = asks.withColumns({"valid_at_us": us("valid_at"), "known_at_us": us("known_at")}).toPandas()
    may, pairs = rt._eligible_pairs(rows, asked)
    revoked = {r.fact_version_id: r.revoked_at for r in gone.collect()}
    by_id = {r.id: r for r in v.collect()}
    by_question = {r.question_id: r for r in q.collect()}
    for j, name in enumerate(asked["question_id"]):
        ask = by_question[name].asDict() | {"organization_id": "a"}
        want = [allowed(by_id[i], revoked, type("Ask", (), ask)) for i in rows["id"]]
        assert pairs(j, np.arange(len(rows))).tolist() == want and (may[j] or not any(want))
    closed = rows[rows["until_us"].notna() & (rows["until_us"] <= asked["valid_at_us"].min())]
    assert len(closed) and not rt._eligible_pairs(closed, asked[asked["known_at_us"].isna()])[0].any()


def test_a_task_sends_one_pool_for_all_its_blocks():
    """However many blocks a task reads, it tells each question's nearest rows once."""
    import pandas as pd

    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(4000, DIMS))
    asked = pd.DataFrame({"question_id": [f"q{i}" for i in range(30)], "g": 0, "pool": 7, "vector": list(rng.normal(size=(30, DIMS)))})
    by_group, pools = vx._grouped(asked, ["g"]), {}
    for low in range(0, 4000, 100):
        vx._look(pd.DataFrame({"g": 0, "id": np.arange(low, low + 100), "embedding": list(vectors[low : low + 100])}), by_group, ["g"], None, pools)
    (held,) = pools.values()
    held.found = [held.best()]
    told = vx._told(by_group, pools, np.zeros(0, np.int64))
    exact = np.round(1 - vx.unit(asked["vector"]) @ vx.unit(vectors).T, vx.PLACES)
    for i in range(30):
        got = told[told["question_id"] == f"q{i}"]
        assert got["id"].tolist() == np.argsort(exact[i], kind="stable")[:7].tolist()
        assert got["distance"].to_numpy() == pytest.approx(np.sort(exact[i])[:7])


def test_cells_nobody_can_see_are_not_sent(spark):
    """Questions meet the cells whose bounds let them in, and find there what they find among all rows."""
    rows = spark.range(400).select("id", F.lit("g").alias("g"), F.array(F.cos("id"), F.sin("id")).cast("array<float>").alias("embedding"), F.floor(F.col("id") / 100).alias("part"))
    asked = spark.range(8).select(F.col("id").alias("question_id"), F.lit("g").alias("g"), F.array(F.cos(F.col("id") * 3), F.sin(F.col("id") * 3)).cast("array<float>").alias("vector"), F.lit(5).alias("pool"), (F.col("id") % 3).alias("wanted"))

    def mask(block, questions):
        assert block["part"].nunique() == 1 and (questions["wanted"] >= block["part"].iloc[0]).all()
        return np.ones(len(questions), bool), lambda j, places: np.ones(len(places), bool)

    got = vx.nearest_blocks(
        rows, asked, group=["g"], dims=2, mask=mask, cell=F.col("part").cast("string"), bounds={"low": F.min("part")}, meets=F.col("low") <= F.col("wanted"),
        question_bytes=1, block_rows=30,
    ).collect()
    want = {}
    for j in range(8):
        seen = range(100 * (j % 3 + 1))
        want[j] = sorted(seen, key=lambda i: (round(1 - float(np.float32(np.cos(i)) * np.float32(np.cos(3 * j)) + np.float32(np.sin(i)) * np.float32(np.sin(3 * j))), 5), i))[:5]
    assert {r.question_id: None for r in got} == dict.fromkeys(range(8)) and all(r.id < 100 * (r.question_id % 3 + 1) for r in got)
    assert {j: len([r for r in got if r.question_id == j]) for j in range(8)} == {j: len(want[j]) for j in range(8)}
