"""Registered queries: search documents, embeddings, hybrid search, grounding."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from chronoweave.functions import scalars as sc
from chronoweave.operators import decisions as dr, embedding as em, grounding as gr, inverted_lists as il, retrieval as rt, segments as sg, vectors as vx
from chronoweave.plans import fixtures as fx
from chronoweave.session import checkpoint_root
from chronoweave.sources.search_store import SearchStore
from chronoweave.plans.common import flat, led, ordinal, revs, sql, src, stored, t

DIMS = 64
NOW = "2024-02-01"  # after the last event
ELIGIBLE_PARTS = 8


def docs(s, d):
    return stored(s, d, "search_docs", lambda: em.build_search_docs(led(s, d)))


def embeddings(s, d):
    """The vector of a number belongs to the version of the same number."""
    e = fx.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    v = led(s, d).select("organization_id", "id")
    return e.join(v, "id").select(
        "organization_id", F.col("id").alias("fact_version_id"), F.lit(fx.MODEL).alias("model"),
        F.sha2(F.col("id").cast("string"), 256).alias("content_sha256"), "embedding", "label",
        F.lit("2024-02-01").cast("timestamp").alias("created_at"),
    )


def embedded(s, d):
    """The hash embeddings of all versions, as :func:`embed_missing` makes them: each text of a tenant once."""

    def make():
        none = s.createDataFrame([], "organization_id long, fact_version_id long, model string, content_sha256 string, embedding array<float>")
        return em.embed_missing(led(s, d), none, em.HASH_MODEL, DIMS)[0].drop("reused")

    return stored(s, d, "version_vectors", make)


def questions(s, d):
    """Every vector's number asks for facts like the version of that number: words and their embedding, filters by turns. Seven of ten
    ask for now, the others at a time of the version and as known a day later, so they spread over the whole ledger."""

    def make():
        i = F.col("id")
        e = fx.table(s, d, "embeddings").select(F.col("vec_id").alias("id"))
        v = led(s, d).select("id", "organization_id", "property", "external_id", "valid_from").join(e, "id")
        text = F.concat(F.lit("the latest "), F.col("property"), F.lit(" of "), F.col("external_id"))
        later = lambda hours: F.when(i % 10 >= 7, F.col("valid_from") + F.expr(f"INTERVAL '{hours}' HOUR"))
        return v.select(
            F.concat(F.lit("q"), i.cast("string")).alias("question_id"), "organization_id",
            F.concat(F.lit("  the latest "), F.col("property"), F.lit("   of "), F.col("external_id")).alias("query"),
            F.when(i % 5 != 0, em.hash_embed(sc.tokens(text), DIMS)).alias("vector"),
            F.coalesce(later(12), F.lit(NOW).cast("timestamp")).alias("valid_at"),
            later(36).alias("known_at"),
            F.when(i % 3 == 0, "VIEWER").when(i % 3 == 1, "ENGINEER").otherwise("ADMIN").alias("role"),
            F.when(i % 7 == 0, F.array("property")).alias("properties"),
            F.when(i % 11 == 0, F.lit(70)).alias("min_authority"),
            F.when(i % 13 == 0, F.lit(0.75)).alias("min_confidence"),
            F.when(i % 4 == 0, F.lit(20)).alias("limit"),
            F.lit("asker").alias("captured_by_user_id"),
        )

    return stored(s, d, "questions", make)


_STEM = "case property when 'purchase' then 'purchas' else property end"


def _hash_vectors(name: str, rows: str) -> str:
    """The hash embeddings of ``rows`` (``id``, ``ws``: words) as a table ``name`` of ``id``, ``v``."""
    return f"""
{name}_h as (select id, sha256(f) as h from (select id, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as f from ({rows}) r) f),
{name}_w as (select id, ('0x' || substr(h, 1, 8))::bigint % {DIMS} as slot, sum(case when ('0x' || substr(h, 9, 2))::int % 2 = 1 then 1 else -1 end)::double as w from {name}_h group by 1, 2),
{name}_n as (select id, sqrt(sum(w * w)) as n from {name}_w group by 1),
{name} as (
 select g.id, list(case when g.n = 0 then case when g.slot = 0 then 1 else 0 end else coalesce(x.w, 0) / g.n end::float::double order by g.slot) as v
 from (select id, n, unnest(range({DIMS})) as slot from {name}_n) g left join {name}_w x on x.id = g.id and x.slot = g.slot group by g.id)"""


def _search_sql(known: str, valid: str) -> str:
    return f"""
sdocs as (
 select id, organization_id, list_filter(['user', external_id, {_STEM}] || regexp_extract_all(value, '[0-9]+'), lambda x: x not in ('')) as tokens from led),
{_hash_vectors("dv", "select id, regexp_extract_all(lower('user ' || external_id || chr(10) || property || ': ' || value), '[a-z0-9]+') as ws from led").strip()},
{_hash_vectors("qv", "select l.id, regexp_extract_all(lower('the latest ' || property || ' of ' || external_id), '[a-z0-9]+') as ws from embeddings e join led l on l.id = e.vec_id").strip()},
q as (
 select 'q' || e.vec_id as question_id, l.id as qid, l.organization_id, qv.v as vec, l.property, l.external_id, {_STEM} as stem,
  {known} as known_at, {valid} as valid_at,
  case l.id % 3 when 0 then 1 when 1 then 2 else 3 end as ceiling, case when l.id % 4 = 0 then 20 else 10 end as lim,
  case when l.id % 4 = 0 then 80 else 40 end as pool
 from embeddings e join led l on l.id = e.vec_id join qv on qv.id = l.id),
elig as (
 select q.question_id, q.pool, q.qid, q.vec, q.stem, q.external_id as q_ext, l.* from q join led l on l.organization_id = q.organization_id
  left join revs r on r.fact_version_id = l.id
 where l.valid_from <= q.valid_at and (q.known_at is null or l.recorded_at <= q.known_at)
  and (l.valid_until is null or l.valid_until > q.valid_at or coalesce(l.valid_until_recorded_at > q.known_at, false))
  and (r.fact_version_id is null or coalesce(r.revoked_at > q.known_at, false)) and {ordinal('l.privacy_scope')} <= q.ceiling
  and (q.qid % 7 <> 0 or l.property = q.property) and (q.qid % 11 <> 0 or l.authority >= 70) and (q.qid % 13 <> 0 or l.confidence >= 0.75)),
tx as (
 select question_id, id, pool, cast(list_aggregate(list_transform(list_distinct(['latest', stem, q_ext]), lambda w: len(list_filter(s.tokens, lambda x: x = w))), 'sum') as double) * 0.1 as text_score
 from elig join sdocs s using (id)),
txr as (select * from (select *, row_number() over (partition by question_id order by text_score desc, id) as text_rank from tx where text_score > 0) z where text_rank <= pool),
vx as (
 select question_id, elig.id, pool, round(1 - list_cosine_similarity(dv.v, vec), 9) as vector_distance
 from elig join dv on dv.id = elig.id where qid % 5 <> 0),
vxr as (select * from (select *, row_number() over (partition by question_id order by vector_distance, id) as vector_rank from vx) z where vector_rank <= pool),
fused as (
 select coalesce(a.question_id, b.question_id) as question_id, coalesce(a.id, b.id) as id, vector_rank, vector_distance, text_rank, text_score,
  coalesce(1.0::double / (60 + vector_rank), 0) + coalesce(1.0::double / (60 + text_rank), 0) as rrf_score
 from vxr a full join txr b on a.question_id = b.question_id and a.id = b.id),
scored as (select f.*, l.authority / 100.0::double * l.confidence::double as trust, q.lim, q.known_at,
  f.rrf_score * ((1 - 0.3::double) + 0.3::double * (l.authority / 100.0::double * l.confidence::double)) as score
 from fused f join led l using (id) join q using (question_id)),
win as (select * from (select *, row_number() over (partition by question_id order by score desc, id) as position from scored) z where position <= lim)"""


def _at(hours: int, otherwise: str) -> str:
    return f"case when l.id % 10 >= 7 then l.valid_from + INTERVAL '{hours}' HOUR else {otherwise} end"


_SEARCH = _search_sql(_at(36, "null"), _at(12, f"TIMESTAMP '{NOW}'"))
_PINNED = _at(36, f"TIMESTAMP '{NOW}'")


def _parts(s, d):
    q, _ = rt.normalize_questions(questions(s, d))
    return rt.searchable(led(s, d), revs(s, d)), q


def _text(s, d):
    rows, q = _parts(s, d)
    return rt.text_hits(rows, docs(s, d), q).select("question_id", "id", F.round("text_score", 6).alias("text_score"), "text_rank")


def _vector(s, d):
    rows, q = _parts(s, d)
    return rt.vector_hits(rows, embedded(s, d), q, model=em.HASH_MODEL, dims=DIMS).select(
        "question_id", "id", F.round("vector_distance", 6).alias("vector_distance"), "vector_rank"
    )


_BUILT: dict[tuple, str] = {}


def _built(s, d, name, make):
    """The folder that ``make`` has filled for this session and data set, once."""
    key = (s.sparkContext.applicationId, d, name)
    if key not in _BUILT:
        folder = f"{checkpoint_root(s)}/{name}-{hashlib.sha256(repr(key).encode()).hexdigest()[:16]}"
        make(folder)
        _BUILT[key] = folder
    return _BUILT[key]


def ledger_segments(s, d):
    """The segments of the ledger."""
    return sg.read(s, _built(s, d, "segments", lambda folder: sg.build(rt.searchable(led(s, d), revs(s, d)), docs(s, d), folder)))


def search_store(s, d):
    """The ledger in buckets, appended in two halves that overlap, and every version embedded."""

    def make(folder):
        store = SearchStore(s, folder, buckets=8)
        for half in ("id % 2 = 0", "id % 3 < 2 or id % 2 = 1"):
            store.append_versions(led(s, d).where(half))
            store.embed(em.HASH_MODEL, DIMS)

    return SearchStore(s, _built(s, d, "search-store", make), buckets=8)


def search(s, d):
    return rt.search(
        led(s, d), src(s, d), questions(s, d), revocations=revs(s, d), embeddings=embedded(s, d), segments=ledger_segments(s, d),
        model=em.HASH_MODEL, dims=DIMS,
    )


def _search_joined(s, d):
    """Without segments: postings joined by token, as for a ledger that is searched once."""
    found = rt.search(
        led(s, d), src(s, d), questions(s, d), revocations=revs(s, d), embeddings=embedded(s, d), docs=docs(s, d), model=em.HASH_MODEL, dims=DIMS
    )
    return found.select("question_id", "id", "position", F.round("score", 9).alias("score"))


def _search_stored(s, d):
    store = search_store(s, d)
    found = rt.search(
        store.versions(), src(s, d), questions(s, d), revocations=revs(s, d), embeddings=store.vectors(), segments=ledger_segments(s, d),
        model=em.HASH_MODEL, dims=DIMS,
    )
    return found.select("question_id", "id", "position", F.round("score", 9).alias("score"))


def _stored_vectors(s, d):
    """Of the store: versions, vectors and texts of each tenant."""
    store = search_store(s, d)
    v = store.versions().join(store.vectors().withColumnRenamed("fact_version_id", "id"), ["organization_id", "id"], "left")
    return v.groupBy("organization_id").agg(
        F.count(F.lit(1)).alias("versions"), F.countDistinct("id").alias("ids"), F.count("embedding").alias("vectors"), F.countDistinct("content_sha256").alias("texts"))


def _asked(s, d):
    q, _ = rt.normalize_questions(questions(s, d))
    return rt.asked_of_segments(q)


def _segment_text(s, d):
    found = sg.text_hits(ledger_segments(s, d), _asked(s, d), rt.MAX_POOL)
    return found.select("question_id", "id", F.round("text_score", 6).alias("text_score"), "text_rank")


def _segment_eligible(s, d):
    n = sg.eligible_counts(ledger_segments(s, d), _asked(s, d))
    return n.groupBy("organization_id").agg(F.sum("versions").alias("eligible_pairs"))


def segment_work(s, d):
    """Postings looked at against those of the questions' tokens in all their tenants' versions, and versions of segments met
    against all pairs of questions and versions of their tenants."""
    met = sg.text_work(ledger_segments(s, d), _asked(s, d)).agg(*[F.sum(c).alias(c) for c in ("looked", "held", "versions")])
    asked = _asked(s, d)
    sizes = led(s, d).groupBy("organization_id").agg(F.count(F.lit(1)).alias("n"))
    every = asked.groupBy("organization_id").agg(F.count(F.lit(1)).alias("q")).join(sizes, "organization_id").agg(F.sum(F.col("q") * F.col("n")).alias("pairs"))
    t = docs(s, d).select("organization_id", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("organization_id", "token").agg(F.count(F.lit(1)).alias("n"))
    asks = asked.select("organization_id", F.explode("tokens").alias("token")).groupBy("organization_id", "token").agg(F.count(F.lit(1)).alias("q"))
    postings = t.join(asks, ["organization_id", "token"]).agg(F.sum(F.col("n") * F.col("q")).alias("postings"))
    return met.join(every).join(postings)


def _less_work(s, d):
    w = segment_work(s, d)
    return w.select((F.col("looked") <= F.col("postings")).alias("fewer_postings"), (F.col("versions") <= F.col("pairs")).alias("fewer_versions"))


def _search(s, d):
    return flat(
        search(s, d).select(
            "question_id", "position", "id", "property", "source_name", "valid_until", "vector_rank", "text_rank",
            F.round("trust", 6).alias("trust"), F.round("rrf_score", 9).alias("rrf_score"), F.round("score", 9).alias("score"),
        )
    )


def _counts(s, d):
    rows, q = _parts(s, d)
    return rt.candidate_counts(
        rt.vector_hits(rows, embedded(s, d), q, model=em.HASH_MODEL, dims=DIMS), rt.text_hits(rows, docs(s, d), q), q
    )


def _fuse_without_trust(s, d):
    rows, q = _parts(s, d)
    q = q.withColumn("trust_weight", F.lit(0.0))
    trusts = led(s, d).select("organization_id", "id", rt.trust(F.col("authority"), F.col("confidence")).alias("trust"))
    hits = rt.fuse(rt.vector_hits(rows, embedded(s, d), q, model=em.HASH_MODEL, dims=DIMS), rt.text_hits(rows, docs(s, d), q), trusts, q)
    return hits.select("question_id", "id", "position", F.round("score", 9).alias("score"))


def _text_only(s, d):
    found = rt.search(led(s, d), src(s, d), questions(s, d), revocations=revs(s, d), docs=docs(s, d))
    return found.select("question_id", "id", "position", F.round("score", 9).alias("score"))


def _eligible(s, d):
    """How many versions each question may see, counted per tenant and filter combination."""
    rows, q = _parts(s, d)
    asks = q.select("question_id", "organization_id", *[F.col(c).alias(f"q_{c}") for c in rt._ASK_SIDE])
    shapes = [f"q_{c}" for c in rt._ASK_SIDE]
    distinct = asks.groupBy("organization_id", *shapes).agg(F.count(F.lit(1)).alias("questions"))
    # a combination meets only cells of rows whose bounds let it in, each in as many parts
    part = F.pmod(F.xxhash64("id"), F.lit(ELIGIBLE_PARTS)).cast("int")
    rows = rows.withColumn("cell", rt.time_cell()).withColumn("part", part)
    cells = rows.groupBy("organization_id", "cell").agg(
        F.min("valid_from").alias("low"), F.max(F.coalesce("valid_until", F.lit("9999-12-31").cast("timestamp"))).alias("until"),
        F.min("recorded_at").alias("recorded"), F.max("valid_until_recorded_at").alias("learned"), F.min("scope").alias("least"),
    )
    at, known = F.col("q_valid_at"), F.col("q_known_at")
    meets = (
        (F.col("low") <= at) & (F.col("least") <= F.col("q_ceiling")) & (known.isNull() | (F.col("recorded") <= known))
        & ((F.col("until") > at) | F.coalesce(F.col("learned") > known, F.lit(False)))
    )
    asked = distinct.join(F.broadcast(cells), "organization_id").where(meets).select(
        "organization_id", F.concat("cell", F.lit("")).alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(ELIGIBLE_PARTS - 1))).alias("part"), *shapes, "questions")
    tasks = int(s.conf.get("spark.sql.shuffle.partitions"))  # few bytes may be much work
    key = ["organization_id", "cell", "part"]
    return (
        rows.repartition(tasks, *key).join(asked.repartition(tasks, *key), key).where(rt.eligible_pair())
        .groupBy("organization_id").agg(F.sum("questions").alias("eligible_pairs"))
    )


def _bad_questions(s, d):
    """Questions from event texts with faults of every kind."""
    e = fx.table(s, d, "events")
    i = F.col("event_id")
    q = e.select(
        i.alias("question_id"), (F.col("user_id") % 4).alias("organization_id"),
        F.when(i % 7 == 0, "   ").when(i % 11 == 0, F.repeat(F.lit("ab "), 400)).otherwise(F.concat(F.lit(" "), F.col("event_type"), F.lit("  now "))).alias("query"),
        F.when(i % 13 == 0, F.lit(51)).otherwise((i % 50 + 1).cast("int")).alias("limit"),
        F.when(i % 17 == 0, F.lit(1.5)).alias("trust_weight"), F.col("ts").alias("valid_at"),
        F.when(i % 19 == 0, F.transform(F.sequence(F.lit(1), F.lit(101)), lambda x: x.cast("string"))).alias("external_ids"),
        F.when(i % 23 == 0, F.lit(101)).alias("min_authority"), F.when(i % 29 == 0, "9x").alias("entity_type"),
        F.when(i % 2 == 0, "PUBLIC").alias("max_privacy_scope"),
    )
    ok, bad = rt.normalize_questions(q)
    return ok.select("question_id", "query", "pool", "ceiling", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("question_id", F.lit(None).cast("string").alias("query"), F.lit(None).cast("int").alias("pool"), F.lit(None).cast("int").alias("ceiling"), "reason")
    )


def _vector_rows(s, d):
    return embeddings(s, d).select("organization_id", "model", F.col("fact_version_id").alias("id"), "embedding")


def _vector_questions(s, d):
    """Every vector asks."""
    return embeddings(s, d).select("organization_id", "model", F.col("fact_version_id").alias("question_id"), F.col("embedding").alias("vector"))


def _nearest(s, d):
    return vx.nearest(_vector_rows(s, d), _vector_questions(s, d), 10, DIMS, ["organization_id", "model"]).select(
        "question_id", "id", F.round("distance", 6).alias("distance"), "rank"
    )


CLUSTERS = 16


def _plain(s, d):
    return fx.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _clustered(s, d):
    """The same vectors, halved and moved to one of 16 centres: the vectors of the first numbers."""
    e = _plain(s, d)
    centres = e.where(F.col("id") < CLUSTERS).select(F.col("id").alias("centre"), F.col("embedding").alias("at"))
    moved = F.zip_with("embedding", "at", lambda x, c: (x * 0.5 + c).cast("float"))
    return e.withColumn("centre", F.col("id") % CLUSTERS).join(F.broadcast(centres), "centre").select("id", moved.alias("embedding"))


def list_index(s, d, kind):
    """The stored lists of the plain or the clustered vectors, about as many as the root of their number; built once a session."""
    rows = {"plain": _plain, "clustered": _clustered}[kind](s, d)
    return il.load(s, _built(s, d, f"lists-{kind}", lambda folder: il.build(rows, folder, max(2, round(rows.count() ** 0.5)), DIMS)))


def asking(rows):
    return rows.where("id % 100 = 0").select(F.col("id").alias("question_id"), F.col("embedding").alias("vector"))


def _lists(s, d, kind="plain"):
    index = list_index(s, d, kind)
    return il.search(index, asking(index.rows(s)), 10).withColumn("distance", F.round("distance", vx.PLACES))


def _all_lists(s, d):
    """With every list within the gap, inverted lists give the exact neighbours of every vector."""
    index = list_index(s, d, "plain")
    index.gap = 3.0
    every = index.rows(s).select(F.col("id").alias("question_id"), F.col("embedding").alias("vector"))
    return il.search(index, every, 10).select("question_id", "id", F.round("distance", 6).alias("distance"), "rank")


def list_recall(s, d, kind):
    """Questions, recall@10 against the exact search, and the share of lists and of files that the questions read on average."""
    index = list_index(s, d, kind)
    rows = index.rows(s)
    q = asking(rows)
    one = F.lit(0).alias("g")
    exact = vx.nearest(rows.select("id", "embedding", one), q.select("*", one), 10, DIMS, ["g"])
    recall = vx.ann_recall(il.search(index, q, 10), exact, 10).agg(F.count(F.lit(1)).alias("questions"), F.avg("recall").alias("recall_at_10"))
    lists = index.centroids(s).agg(F.count(F.lit(1)).alias("lists"))
    probes = il.probed(index, q).groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n").alias("probes"))
    return recall.join(lists).join(probes)


def _recall_bound(kind, least, share):
    """Whether the recall is reached, and with at most this share of the lists."""

    def run(s, d):
        r = list_recall(s, d, kind)
        return r.select("questions", (F.col("recall_at_10") >= least).alias("recall_reached"), (F.col("probes") <= F.col("lists") * share).alias("lists_bounded"))

    return run, "select count(*) as questions, true as recall_reached, true as lists_bounded from embeddings where vec_id % 100 = 0"


def _list_sizes(s, d):
    """Every row is in one list, and a list that one question probes is read without the others."""
    index = list_index(s, d, "clustered")
    rows = index.rows(s)
    first = asking(rows.where("id = 0"))
    some = il.read_lists(index, s, il.probed(index, first))
    count = lambda df: df.select(F.col("_metadata.file_path").alias("f")).agg(F.countDistinct("f").alias("n"))
    files = count(some).withColumnRenamed("n", "read").join(count(rows).withColumnRenamed("n", "held"))
    return rows.agg(F.count(F.lit(1)).alias("vectors"), F.countDistinct("id").alias("ids")).join(files).select(
        "vectors", "ids", (F.col("read") < F.col("held")).alias("reads_part"))


def _l2(s, d):
    e = _vector_rows(s, d)
    ends = e.groupBy("organization_id").agg(F.min("id").alias("first"))
    ends = ends.select("organization_id", F.col("first").alias("id"))
    ref = e.join(ends, ["organization_id", "id"]).select("organization_id", F.col("embedding").alias("o"))
    return e.join(ref, "organization_id").select("id", F.round(em.l2_distance(F.col("embedding"), F.col("o")), 6).alias("l2"),
                                                 F.round(em.cosine_distance(F.col("embedding"), F.col("o")), 6).alias("cosine"))


def _features(s, d):
    tokens = sc.tokens(em.rendered_document())
    f = led(s, d).select("id", F.explode(em.hash_features(tokens, 256)).alias("f"))
    return f.groupBy("id", F.col("f.slot").alias("slot")).agg(F.sum("f.sign").alias("weight")).where("weight <> 0")


def _dense(s, d):
    """The dense vectors of all versions: dimension, length and a weighted sum to compare by."""
    v = led(s, d).select("id", em.hash_embed(sc.tokens(em.rendered_document()), 256).alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    weighted = F.aggregate(F.transform("v", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return v.select("id", F.size("v").alias("dims"), F.round(norm, 4).alias("norm"), F.round(weighted, 3).alias("weighted"))


_HASHED = """
with tk as (select id, regexp_extract_all(lower('user ' || external_id || chr(10) || property || ': ' || value), '[a-z0-9]+') as ws from led),
ft as (select id, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as f from tk),
hs as (select id, sha256(f) as h from ft),
sl as (select id, ('0x' || substr(h, 1, 8))::bigint % 256 as slot, case when ('0x' || substr(h, 9, 2))::int % 2 = 1 then 1 else -1 end as sign from hs),
wt as (select id, slot, cast(sum(sign) as bigint) as weight from sl group by 1, 2)"""


def _some_embedded(s, d):
    """Embeddings exist for the versions of two properties only."""
    texts = em.render_documents(led(s, d).where("property in ('click', 'view')"))
    return texts.select(
        "organization_id", F.col("id").alias("fact_version_id"), F.lit(em.HASH_MODEL).alias("model"), "content_sha256",
        F.array(F.lit(1.0).cast("float")).alias("embedding"),
    )


def _missing(s, d):
    m = em.missing_embeddings(led(s, d), _some_embedded(s, d), em.HASH_MODEL, 500)
    return flat(m.select("id", "recorded_at"))


def _embed_stats(s, d):
    """Half of the stored texts repeat as the text of a new version."""
    v = led(s, d)
    again = v.withColumn("id", F.col("id") + 10_000_000).withColumn("recorded_at", F.col("recorded_at") + F.expr("INTERVAL '1' DAY"))
    return em.embed_missing(v.unionByName(again), _some_embedded(s, d), em.HASH_MODEL, 64)[1]


def _embedded(s, d):
    rows, _ = em.embed_missing(led(s, d), _some_embedded(s, d), em.HASH_MODEL, 64)
    return rows.groupBy("organization_id", "reused", F.size("embedding").alias("dims")).agg(F.count(F.lit(1)).alias("versions"))


def _generation(s, d):
    """Events of the ledger: every version, every vector, every revocation bumps its tenant."""
    typed = lambda df, kind: df.select("organization_id", F.lit(kind).alias("type"))
    events = (
        typed(led(s, d), "fact.version_recorded").unionByName(typed(embeddings(s, d), "fact.embedding_stored"))
        .unionByName(typed(revs(s, d), "fact.revoked")).unionByName(typed(led(s, d), "evidence.captured"))
    )
    return rt.retrieval_generation(events)


def _captured(s, d):
    q = questions(s, d).drop("valid_at")
    return dr.capture_context(
        led(s, d), src(s, d), q, embedding_model=em.HASH_MODEL, now=F.lit(NOW).cast("timestamp"),
        revocations=revs(s, d), embeddings=embedded(s, d), docs=docs(s, d), dims=DIMS,
    )


def _context_heads(s, d):
    heads, facts = _captured(s, d)
    n = facts.groupBy(F.col("snapshot_id").alias("id")).agg(F.count(F.lit(1)).alias("facts"), F.max("position").alias("last"))
    return flat(heads.join(n, "id", "left").select("query", "valid_at", "known_at", "vector_search", "facts", "last", F.size("privacy_scopes").alias("scopes")))


def _context_facts(s, d):
    return _captured(s, d)[1].select("fact_version_id", "position", F.round("ranking.score", 9).alias("score"))


def _parameters(s, d):
    q, _ = rt.normalize_questions(questions(s, d))
    return q.select("question_id", dr.retrieval_parameters().alias("parameters"))


# --- grounding ---------------------------------------------------------------------------------------


def _packed(s, d):
    return gr.pack_facts(stored(s, d, "search_results", lambda: search(s, d)))


def _outputs(s, d):
    """Model outputs for every question, by turns good, refusing, inventing, uncited, blank, malformed."""
    k = F.xxhash64("question_id")
    n = F.substring("question_id", 2, 20).cast("int")
    body = (
        F.when(n % 8 == 0, '{"answer":"no","insufficient_evidence":true,"cited_facts":["F1"]}')
        .when(n % 8 == 1, '{"answer":"yes","insufficient_evidence":false,"cited_facts":["F1","F99"]}')
        .when(n % 8 == 2, '{"answer":"yes","insufficient_evidence":false,"cited_facts":[]}')
        .when(n % 8 == 3, '{"answer":"  ","insufficient_evidence":false,"cited_facts":["f1"]}')
        .when(n % 8 == 4, '{"answer":7,"insufficient_evidence":false,"cited_facts":["F1"]}')
        .when(n % 8 == 5, "not json")
        .otherwise('{"answer":" It is so. ","insufficient_evidence":false,"cited_facts":[" f2 ","F1","F2"],"inferences":["maybe"]}')
    )
    return questions(s, d).select("question_id", "query", body.alias("output"), k.alias("k"))


def _checked(s, d):
    return gr.check_citations(gr.parse_answers(_outputs(s, d)), _packed(s, d))


_STATUS = """case when n % 8 in (4, 5) then 'error' when n % 8 = 0 then 'insufficient_evidence' when n % 8 in (1, 2, 3) then 'ungrounded'
 when facts < 2 then 'ungrounded' else 'answered' end"""
_GROUND = f"""
with {_SEARCH.strip()},
nf as (select q.question_id, q.qid as n, coalesce(c.facts, 0) as facts from q left join (select question_id, count(*) as facts from win group by 1) c using (question_id)),
st as (select *, {_STATUS} as status from nf)"""


def _answers(s, d):
    heads, _ = gr.assemble_answers(_outputs(s, d), _checked(s, d), _packed(s, d))
    return heads.select("question_id", "question", "status", "answer", "grounded", "model_called", "facts_supplied")


def _citations(s, d):
    return gr.assemble_answers(_outputs(s, d), _checked(s, d), _packed(s, d))[1].select("question_id", "citation", "label", "fact_version_id", "source_name")


def _leaks(s, d):
    """Does any context show another tenant's user or a value the asker must not see?"""
    ctx = gr.render_context(_packed(s, d), questions(s, d))
    q = questions(s, d).select("question_id", F.array(F.lit("USER/"), F.lit("customer/"), F.lit("RESTRICTED")).alias("forbidden"))
    return gr.context_leaks(ctx.join(q, "question_id")).select("question_id", F.array_join("leaks", ",").alias("leaks"))


def _matches(s, d):
    e = fx.table(s, d, "events")
    cents = (F.col("value") * 100).cast("long")
    text = F.concat(F.lit("It cost $"), F.format_number(cents * 1000, 0), F.lit(" for "), F.upper("event_type"))
    rows = e.select(
        F.col("event_id").alias("id"), text.alias("answer"),
        F.array((cents * 1000).cast("string"), F.when(F.col("event_id") % 3 == 0, "refund").otherwise(F.col("event_type"))).alias("contains"),
        F.array(F.when(F.col("event_id") % 5 == 0, "cost").otherwise("never")).alias("excludes"),
    )
    return gr.answer_matches(rows).select("id", "answer_matches")


def _runs(s, d):
    """Agent runs built from conversations: one run per conversation, one tool call per turn."""
    c = fx.table(s, d, "conversations")
    call = F.struct(
        F.col("turn"), F.col("role").alias("tool"), (F.length("text") % 5 != 0).alias("ok"),
        F.when(F.length("text") % 5 == 0, "failed").alias("error"), F.length("text").cast("int").alias("latency_ms"),
    )
    return c.groupBy("conv_id").agg(  # a run makes a handful of calls
        F.array_sort(F.collect_list(call)).alias("tool_calls"), F.count(F.lit(1)).alias("steps")
    ).select(
        (F.col("conv_id") % 4).alias("organization_id"), F.concat(F.lit("user-"), (F.col("conv_id") % 3).cast("string")).alias("requested_by_user_id"),
        F.col("conv_id").alias("run_id"), F.when(F.col("conv_id") % 6 == 0, "failed").otherwise("answered").alias("status"),
        F.lit("investigator").alias("agent"), "steps", "tool_calls",
    )


def _traces(s, d):
    asked = s.createDataFrame([(0, "user-0"), (1, "user-1"), (2, "user-2")], "organization_id long, requested_by_user_id string")
    return gr.run_traces(_runs(s, d), asked).select("run_id", "call", "tool", "ok", "error", "latency_ms")


def _investigations(s, d):
    c = fx.table(s, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    n, i = F.col("n").cast("int"), F.col("conv_id")
    name = lambda x: F.concat(F.lit("v"), x.cast("string"))
    runs = c.select(
        i.alias("run_id"), F.lit("because").alias("answer"), (i % 4 == 0).alias("insufficient"),
        F.when(i % 3 == 0, F.array(name(n), name(n + 1))).when(i % 3 == 1, F.array(name(n))).otherwise(F.array().cast("array<string>")).alias("cited_ids"),
        F.transform(F.sequence(F.lit(1), n), name).alias("observed_ids"),
    )
    out = gr.check_investigations(runs)
    return out.select("run_id", "status", "answer", F.array_join("cited_ids", ",").alias("cited"), F.array_join("rejected_ids", ",").alias("rejected"))


def _rendered(s, d):
    ctx = gr.render_context(_packed(s, d), questions(s, d))
    return ctx.select("question_id", "facts_supplied", F.sha2(F.col("context").cast("binary"), 256).alias("context_sha"))


_NUM = "regexp_replace(cast({0} as varchar), '\\.0+$', '')"
_LINES = f"""
with {_SEARCH.strip()},
ln as (select w.question_id, w.position, '[F' || w.position || '] user/' || l.external_id || ' ' || l.property || ' = ' || l.value || ' | valid ' ||
  strftime(l.valid_from, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00 to ' ||
  coalesce(case when w.known_at is null or l.valid_until_recorded_at <= w.known_at then strftime(l.valid_until, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' end, 'open-ended') ||
  ' | source "source-' || l.source_id || '" (' || (['SYSTEM_OF_RECORD','API','DOCUMENT','HUMAN','AGENT'])[l.source_id + 1] || ') | authority ' || l.authority ||
  ', confidence ' || l.confidence || ' | recorded ' || strftime(l.recorded_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' as line
 from win w join led l using (id)),
cx as (select question_id, count(*) as facts_supplied, string_agg(line, chr(10) order by position) as body from ln group by 1)"""


QUERIES = {
    "lb10_search_docs": (
        lambda s, d: docs(s, d).select("id", F.array_join("tokens", " ").alias("tokens")),
        sql(f"with {_SEARCH.strip()}\nselect id, array_to_string(tokens, ' ') as tokens from sdocs", "led", "revs"),
    ),
    "lb11_rendered_documents": (
        lambda s, d: em.render_documents(led(s, d)).select("id", "text", "content_sha256"),
        sql(
            """with r as (select id, 'user ' || external_id || chr(10) || property || ': ' || value as text from led)
select id, text, sha256(text) as content_sha256 from r""", "led",
        ),
    ),
    "lb12_missing_embeddings": (
        _missing,
        sql(f"select id, {t('recorded_at')} as recorded_at from led where property not in ('click', 'view') order by led.recorded_at, id limit 500", "led"),
    ),
    "lb13_embed_missing_stats": (
        _embed_stats,
        sql(
            """with x as (select organization_id, external_id || property || value as txt, property in ('click', 'view') as kept from led),
n as (select organization_id, txt, kept from x where not kept union all select organization_id, txt, kept from x)
select organization_id, count(*) as versions, count(distinct txt) filter (kept) as texts_reused, count(distinct txt) filter (not kept) as texts_embedded from n group by 1""", "led",
        ),
    ),
    "lb13_embed_missing": (
        _embedded,
        sql("select organization_id, false as reused, 64 as dims, count(*) as versions from led where property not in ('click', 'view') group by 1", "led"),
    ),
    "lb14_hash_features": (
        _features,
        sql(_HASHED + "\nselect id, slot, weight from wt where weight <> 0", "led"),
    ),
    "lb14_hash_embedding": (
        _dense,
        sql(
            _HASHED + """,
nm as (select id, sqrt(sum(weight * weight)) as norm from wt group by 1)
select id, 256 as dims, 1.0::double as norm, round(sum((slot + 1) * weight / norm), 3) as weighted from wt join nm using (id) group by id, norm""", "led",
        ),
    ),
    "rt1_normalize_questions": (
        _bad_questions,
        """with r as (select event_id as i, event_type, case when event_id % 7 = 0 then 'empty_query' when event_id % 11 = 0 then 'query_too_long'
  when event_id % 13 = 0 then 'bad_limit' when event_id % 17 = 0 then 'bad_trust_weight' when event_id % 19 = 0 then 'too_many_filter_values'
  when event_id % 23 = 0 then 'bad_min_authority' when event_id % 29 = 0 then 'bad_entity_type' end as reason from events)
select i as question_id, reason, case when reason is null then event_type || ' now' end as query,
 cast(case when reason is null then least(200, greatest(40, 4 * (i % 50 + 1))) end as int) as pool, cast(case when reason is null then case when i % 2 = 0 then 0 else 3 end end as int) as ceiling from r""",
    ),
    "rt2_eligible": (
        _eligible,
        sql(f"with {_SEARCH.strip()}\nselect organization_id, count(*) as eligible_pairs from elig group by 1", "led", "revs"),
    ),
    "rt3_rt4_text_hits": (
        _text, sql(f"with {_SEARCH.strip()}\nselect question_id, id, round(text_score, 6) as text_score, text_rank from txr", "led", "revs"),
    ),
    "rt2_segment_eligible": (
        _segment_eligible,
        sql(f"with {_SEARCH.strip()}\nselect organization_id, count(*) as eligible_pairs from elig group by 1", "led", "revs"),
    ),
    "rt3_rt4_segment_hits": (
        _segment_text, sql(f"with {_SEARCH.strip()}\nselect question_id, id, round(text_score, 6) as text_score, text_rank from txr", "led", "revs"),
    ),
    "rt3_postings_skipped": (_less_work, "select true as fewer_postings, true as fewer_versions"),
    "lb13_stored_vectors": (
        _stored_vectors,
        sql(
            """select organization_id, count(*) as versions, count(*) as ids, count(*) as vectors, count(distinct external_id || chr(10) || property || ': ' || value) as texts
 from led where id % 2 = 0 or id % 3 < 2 or id % 2 = 1 group by 1""", "led",
        ),
    ),
    "rt15_search_stored": (
        _search_stored, sql(f"with {_SEARCH.strip()}\nselect question_id, id, position, round(score, 9) as score from win", "led", "revs"),
    ),
    "rt15_search_joined": (
        _search_joined, sql(f"with {_SEARCH.strip()}\nselect question_id, id, position, round(score, 9) as score from win", "led", "revs"),
    ),
    "rt5_vector_hits": (
        _vector, sql(f"with {_SEARCH.strip()}\nselect question_id, id, round(vector_distance, 6) as vector_distance, vector_rank from vxr", "led", "revs"),
    ),
    "rt6_nearest": (
        _nearest,
        """with e as (select vec_id, user_id % 4 as org, cast(embedding as double[]) as v from embeddings join events on event_id = vec_id),
p as (select a.vec_id as question_id, b.vec_id as id, 1 - list_cosine_similarity(a.v, b.v) as dist from e a join e b on a.org = b.org),
r as (select *, row_number() over (partition by question_id order by round(dist, 9), id) as rank from p)
select question_id, id, round(dist, 6) as distance, rank from r where rank <= 10""",
    ),
    "rt7_distances": (
        _l2,
        """with e as (select vec_id as id, user_id % 4 as org, cast(embedding as double[]) as v from embeddings join events on event_id = vec_id),
o as (select org, arg_min(v, id) as o from e group by 1)
select id, round(list_distance(v, o), 6) as l2, round(1 - list_cosine_similarity(v, o), 6) as cosine from e join o using (org)""",
    ),
    "rt8_rt14_candidate_counts": (
        _counts,
        sql(
            f"""with {_SEARCH.strip()}
select question_id, case when qid % 5 <> 0 then 'used' else 'unavailable' end as vector_search, (select count(*) from txr x where x.question_id = q.question_id) as text_candidates,
 (select count(*) from vxr x where x.question_id = q.question_id) as vector_candidates from q""", "led", "revs",
        ),
    ),
    "rt10_rt11_fusion_without_trust": (
        _fuse_without_trust,
        sql(
            f"""with {_SEARCH.strip()},
z as (select *, row_number() over (partition by question_id order by rrf_score desc, id) as position2 from scored)
select question_id, id, position2 as position, round(rrf_score, 9) as score from z where position2 <= lim""", "led", "revs",
        ),
    ),
    "rt12_rt15_search": (
        _search,
        sql(
            f"""with {_SEARCH.strip()}
select w.question_id, w.position, w.id, l.property, 'source-' || l.source_id as source_name,
 case when w.known_at is null or l.valid_until_recorded_at <= w.known_at then {t('l.valid_until')} end as valid_until, w.vector_rank, w.text_rank,
 round(w.trust, 6) as trust, round(w.rrf_score, 9) as rrf_score, round(w.score, 9) as score from win w join led l using (id)""", "led", "revs",
        ),
    ),
    "rt13_text_only_search": (
        _text_only,
        sql(
            f"""with {_SEARCH.strip()},
z as (select x.question_id, x.id, q.lim, 1.0::double / (60 + text_rank) * ((1 - 0.3::double) + 0.3::double * (l.authority / 100.0::double * l.confidence::double)) as score
  from txr x join led l using (id) join q using (question_id)),
y as (select *, row_number() over (partition by question_id order by score desc, id) as position from z)
select question_id, id, position, round(score, 9) as score from y where position <= lim""", "led", "revs",
        ),
    ),
    "rt16_inverted_lists": (lambda s, d: _lists(s, d, "clustered"), None),
    "rt16_all_lists_probed": (
        _all_lists,
        """with e as (select vec_id, cast(embedding as double[]) as v from embeddings),
p as (select a.vec_id as question_id, b.vec_id as id, 1 - list_cosine_similarity(a.v, b.v) as dist from e a, e b),
r as (select *, row_number() over (partition by question_id order by round(dist, 9), id) as rank from p)
select question_id, id, round(dist, 6) as distance, rank from r where rank <= 10""",
    ),
    "rt16_lists_stored": (_list_sizes, "select count(*) as vectors, count(distinct vec_id) as ids, true as reads_part from embeddings"),
    "rt17_recall": _recall_bound("plain", 0.9, 1.0),
    "rt17_recall_clustered": _recall_bound("clustered", 0.95, 0.5),
    "rt18_retrieval_generation": (
        _generation,
        sql(
            """select organization_id, count(*) as generation from (select organization_id from led union all select organization_id from revs
 union all select organization_id from led join embeddings on vec_id = led.id) z group by 1""", "revs",
        ),
    ),
    "dr1_captured_contexts": (
        _context_heads,
        sql(
            f"""with {_search_sql(_PINNED, _PINNED).strip()},
n as (select question_id, count(*) as facts, max(position) as last from win group by 1)
select 'the latest ' || property || ' of ' || external_id as query, {t('valid_at')} as valid_at, {t('known_at')} as known_at,
 case when qid % 5 <> 0 then 'used' else 'unavailable' end as vector_search, facts, cast(last as int) as last, cast(ceiling + 1 as int) as scopes from q left join n using (question_id)""",
            "led", "revs",
        ),
    ),
    "dr1_captured_facts": (
        _context_facts,
        sql(
            f"""with {_search_sql(_PINNED, _PINNED).strip()}
select w.id as fact_version_id, w.position, round(w.score, 9) as score from win w""", "led", "revs",
        ),
    ),
    "dr2_retrieval_parameters": (
        _parameters,
        """with q as (select vec_id as i, event_type from embeddings join events on event_id = vec_id)
select 'q' || i as question_id, '{"entity_type":null,"external_ids":[],"limit":' || case when i % 4 = 0 then 20 else 10 end || ',"max_privacy_scope":null,"min_authority":' ||
 case when i % 11 = 0 then '70' else 'null' end || ',"min_confidence":' || case when i % 13 = 0 then '"0.75"' else 'null' end || ',"properties":' ||
 case when i % 7 = 0 then '["' || event_type || '"]' else '[]' end || ',"source_ids":[],"trust_weight":0.3}' as parameters from q""",
    ),
    "gr1_packed_labels": (
        lambda s, d: _packed(s, d).select("question_id", "label", "id"),
        sql(f"with {_SEARCH.strip()}\nselect question_id, 'F' || position as label, id from win", "led", "revs"),
    ),
    "gr2_rendered_contexts": (
        _rendered,
        sql(
            _LINES + "\nselect q.question_id, coalesce(facts_supplied, 0) as facts_supplied, sha256(coalesce(body, '(no facts)')) as context_sha from q left join cx using (question_id)", "led", "revs",
        ),
    ),
    "gr3_parsed_answers": (
        lambda s, d: gr.parse_answers(_outputs(s, d)).select("question_id", "answer", "insufficient", F.array_join("cited", ",").alias("cited"), "error"),
        """select 'q' || vec_id as question_id, case vec_id % 8 when 0 then 'no' when 1 then 'yes' when 2 then 'yes' when 3 then '' when 4 then null when 5 then null else 'It is so.' end as answer,
 case when vec_id % 8 in (4, 5) then null else vec_id % 8 = 0 end as insufficient, case vec_id % 8 when 0 then 'F1' when 1 then 'F1,F99' when 2 then '' when 3 then 'f1' when 4 then null
 when 5 then null else 'f2,F1,F2' end as cited, case when vec_id % 8 in (4, 5) then 'MalformedGenerationError' end as error from embeddings""",
    ),
    "gr4_citation_check": (
        lambda s, d: _checked(s, d).select("question_id", "status", F.array_join("cited_labels", ",").alias("cited"), F.array_join("rejected_labels", ",").alias("rejected")),
        sql(
            _GROUND + """
select question_id, status, case when status = 'answered' then 'F2,F1' else '' end as cited,
 case when n % 8 in (4, 5) then null when n % 8 = 1 then case when facts < 1 then 'F1,F99' else 'F99' end when n % 8 in (0, 3) and facts < 1 then case n % 8 when 0 then 'F1' else 'f1' end
 when n % 8 > 5 and facts < 1 then 'f2,F1,F2' when n % 8 > 5 and facts < 2 then 'f2,F2' else '' end as rejected from st""", "led", "revs",
        ),
    ),
    "gr5_assembled_answers": (
        _answers,
        sql(
            _GROUND + """
select s.question_id, 'the latest ' || q.property || ' of ' || q.external_id as question, case when facts = 0 then 'insufficient_evidence' else status end as status,
 case when facts = 0 then 'No facts you are allowed to see match this question at that time.' when status = 'answered' then 'It is so.' when status = 'insufficient_evidence' then 'no' end as answer,
 facts = 0 or status in ('answered', 'insufficient_evidence') as grounded, facts > 0 as model_called, facts as facts_supplied from st s join q using (question_id)""", "led", "revs",
        ),
    ),
    "gr5_resolved_citations": (
        _citations,
        sql(
            _GROUND + """
select s.question_id, cast(2 - w.position as int) as citation, 'F' || w.position as label, w.id as fact_version_id, 'source-' || l.source_id as source_name
 from st s join win w on w.question_id = s.question_id and w.position <= 2 join led l using (id) where s.status = 'answered'""", "led", "revs",
        ),
    ),
    "gr6_investigations": (
        _investigations,
        """with c as (select conv_id as i, count(*) as n from conversations group by 1),
k as (select *, case when i % 3 = 0 then 'ungrounded' when i % 3 = 2 and i % 4 <> 0 then 'ungrounded' when i % 4 = 0 then 'insufficient_evidence' else 'answered' end as status from c)
select i as run_id, status, case when status <> 'ungrounded' then 'because' end as answer, case when i % 3 <> 2 then 'v' || n else '' end as cited,
 case when i % 3 = 0 then 'v' || (n + 1) else '' end as rejected from k""",
    ),
    "gr7_context_leaks": (
        _leaks,
        sql(
            f"with {_SEARCH.strip()}\nselect question_id, case when exists (from win w where w.question_id = q.question_id) then 'USER/' else '' end as leaks from q", "led", "revs",
        ),
    ),
    "gr8_answer_matches": (_matches, "select event_id as id, event_id % 3 <> 0 and event_id % 5 <> 0 as answer_matches from events"),
    "gr9_run_traces": (
        _traces,
        """select conv_id as run_id, cast(row_number() over (partition by conv_id order by turn) - 1 as int) as call, role as tool, length(text) % 5 <> 0 as ok,
 case when length(text) % 5 = 0 then 'failed' end as error, cast(length(text) as int) as latency_ms from conversations
 where (conv_id % 4, conv_id % 3) in ((0, 0), (1, 1), (2, 2))""",
    ),
}
