"""Hybrid search: hard filters first, then text and vector branches, then rank fusion.

Every operator takes a table of questions, so one job answers any number of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import scalars as sc
from chronoweave.functions.frames import computed_once, frame_bytes, told_apart
from chronoweave.functions.privacy import PRIVACY_ORDER, scope_ordinal, visible_ordinal
from chronoweave.functions.stemming import search_tokens
from chronoweave.operators.embedding import build_search_docs
from chronoweave.operators import segments as sg
from chronoweave.operators.ordered import keep_top
from chronoweave.operators.temporal import as_known
from chronoweave.operators.vectors import PLACES, nearest_blocks
from chronoweave.session import checkpoint_root, cut_lineage

# Limits and ranking constants.
MAX_QUERY_CHARS = 1000
MAX_LIMIT = 50
MAX_FILTER_VALUES = 100
MAX_POOL = 200
RRF_K = 60
TRUST_WEIGHT = 0.3
TEXT_UNIT = 0.1

# Question terms up to this measured size are broadcast.
BROADCAST_BYTES = 64 << 20
TOKEN_SALTS = 32

# Columns a table of questions may leave out, with their types and defaults.
OPTIONAL = {
    "limit": ("int", 10),
    "trust_weight": ("double", TRUST_WEIGHT),
    "known_at": ("timestamp", None),
    "entity_type": ("string", None),
    "external_ids": ("array<string>", None),
    "properties": ("array<string>", None),
    "source_ids": ("array<string>", None),
    "min_authority": ("int", None),
    "min_confidence": ("double", None),
    "max_privacy_scope": ("string", None),
    "vector": ("array<float>", None),
    "role": ("string", "ADMIN"),
}


def _clean(c: Column) -> Column:
    """No filter when null or empty; else distinct and sorted."""
    return F.when(F.size(c) > 0, F.array_sort(F.array_distinct(c)))


def pool_size(limit: Column) -> Column:
    return F.least(F.lit(MAX_POOL), F.greatest(F.lit(40), 4 * limit))


def normalize_questions(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fill defaults, normalise, and split off what is out of bounds with a reason.

    Required: ``question_id, organization_id, query, valid_at``.
    """
    q = questions
    for name, (kind, default) in OPTIONAL.items():
        if name not in q.columns:
            q = q.withColumn(name, F.lit(default).cast(kind))
        elif default is not None:
            q = q.withColumn(name, F.coalesce(F.col(name), F.lit(default).cast(kind)))
    q = computed_once(
        q,
        {
            "query": sc.collapse(F.col("query")),
            "entity_type": sc.normalize_identifier(F.col("entity_type")),
            "external_ids": _clean(F.transform("external_ids", sc.normalize_external_id)),
            "properties": _clean(F.transform("properties", sc.normalize_identifier)),
            "source_ids": _clean(F.col("source_ids")),
            "pool": pool_size(F.col("limit")),
            "ceiling": visible_ordinal(F.col("role"), F.col("max_privacy_scope")),
        },
    )
    few = lambda c: F.coalesce(F.size(c) <= MAX_FILTER_VALUES, F.lit(True))
    reason = (
        F.when(F.coalesce(F.length("query"), F.lit(0)) == 0, "empty_query")
        .when(F.length("query") > MAX_QUERY_CHARS, "query_too_long")
        .when(~F.col("limit").between(1, MAX_LIMIT), "bad_limit")
        .when(~F.col("trust_weight").between(0.0, 1.0), "bad_trust_weight")
        .when(F.col("valid_at").isNull(), "missing_valid_at")
        .when(~(few("external_ids") & few("properties") & few("source_ids")), "too_many_filter_values")
        .when(F.col("min_authority").isNotNull() & ~F.col("min_authority").between(0, 100), "bad_min_authority")
        .when(F.col("min_confidence").isNotNull() & ~F.col("min_confidence").between(0, 1), "bad_min_confidence")
        .when(F.col("entity_type").isNotNull() & ~sc.identifier_ok(F.col("entity_type")), "bad_entity_type")
        .when(F.exists(F.coalesce("external_ids", F.array().cast("array<string>")), lambda x: ~sc.external_id_ok(x)), "bad_external_id")
        .when(F.exists(F.coalesce("properties", F.array().cast("array<string>")), lambda x: ~sc.identifier_ok(x)), "bad_property")
        .when(F.col("ceiling").isNull(), "bad_role_or_scope")
    )
    q = q.withColumn("reason", reason)
    return q.where(F.col("reason").isNull()).drop("reason"), q.where(F.col("reason").isNotNull())


# --- eligibility -------------------------------------------------------------------------------

_ROW_SIDE = (
    "valid_from", "valid_until", "recorded_at", "valid_until_recorded_at", "revoked_at", "scope",
    "entity_type", "external_id", "property", "source_id", "authority", "confidence",
)
_ASK_SIDE = (
    "valid_at", "known_at", "ceiling", "entity_type", "external_ids", "properties", "source_ids",
    "min_authority", "min_confidence",
)


def searchable(versions: DataFrame, revocations: DataFrame | None) -> DataFrame:
    """Versions with what the hard filters read: the scope ordinal and the revocation time."""
    v = versions.withColumn("scope", scope_ordinal("privacy_scope"))
    if revocations is None:
        return v.withColumn("revoked_at", F.lit(None).cast("timestamp"))
    gone = revocations.select("organization_id", F.col("fact_version_id").alias("id"), "revoked_at")
    return v.join(gone, ["organization_id", "id"], "left")


def eligible_pair(v: str = "", q: str = "q_") -> Column:
    """Hard filters between a version row and a question row (same tenant is the join key)."""
    c = lambda name: F.col(f"{v}{name}")
    a = lambda name: F.col(f"{q}{name}")
    K = a("known_at")
    in_time = (
        (K.isNull() | (c("recorded_at") <= K))
        & (c("valid_from") <= a("valid_at"))
        & (
            c("valid_until").isNull()
            | (c("valid_until") > a("valid_at"))
            | F.coalesce(c("valid_until_recorded_at") > K, F.lit(False))
        )
    )
    standing = c("revoked_at").isNull() | F.coalesce(c("revoked_at") > K, F.lit(False))
    listed = lambda column, values: a(values).isNull() | F.array_contains(a(values), c(column).cast("string"))
    return (
        in_time
        & standing
        & (c("scope") <= a("ceiling"))
        & (a("entity_type").isNull() | (a("entity_type") == c("entity_type")))
        & listed("external_id", "external_ids")
        & listed("property", "properties")
        & listed("source_id", "source_ids")
        & (a("min_authority").isNull() | (c("authority") >= a("min_authority")))
        & (a("min_confidence").isNull() | (c("confidence") >= a("min_confidence")))
    )


def time_cell(lasts: Column | None = None, start: Column | None = None) -> Column:
    """Versions of one class of duration that start within about its length; open ones all together."""
    lasts = sg.lasting() if lasts is None else lasts
    start = F.unix_micros("valid_from") if start is None else start
    return F.concat_ws("/", lasts, F.when(lasts < 30, F.floor(start / (sg.DAY_US * F.pow(F.lit(2.0), lasts)))))


def _eligible_pairs(rows: pd.DataFrame, asked: pd.DataFrame):
    """The same hard filters for a block of rows: which questions its bounds let in, and a function of one question's place and
    places of rows that tells which of these it may see."""
    far = 2**62  # later than any instant, and exact as a float

    def us(name, empty):
        return rows[name].fillna(empty).to_numpy(dtype=np.int64)

    recorded, start, until, learned = us("recorded_us", far), us("from_us", far), us("until_us", far), us("until_rec_us", -far)
    revoked = np.where(rows["revoked_us"].isna().to_numpy(), far + 1, us("revoked_us", 0))
    scope, authority, confidence = (rows[c].to_numpy(dtype=float, na_value=np.nan) for c in ("scope", "authority", "confidence"))
    T = asked["valid_at_us"].to_numpy(dtype=np.int64)
    K = asked["known_at_us"].fillna(far).to_numpy(dtype=np.int64)
    ceiling = asked["ceiling"].to_numpy()
    least, surest = (asked[c].fillna(-1).to_numpy(dtype=float) for c in ("min_authority", "min_confidence"))
    may = (recorded.min() <= K) & (start.min() <= T) & ((until.max() > T) | (learned.max() > K)) & (revoked.max() > K) & (np.fmin.reduce(scope) <= ceiling)
    # Filters by value: each column of the block is coded once, and each distinct list of values looked up once.
    listed = []
    for column, wanted in (
        ("entity_type", [None if k is None else (k,) for k in asked["entity_type"]]),
        ("external_id", [None if w is None else tuple(w) for w in asked["external_ids"]]),
        ("property", [None if w is None else tuple(w) for w in asked["properties"]]),
        ("source_id", [None if w is None else tuple(w) for w in asked["source_ids"]]),
    ):
        lists = {w for w, seen in zip(wanted, may, strict=True) if seen and w is not None}
        if not lists:
            continue
        codes, values = pd.factorize(rows[column].astype(str))
        place = {v: i for i, v in enumerate(values)}
        listed.append((wanted, codes, {w: np.unique([place[str(v)] for v in w if str(v) in place]).astype(np.int64) for w in lists}))

    def allowed(q: int, places: np.ndarray) -> np.ndarray:
        ok = (recorded[places] <= K[q]) & (start[places] <= T[q]) & ((until[places] > T[q]) | (learned[places] > K[q]))
        ok &= (revoked[places] > K[q]) & (scope[places] <= ceiling[q]) & (authority[places] >= least[q]) & (confidence[places] >= surest[q])
        for wanted, codes, numbers in listed:
            if wanted[q] is not None:
                ok &= np.isin(codes[places], numbers[wanted[q]])
        return ok

    return may, allowed


# --- branches ------------------------------------------------------------------------------------


def question_terms(questions: DataFrame) -> DataFrame:
    """(question, distinct search token)."""
    terms = search_tokens(sc.tokens(F.col("query")))
    return questions.withColumn("token", F.explode(F.array_distinct(terms)))


def text_hits(
    rows: DataFrame, docs: DataFrame, questions: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """(question_id, organization_id, id, text_score, text_rank) of versions sharing any token.

    The versions are laid out as segments in the shared folder first, so that a question meets only what it may see, and of
    that the best. Where a version's or a question's id is null or comes twice, the tokens of all rows of an id add up, which
    segments don't do: there question terms and postings are joined.
    """
    spark = rows.sparkSession
    if told_apart(rows, "organization_id", "id") and told_apart(docs, "organization_id", "id") and told_apart(questions, "question_id"):
        folder = f"{checkpoint_root(spark)}/text-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"
        return segment_hits(sg.build(rows, docs, folder), questions)
    return _joined_text_hits(rows, docs, questions, broadcast_bytes=broadcast_bytes)


def _joined_text_hits(rows: DataFrame, docs: DataFrame, questions: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The same by a join of tokens.

    Question terms of up to ``broadcast_bytes``, as measured, are broadcast: the tokens of one version stay
    in one task from the postings to the score, so the pairs are summed and cut to the pool before
    anything is shuffled. Beyond that both sides meet by token, each token spread over salts.
    """
    asks = question_terms(questions).select(
        "question_id", F.col("organization_id"), "token", F.col("pool").alias("q_pool"),
        *[F.col(c).alias(f"q_{c}") for c in _ASK_SIDE],
    )
    postings = (
        rows.select("organization_id", "id", *_ROW_SIDE)
        .join(docs, ["organization_id", "id"])
        .repartition("organization_id", "id")
        .withColumn("token", F.explode(F.array_distinct("tokens")))
        .withColumn("__tf", F.size(F.filter("tokens", lambda t: t == F.col("token"))))
        .drop("tokens")
    )
    if frame_bytes(asks) <= broadcast_bytes:
        met = postings.join(F.broadcast(asks), ["organization_id", "token"])
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(TOKEN_SALTS - 1)))
        met = postings.withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(TOKEN_SALTS)).cast("int")).join(
            asks.withColumn("__salt", salts), ["organization_id", "token", "__salt"]
        )
    scored = (
        met.where(eligible_pair())
        .groupBy("question_id", "organization_id", "id", "q_pool")
        .agg((F.sum("__tf") * TEXT_UNIT).alias("text_score"))
    )
    top = keep_top(scored, ["question_id"], [F.col("text_score").desc(), F.col("id")], MAX_POOL, "text_rank")
    return top.where(F.col("text_rank") <= F.col("q_pool")).drop("q_pool")


def asked_of_segments(questions: DataFrame) -> DataFrame:
    """Normalised questions with their tokens, as segments read them."""
    return sg.asked_columns(questions, F.array_distinct(search_tokens(sc.tokens(F.col("query")))))


def segment_hits(segments: DataFrame, questions: DataFrame) -> DataFrame:
    """What :func:`text_hits` gives, from stored segments (:mod:`chronoweave.operators.segments`)."""
    return sg.text_hits(segments, asked_of_segments(questions), MAX_POOL)


def vector_hits(rows: DataFrame, embeddings: DataFrame, questions: DataFrame, *, model: str, dims: int) -> DataFrame:
    """(question_id, organization_id, id, vector_distance, vector_rank), nearest first."""
    us = lambda name: F.unix_micros(name)
    held = embeddings.where(F.col("model") == model).select(
        "organization_id", F.col("fact_version_id").alias("id"), "embedding"
    )
    block = rows.join(held, ["organization_id", "id"]).select(
        "organization_id", "id", "embedding", sg.lasting().alias("class"), us("valid_from").alias("from_us"), us("valid_until").alias("until_us"),
        us("recorded_at").alias("recorded_us"), us("valid_until_recorded_at").alias("until_rec_us"),
        us("revoked_at").alias("revoked_us"), "scope", "authority",
        F.col("confidence").cast("double").alias("confidence"), "entity_type", "external_id", "property", "source_id",
    )
    asked = questions.where(F.col("vector").isNotNull()).select(
        "question_id", "organization_id", "vector", "pool", us("valid_at").alias("valid_at_us"),
        us("known_at").alias("known_at_us"), "ceiling", "entity_type", "external_ids", "properties", "source_ids",
        F.col("min_authority").cast("double").alias("min_authority"), "min_confidence",
    )
    # Rows of one class of duration that start about together lie in one cell and, sorted so, in one batch: its bounds are tight.
    far = F.lit(sg.FAR)
    cell = time_cell(F.col("class"), F.col("from_us"))
    bounds = {
        "min_from": F.min("from_us"), "max_until": F.max(F.coalesce("until_us", far)), "min_rec": F.min("recorded_us"),
        "max_learned": F.max("until_rec_us"), "min_scope": F.min("scope"),
    }
    known = F.col("known_at_us")
    meets = (
        (F.col("min_from") <= F.col("valid_at_us")) & (F.col("min_scope") <= F.col("ceiling")) & (known.isNull() | (F.col("min_rec") <= known))
        & ((F.col("max_until") > F.col("valid_at_us")) | F.coalesce(F.col("max_learned") > known, F.lit(False)))
    )
    order = ["organization_id", "class", "from_us", "id"]
    hits = nearest_blocks(block, asked, group=["organization_id"], dims=dims, mask=_eligible_pairs, cell=cell, bounds=bounds, meets=meets, order=order)
    tenants = questions.select("question_id", "organization_id")
    return hits.join(tenants, "question_id").select(
        "question_id", "organization_id", "id", F.round("distance", PLACES).alias("vector_distance"), F.col("rank").alias("vector_rank")
    )


def trust(authority: Column, confidence: Column) -> Column:
    return (authority / F.lit(100.0)) * confidence.cast("double")


def fuse(
    vector: DataFrame | None,
    text: DataFrame,
    trusts: DataFrame,
    questions: DataFrame,
    *,
    rrf_k: int = RRF_K,
) -> DataFrame:
    """Reciprocal rank fusion scaled by trust; the best ``limit`` per question, ties by id."""
    if rrf_k < 1:
        raise ValueError("rrf_k must be positive")
    t = text.select(
        "question_id", "organization_id", "id", F.lit(None).cast("int").alias("vector_rank"),
        F.lit(None).cast("double").alias("vector_distance"), "text_rank", "text_score",
    )
    both = t
    if vector is not None:
        both = t.unionByName(
            vector.select(
                "question_id", "organization_id", "id", "vector_rank", "vector_distance",
                F.lit(None).cast("int").alias("text_rank"), F.lit(None).cast("double").alias("text_score"),
            )
        )
    merged = both.groupBy("question_id", "organization_id", "id").agg(
        F.min("vector_rank").alias("vector_rank"), F.min("vector_distance").alias("vector_distance"),
        F.min("text_rank").alias("text_rank"), F.max("text_score").alias("text_score"),
    )
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    scored = (
        merged.join(trusts.select("organization_id", "id", "trust"), ["organization_id", "id"], "left")
        .withColumn("trust", F.coalesce("trust", F.lit(0.0)))
        .join(questions.select("question_id", "limit", "trust_weight"), "question_id")
        .withColumn("rrf_score", part("vector_rank") + part("text_rank"))
    )
    w = F.col("trust_weight")
    scored = scored.withColumn("score", F.col("rrf_score") * ((1 - w) + w * F.col("trust")))
    top = keep_top(scored, ["question_id"], [F.col("score").desc(), F.col("id")], MAX_LIMIT, "position")
    return top.where(F.col("position") <= F.col("limit")).drop("limit", "trust_weight")


def candidate_counts(vector: DataFrame | None, text: DataFrame, questions: DataFrame) -> DataFrame:
    """Per question how many candidates each branch gave and whether the vector branch ran."""
    t = text.groupBy("question_id").agg(F.count(F.lit(1)).alias("text_candidates"))
    out = questions.select(
        "question_id", F.when(F.col("vector").isNotNull(), "used").otherwise("unavailable").alias("vector_search")
    ).join(t, "question_id", "left")
    if vector is None:
        return out.withColumn("vector_candidates", F.lit(0)).fillna(0)
    v = vector.groupBy("question_id").agg(F.count(F.lit(1)).alias("vector_candidates"))
    return out.join(v, "question_id", "left").fillna(0, subset=["text_candidates", "vector_candidates"])


def hydrate(hits: DataFrame, versions: DataFrame, sources: DataFrame, questions: DataFrame) -> DataFrame:
    """Winners with their version as known at K, and their source."""
    s = sources.select(
        "organization_id", F.col("id").alias("source_id"), F.col("name").alias("source_name"), "source_type"
    )
    rows = (
        hits.join(questions.select("question_id", "known_at"), "question_id")
        .join(versions, ["organization_id", "id"])
        .join(s, ["organization_id", "source_id"], "left")
    )
    return as_known(rows, F.col("known_at"))


def search(
    versions: DataFrame,
    sources: DataFrame,
    questions: DataFrame,
    *,
    revocations: DataFrame | None = None,
    embeddings: DataFrame | None = None,
    docs: DataFrame | None = None,
    segments: DataFrame | None = None,
    model: str | None = None,
    dims: int = 1536,
) -> DataFrame:
    """End to end: one row per question and winner, with its score breakdown.

    Pass ``docs`` (a stored ``build_search_docs`` result) to skip tokenising the ledger again, or ``segments``
    (of the same versions and revocations) to read only what each question may see.
    """
    q, _ = normalize_questions(questions)
    q = cut_lineage(q)  # every branch reads the questions
    rows = searchable(versions, revocations)
    filters = ["organization_id", "pool", *_ASK_SIDE]
    if segments is not None:
        text = asked_once(q, ["query", *filters], lambda some: segment_hits(segments, some))
    else:
        held = build_search_docs(versions) if docs is None else docs
        text = asked_once(q, ["query", *filters], lambda some: text_hits(rows, held, some))
    vector = None
    if embeddings is not None:
        near = q.where(F.col("vector").isNotNull())
        vector = asked_once(near, ["vector", *filters], lambda some: vector_hits(rows, embeddings, some, model=model, dims=dims))
    trusts = versions.select(
        "organization_id", "id", trust(F.col("authority"), F.col("confidence")).alias("trust")
    )
    return hydrate(fuse(vector, text, trusts, q), versions, sources, q)


def asked_once(questions: DataFrame, columns: Sequence[str], answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``answer(questions)``, where questions alike in ``columns`` are asked once and share the hits."""
    if not told_apart(questions, "question_id"):
        return answer(questions)
    q = questions.withColumn("__alike", F.sha2(F.to_json(F.struct(*columns)), 256))
    first = q.groupBy("__alike").agg(F.min("question_id").alias("__first"))
    shared = cut_lineage(q.select("question_id", "__alike").join(first, "__alike").select("question_id", "__first"))
    if shared.where(F.col("question_id") != F.col("__first")).isEmpty():
        return answer(questions)
    asked = questions.join(shared.where(F.col("question_id") == F.col("__first")).select("question_id"), "question_id", "left_semi")
    hits = answer(cut_lineage(asked)).withColumnRenamed("question_id", "__first")
    return hits.join(shared, "__first").drop("__first")


def retrieval_generation(events: DataFrame) -> DataFrame:
    """Per tenant how often its searchable state changed; a cached result of a lower count is stale."""
    bumps = events.where(F.col("type").isin("fact.version_recorded", "fact.embedding_stored", "fact.revoked"))
    return bumps.groupBy("organization_id").agg(F.count(F.lit(1)).alias("generation"))


def scopes_below(ceiling: Column) -> Column:
    """The names of all scopes up to a ceiling ordinal."""
    return F.slice(F.array(*[F.lit(s) for s in PRIVACY_ORDER]), F.lit(1), ceiling + 1)
