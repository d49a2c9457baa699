"""Vectors near each other, ranked search and collocations against brute force."""

import collections
import math
import random
import re

import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_llm_dedup import roots

from chronoweave.llm import cap_filters, collocations, common, ranked_search

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
CLASH = ("id", "h1", "h2", "v", "copies", "unit", "filters", "filter", "ball", "left", "right", "dim", "links", "to", "rep", "root", "node", "none", "a", "b")


def vectors(spark, rows):
    frame = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], b) for i, v, b in rows], VECTORS)
    return frame.withColumns({c: F.lit("clash") for c in CLASH}).repartition(3)


def linked(rows, least=0.93):
    """``vec_id, n_links, component_id, kept`` by all pairs."""
    rows = list(dict.fromkeys((i, None if v is None else tuple(None if x is None else float(np.float32(x)) for x in v), b) for i, v, b in rows))

    def sound(i, v, b):
        return i is not None and b is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    units = [np.array(v) / np.max(np.abs(v)) if sound(i, v, b) else None for i, v, b in rows]
    units = [u if u is None else u / np.sqrt(u @ u) for u in units]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= least]
    n = collections.Counter(x for p in pairs for x in p)
    ids = sorted({i for i, _, _ in rows if i is not None})
    at = {i: k for k, i in enumerate(ids)}
    of = roots(len(ids), [(at[rows[a][0]], at[rows[b][0]]) for a, b in pairs])
    component = {i: ids[of[at[i]]] for i in ids}
    return collections.Counter((i, n[k], component.get(i), i == component.get(i)) for k, (i, _, _) in enumerate(rows)), len(pairs)


def got(frame):
    return collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in frame.collect())


def test_odd_vectors(spark):
    one, two = [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.01]
    rows = [(1, one, 0), (2, two, 0), (3, one, 0), (3, one, 0), (4, one, 1), (5, one, None), (None, one, 0), (6, None, 0), (7, [], 0), (8, [0.0] * 4, 0),
            (9, [1.0, None, 3.0, 4.0], 0), (10, [math.nan, 2.0, 3.0, 4.0], 0), (11, [math.inf, 2.0, 3.0, 4.0], 0), (12, [x * 1e30 for x in one], 0), (13, [1.0], 0),
            (14, [2.0], 0), (15, [-1.0], 0), (16, [1.0, 0.0], 0), (17, [0.99, 0.1], 0), (18, one, 1), (18, [4.0, -3.0, 2.0, -1.0], 1), (19, [4.0, -3.0, 2.0, -1.0], 1),
            (None, None, None), (20, [1e-30, 2e-30, 3e-30, 4e-30], 0)]
    assert got(cap_filters.near_duplicates(vectors(spark, rows))) == linked(rows)[0]
    assert cap_filters.near_duplicates(vectors(spark, [])).count() == 0


@pytest.mark.parametrize("block", [8, 1024])
def test_clusters_near_and_wide(spark, block):
    """Tight clusters (balls), wide ones (loose vectors of hot filters, balls beside balls) and single vectors."""
    draw = np.random.default_rng(5)
    rows = []
    for size, noise in ((120, 0.05), (60, 0.22), (60, 0.3), (40, 0.02), (20, 0.4)):
        centre = draw.standard_normal(24)
        rows += [centre / np.linalg.norm(centre) + noise * draw.standard_normal(24) / math.sqrt(24) for _ in range(size)]
    rows += list(draw.standard_normal((200, 24)))
    rows = [(int(k), v.astype(np.float32), 0 if k % 3 else 1) for k, v in zip(draw.permutation(len(rows)), rows, strict=True)]
    want, pairs = linked(rows)
    found = got(cap_filters.near_duplicates(vectors(spark, rows), block=block))
    reached = sum(n * m for (_, n, _, _), m in found.items()) / 2
    assert 0.98 * pairs <= reached <= pairs
    wanted = {i: n for i, n, _, _ in want}
    assert all(n <= wanted[i] for i, n, _, _ in found)


@pytest.mark.parametrize(("dim", "size"), [(3, 100), (8, 5_000), (64, 5_000), (64, 3_000_000), (300, 2_000)])
def test_code_decodes_all_directions_and_reaches_its_recall(dim, size):
    codes = cap_filters.fitted(dim, size, 0.93)
    assert cap_filters.shared(codes, *cap_filters.pairs_at(dim, 0.93, 1000, 99)).mean() >= 0.975
    units = np.random.default_rng(3).standard_normal((20, dim))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    for code in codes.codes[:2] if codes.span < 3_000_000 else []:
        row, name = code.decode(units)
        total = 0.0
        for s in code.scores(units):
            total = (total[:, :, None] + s[:, None, :]).reshape(len(units), -1) if not np.isscalar(total) else s
        passed = total >= np.minimum(code.least, total.max(axis=1, keepdims=True))
        want = {(int(a), int(b)) for a, b in zip(*np.nonzero(passed), strict=True)}
        assert set(zip(row.tolist(), name.tolist(), strict=True)) == want


def brute_search(docs, items, k):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    held = [(d, collections.Counter(pattern.findall((t or "").translate(lower)))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, words, df = len(held), sum(c.total() for _, c in held), collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for d, c in held:
            m = 50 + (50 * c.total() * n) // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(pattern.findall((text or "").translate(lower))) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return collections.Counter(out)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_ranked_search(spark, k):
    draw = random.Random(k)
    names = ["der", "die", "das", *(f"w{i}" for i in range(60))]
    texts = [(i, " ".join(draw.choices(names, weights=[30, 20, 10, *range(60, 0, -1)], k=draw.randint(1, 60)))) for i in range(300)]
    texts += [(d, t) for d, t, _ in corpus.ROWS] + texts[:5]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in texts], "doc_id long, text string, term string, shard string").repartition(4)
    items = [(str(i), " ".join(draw.choices(names, k=draw.randint(1, 12)))) for i in range(30)]
    items += [("n", None), ("e", ""), ("u", "Unknown words"), ("w", "!?"), ("0", "another text, DER 0"), (None, "die w3"), items[0]]
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, item int")
    for shard in (1 << 10, 8 << 20):
        rows = ranked_search.search(ranked_search.index(docs, k=k, pair_terms=8, shard_bytes=shard), asked).collect()
        assert collections.Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in rows) == brute_search(texts, items, k)


def test_ranked_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.search(ranked_search.index(corpus.none(spark)), items).count() == 0
    assert ranked_search.search(ranked_search.index(corpus.docs(spark)), items.limit(0)).count() == 0


def test_pairs_bound_more_than_terms_do():
    """Two frequent terms that never meet: with their pair the rest is out of reach sooner, and fewer postings are read."""
    draw = np.random.default_rng(1)
    docs = np.arange(4000)
    half = draw.permutation(docs)
    rare = np.sort(half[:60])
    lists = [(rare, np.full(60, 900)), (np.sort(half[:2000]), draw.integers(300, 500, 2000)), (np.sort(half[2000:]), draw.integers(300, 480, 2000))]
    pairs = {(1, 2): 0, (0, 1): 1400, (0, 2): 0}
    alone = ranked_search.best_of(lists, ranked_search.Bounds([900, 499, 479], {}), 4000, 50, 0)
    both = ranked_search.best_of(lists, ranked_search.Bounds([900, 499, 479], pairs), 4000, 50, 0)
    top = lambda found: sorted(zip((-found[1]).tolist(), found[0].tolist(), strict=True))[:50]
    assert top(alone) == top(both) and both[2] < alone[2]


def brute_collocations(rows, least, longest, top):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang or "und"] += len(w)
            f[lang or "und"].update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        own = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        inside = {g[i:j] for g, a in own.items() for i in range(len(g)) for j in range(i + 2, len(g) + 1) if j - i < len(g) and counts[g[i:j]] == a}
        scored = []
        for g, a in own.items():
            if g not in inside:
                s, k = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-s, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "gathered", "pieces"), [(2, 40, 4096), (3, 3_000_000, 3), (1, 200, 7)])
def test_collocations(spark, monkeypatch, least, gathered, pieces):
    monkeypatch.setattr(collocations, "GATHERED", gathered)
    monkeypatch.setattr(collocations, "PIECES", pieces)
    draw = random.Random(least)
    rows = [(t if t is None else t[:3000], b) for _, t, b in corpus.ROWS]
    rows += [(" ".join(draw.choices(["a", "b", "C", "d.", "é,", "f\t", "g\n", "the", "\x0b"], k=40)), draw.choice(["en", "de", None, "und"])) for _ in range(60)]
    frame = spark.createDataFrame([(t, b, "x", 1) for t, b in rows], "text string, lang string, phrase string, n int").repartition(3)
    found = collocations.collocations(frame, least=least, longest=4, top=40).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found) == brute_collocations(rows, least, 4, 40)


def test_tokens_are_cut_between_pieces(monkeypatch):
    text = "One two, three. ".encode() * 50 + b"x" * 300
    whole = [w for part in collocations.tokens(text) for w in part]
    monkeypatch.setattr(collocations, "CUT_BYTES", 20)
    parts = list(collocations.tokens(text))
    assert len(parts) > 20 and [w for part in parts for w in part] == whole


def test_collocations_of_nothing(spark):
    assert collocations.collocations(corpus.none(spark)).count() == 0
    assert collocations.collocations(corpus.docs(spark)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_slots_let_every_frequent_phrase_pass(spark):
    words = spark.createDataFrame([("en", "a b", "c", 5), ("de", "", "x", 7)], "lang string, prefix string, next string, n long")
    bits = collocations.bitmap(common.stored(collocations.hashed(words), "test"))
    of = common.Memo(collocations._word_hash)
    for lang, phrase in ((b"en", [b"a", b"b", b"c"]), (b"de", [b"x"])):
        slot = collocations.phrase_hash(lang, phrase, of) >> (64 - collocations.SLOTS)
        assert bits[slot >> 3] >> (slot & 7) & 1
    assert sum(x.bit_count() for x in bits) == 2
