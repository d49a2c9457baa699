"""Near duplicates, repeated passages and strings, and contamination, against brute force."""

import collections
import hashlib
import random
import re

import corpus
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chronoweave.llm import common, decontamination, paragraphs, repeated_strings, simhash


def roots(n, pairs):
    forest = common.Forest(n)
    for a, b in pairs:
        forest.join(a, b)
    return [forest.root(i) for i in range(n)]


def test_components_of_chains_stars_and_rings(spark):
    draw = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 900)] + [(1000 + i, 1000 + (i + 1) % 50) for i in range(50)]
    pairs += [(draw.randrange(2000, 2600), draw.randrange(2000, 2600)) for _ in range(450)]
    draw.shuffle(pairs)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(3000, pairs)
    assert all(got.get(i, i) == want[i] for i in range(3000))
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check_simhash(rows, docs, block):
    prints = [fingerprint(t) for _, t in docs]
    near = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    of = roots(len(docs), near)
    least = {}
    for (doc, _), r in zip(docs, of, strict=True):
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    want = collections.Counter((doc, f"{p:016x}", least.get(r)) for (doc, _), p, r in zip(docs, prints, of, strict=True))
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == want


@pytest.mark.parametrize("block", [2, 512])
def test_simhash_rows(spark, block):
    rows = simhash.near_duplicates(corpus.docs(spark), block=block).collect()
    check_simhash(rows, [(d, t) for d, t, _ in corpus.ROWS], block)


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(corpus.none(spark)).count() == 0
    assert simhash.distinct_documents(corpus.none(spark)).count() == 0


@pytest.mark.parametrize("block", [8, 64])
def test_links_lose_none_in_dense_groups(spark, block):
    """Hundreds of fingerprints around a few centres: every group's forest must connect what all pairs connect."""
    draw = random.Random(7)
    prints = set()
    for _ in range(6):
        centre = draw.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(draw.randint(0, 4)):
                x ^= 1 << draw.randrange(64)
            prints.add(x)
    prints = sorted(prints | {draw.getrandbits(64) for _ in range(300)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = common.stored(spark.createDataFrame([(p,) for p in signed], "fp long"), "test")
    got = {(r.a, r.b) for r in simhash.links(frame, block=block).collect()}
    at = {p: i for i, p in enumerate(signed)}
    assert all((prints[at[a]] ^ prints[at[b]]).bit_count() <= 3 for a, b in got)
    every = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    assert roots(len(prints), [(at[a], at[b]) for a, b in got]) == roots(len(prints), every)


def test_thresholds_keep_the_pigeonhole_sum():
    costs = [[5.0, 9.0, 40.0], [1.0, 2.0, 3.0], [4.0, 4.5, 60.0]]
    cost, chosen = simhash.allot(costs, 1)
    assert sum(chosen) == 1 and min(chosen) >= -1
    assert cost == sum(c[t] for c, t in zip(costs, chosen, strict=True) if t >= 0) <= min(3.0 + 4.0, 5.0 + 2.0)
    draw = np.random.default_rng(1)
    correlation = np.corrcoef(draw.random((64, 200)))
    for m in (2, 3, 4):
        groups = simhash.group_bits(correlation, m)
        assert sorted(b for g in groups for b in g) == list(range(64)) and max(map(len, groups)) - min(map(len, groups)) <= 1


def test_distinct_documents(spark):
    kept = simhash.distinct_documents(corpus.docs(spark))
    assert kept.columns == corpus.docs(spark).columns
    texts = [(d, t) for d, t, _ in corpus.ROWS]
    prints = [fingerprint(t) for _, t in texts]
    of = roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    rows = kept.collect()
    assert len(rows) == len(set(of))
    for r in rows:  # the smallest id of its component
        group = of[texts.index((r.doc_id, r.text))]
        assert r.doc_id == min((d for (d, _), g in zip(texts, of, strict=True) if g == group and d is not None), default=None)


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def ascii_words(text):
    return WORD.findall((text or "").translate(str.maketrans(decontamination.UPPER, decontamination.LOWER)))


def contamination(docs, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = ascii_words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = ascii_words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if (k := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[k]
        out.append((doc, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


ITEMS = [
    (1, "fox jumps over the lazy dog while seven small birds sing in the old tree by the river"), (1, "fox jumps over"), (20, "DOG, while: seven!"),
    (3, None), (4, ""), (5, "... !!"), (6, "one"), (7, "w1x1 w2x2 w3x3 w4x4 w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11 w12x12 w13x0 w14x1 w15x2"),
    (8, "no document says these words at all"), (9, "line again and again and again"), (9, "line again and again and again"),
]


@pytest.mark.parametrize("limit", [1 << 20, 200])
def test_contamination_rows(spark, limit):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("window", F.lit("clash"))
    rows = decontamination.contamination(corpus.docs(spark), items, limit=limit).collect()
    key = lambda r: (r[0] or -1, *r[1:])
    want = contamination([(d, t) for d, t, _ in corpus.ROWS], ITEMS)
    got = [(r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in rows]
    assert sorted(map(key, got)) == sorted(map(key, want)) and all(r.n_items == len(r.item_ids) for r in rows)
    clean = decontamination.clean_documents(corpus.docs(spark), items, limit=limit)
    assert clean.columns == corpus.docs(spark).columns and clean.count() == sum(not w[-1] for w in want)


def test_contamination_of_and_by_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontamination.contamination(corpus.docs(spark), none).collect()
    assert len(rows) == len(corpus.ROWS) and not any(r.n_hit or r.n_items or r.contaminated for r in rows)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.contamination(corpus.none(spark), items).count() == 0


def test_contamination_is_native(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = decontamination.contamination(docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def repeats(docs):
    """Document, bytes, removed, runs and what is left, byte by byte; ``docs`` in order, equal (id, text) once."""
    seen, out = set(), {}
    for doc, text in docs:
        data = (text or "").encode()
        cover = bytearray(len(data))
        for p in range(len(data) - 99):
            if (s := data[p : p + 100]) in seen:
                cover[p : p + 100] = b"\1" * 100
            else:
                seen.add(s)
        kept = bytes(c for c, m in zip(data, cover, strict=True) if not m)
        runs = sum(1 for i, m in enumerate(cover) if m and not (i and cover[i - 1]))
        out[doc, text] = (len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def check_repeats(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    hashed = {(r.doc_id, r.text): r.h for r in frame.select("doc_id", "text", common.text_hash(F.col("text")).alias("h")).collect()}
    order = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0, hashed[d]))
    want = repeats(order)
    rows = repeated_strings.report(frame.repartition(4)).collect()
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)
    assert got == collections.Counter((d, *want[d, t]) for d, t in docs)


def test_repeated_strings_of_odd_texts(spark):
    short = [(d, (t or "")[:3000] if t and len(t) > 3000 else t) for d, t, _ in corpus.ROWS]
    check_repeats(spark, short)
    assert repeated_strings.report(corpus.none(spark)).count() == 0
    assert repeated_strings.report(corpus.docs(spark)).count() == len(corpus.ROWS)


@pytest.mark.parametrize("letters", ["ab", "abcdefghij klmnop", "é漢a "])
def test_repeated_strings_of_random_copies(spark, letters):
    draw = random.Random(letters)
    base = ["".join(draw.choice(letters) for _ in range(700)) for _ in range(4)]
    docs = []
    for i in range(60):
        a, b = sorted(draw.sample(range(700), 2))
        text = draw.choice(base)[a:b] + draw.choice(base)[b:] + "".join(draw.choice(letters) for _ in range(draw.randint(0, 60)))
        at = draw.randrange(len(text))
        docs.append((i, text[:at] + draw.choice(letters) + text[at + 1 :]))
    docs += [(100, "ab" * 300), (101, "ab" * 55 + "c" + "ab" * 80), (102, "a" * 99), (103, "a" * 101), (104, "a" * 100)]
    check_repeats(spark, docs)


def paragraph_removals(docs, similarity=0.8):
    """For each document in order: removed paragraphs, and the documents whose paragraphs stay."""
    units = []
    for doc, text in docs:
        data = (text or "").encode()
        units += [(doc, text, k, tuple(data[s:e].lower().split())) for k, (s, e) in enumerate(paragraphs.spans(data))]
    kinds = sorted({u[3] for u in units})
    sets = [frozenset(k[i : i + 5] for i in range(max(1, len(k) - 4))) for k in kinds]
    near = [(i, j) for i in range(len(kinds)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9]
    of = dict(zip(kinds, roots(len(kinds), near), strict=True))
    stays, gone = {}, collections.defaultdict(list)
    for doc, text, k, words in units:
        if (first := stays.setdefault(of[words], (doc, k))) and first != (doc, k):
            gone[doc, text].append((k, first[0]))
    return gone


def test_paragraph_spans_cover_lines():
    text = b"A b c d e f g h i. J k l. M n o p q r s t u v w x.\nshort one\n\nAa bb cc dd ee ff gg hh ii jj.\n"
    parts = [text[s:e] for s, e in paragraphs.spans(text)]
    assert parts == [b"A b c d e f g h i. ", b"J k l. M n o p q r s t u v w x.", b"Aa bb cc dd ee ff gg hh ii jj."]
    assert paragraphs.without(text, [2]) == b"A b c d e f g h i. J k l. M n o p q r s t u v w x.\nshort one\n\n"
    assert paragraphs.without(text, [0]).startswith(b"J k l.") and paragraphs.without(None, []) is None and paragraphs.spans(b"") == []


def test_bands_reach_the_recall():
    bands, rows = paragraphs.tune()
    assert 1 - (1 - 0.8**rows) ** bands >= paragraphs.RECALL and rows > 1


@pytest.mark.parametrize("block", [2, 256])
def test_paragraph_rows(spark, block):
    docs = [(d, t) for d, t, _ in corpus.ROWS if d != 9 and d is not None]
    frame = corpus.docs(spark, [r for r in corpus.ROWS if r[0] != 9 and r[0] is not None])
    gone = paragraph_removals(docs)
    rows = paragraphs.report(frame, block=block).collect()
    for r in rows:
        text = dict(docs)[r.doc_id]
        own = gone.get((r.doc_id, text), [])
        kept = paragraphs.without((text or "").encode(), [k for k, _ in own])
        assert (r.n_removed, r.first_doc_ids, r.kept_sha256) == (len(own), sorted({f for _, f in own}), hashlib.sha256(kept).hexdigest())
        assert r.class_id == min({f for _, f in own}, default=r.doc_id)
    assert len(rows) == len(docs)
    passage = {r.doc_id: r for r in rows}[11]  # the passage within a longer line, after other words
    assert passage.n_removed >= 5 and passage.first_doc_ids == [10]
    clean = paragraphs.deduplicated(corpus.docs(spark), block=block)
    assert clean.columns == corpus.docs(spark).columns and clean.count() == len(corpus.ROWS)
    texts = {r.doc_id: r.text for r in clean.filter("doc_id in (4, 5, 11, 14)").collect()}
    assert texts[4] is None and texts[5] == "" and texts[14] == "x" * 5000 and "passage3" not in texts[11]


def windows(text, size=50):
    words = text.lower().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def removed_share(spark, docs, passages):
    """Of the word positions of ``passages`` (one for each document), how many are cut out; every later document that shares
    50 words in a row with an earlier one must lose some. ``docs``: texts, the first of each passage before the others."""
    rows = paragraphs.cleaned(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    after, seen, all_, left = {r.doc_id: r.text for r in rows}, set(), 0, 0
    for i, text in enumerate(docs):
        own = windows(text)
        if own & seen:
            assert len(after[i]) < len(text), (i, text)
            words = collections.Counter(passages[i].split())
            all_ += words.total()
            left += (words & collections.Counter(after[i].split())).total()
        else:
            assert after[i] == text
        seen |= own
    return 1 - left / all_


@pytest.mark.parametrize("kind", ["sentences", "bare", "verse"])
def test_shared_passages_are_met_wherever_they_start(spark, kind):
    """Against raw shared 50-word windows, without ``spans``: each passage stands in three texts behind other words."""
    draw, count = random.Random(kind), iter(range(10**9))
    ends = [".", "!", "?", "", "", "", "", "", "", "", "", ""] if kind == "sentences" else [""]
    some = lambda n: [f"w{next(count)}x{draw.randrange(10**6)}" + draw.choice(ends) for _ in range(n)]
    docs, passages = [], []
    for _ in range(100):
        words = some(60)
        lines = [words[i : i + 5] for i in range(0, 60, 5)]
        passage = "\n".join(map(" ".join, lines)) if kind == "verse" else " ".join(words)
        for _ in range(3):
            before, after = some(draw.randrange(1, 40)), some(draw.randrange(1, 40))
            docs.append(" ".join(before) + ("\n" if kind == "verse" else " ") + passage + ("\n" if kind == "verse" else " ") + " ".join(after))
            passages.append(passage)
    assert removed_share(spark, docs, passages) > 0.7


def test_scripts_without_blanks_and_rows_of_short_lines():
    draw = random.Random(1)
    signs = lambda n: "".join(chr(draw.randrange(0x4E00, 0x9FFF)) for _ in range(n))
    for _ in range(100):
        passage = signs(60)
        a, b = ((signs(draw.randrange(1, 30)) + passage + signs(draw.randrange(1, 30))).encode() for _ in range(2))
        pieces = [{data[s:e] for s, e in paragraphs.spans(data)} for data in (a, b)]
        assert sum(map(len, pieces[0] & pieces[1])) > 60
        assert b"".join(a[s:e] for s, e in paragraphs.spans(a)) == a and a.decode() and all(p.decode() for p in pieces[0])
    items = b"- one two\n- three\n\n- four five\n- six seven eight\n"
    assert [items[s:e] for s, e in paragraphs.spans(items)] == [items[:-1]]
    assert paragraphs.without(b"a\n" + b"x y z\n" * 2, []) == b"a\n" + b"x y z\n" * 2 and paragraphs.spans(b"one two\nthree\n") == []
    texts = [items, None, b"", a, items * 30, b" \n", b"x " * 3000]
    assert paragraphs.spans_of(texts) == [paragraphs.spans(t or b"") for t in texts]
    assert all(len((items * 30)[s:e].split()) >= 8 for s, e in paragraphs.spans(items * 30))


def test_crowded_keys_are_those_of_several_texts(spark):
    """One bucket of very many texts over several batches, pairs within a batch and across batches, and texts alone."""
    many = [f"the same eight words of a template stand in text number {i}" for i in range(2500)]
    alone = [" ".join(f"x{i}y{k}" for k in range(9)) for i in range(500)]
    texts = [t.encode() for t in (*many, *alone, *(t + " more" for t in alone[::7]))]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, words binary").repartition(3)
    common.ready(spark)
    keys = paragraphs.band_keys([t.split() for t in texts], 5, 2).view("int64").tolist()
    often = collections.Counter(k for own in keys for k in own)
    want = sorted((k, i) for i, own in enumerate(keys) for k in own if often[k] > 1)
    assert sorted((r.key, r.id) for r in paragraphs._crowded(frame, 5, 2).collect()) == want and len(want) > 2500


def test_paragraphs_of_nothing(spark):
    assert paragraphs.report(corpus.none(spark)).count() == 0


@pytest.mark.parametrize("operator", ["simhash", "paragraphs", "decontamination"])
def test_whole_small_table(spark, small, operator):
    frame = spark.read.parquet(f"{small}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in frame.orderBy("doc_id").collect()]
    if operator == "simhash":
        check_simhash(simhash.near_duplicates(frame).collect(), docs, 512)
    elif operator == "paragraphs":
        gone = paragraph_removals(docs)
        rows = paragraphs.report(frame).collect()
        assert {r.doc_id: r.n_removed for r in rows} == {d: len(gone.get((d, t), [])) for d, t in docs}
    else:
        items = spark.read.parquet(f"{small}/benchmark.parquet")
        rows = decontamination.contamination(frame, items).collect()
        want = contamination(docs, [(r.item_id, r.text) for r in items.collect()])
        assert sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in rows) == sorted(want)
