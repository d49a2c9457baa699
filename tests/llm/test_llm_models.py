"""Language model, language identification and quality rules."""

import collections
import itertools
import math
import zlib

import corpus
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import language_id, lattice_lm, quality_rules
from chronoweave.llm.queries import op1_lattice_lm, op3_language_id, op10_quality_rules

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def cuts(word, lattice, units):
    """The probability of a word by listing all its cuts."""
    word, total = b" " + word, lattice.word.get(word, 0.0)
    for k in range(len(word)):
        for inner in itertools.combinations(range(1, len(word)), k):
            ends = [0, *inner, len(word)]
            parts = [word[a:b] for a, b in itertools.pairwise(ends)]
            if all(p in units for p in parts):
                total += math.prod(lattice.p[units[p]] for p in parts)
    return total


def test_lattice_sums_over_all_cuts():
    names = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"ba", b" ab", b"aba", b"bab"]
    draw = np.random.default_rng(4)
    p = draw.random(len(names))
    p /= p.sum() * 1.5
    lattice = lattice_lm.Lattice(names, p, {b"abab": 0.01})
    units = {n: i for i, n in enumerate(names)}
    for word in (b"a", b"abab", b"babab", b"xaby", "é".encode()):
        assert math.isclose(10 ** lattice.log10(word), cuts(word, lattice, units), rel_tol=1e-9)
    plain, logs = np.zeros(len(names)), np.zeros(len(names))
    lattice.posterior(b"babab", 2.0, plain)
    spans = [(e + 1 - n, e + 1, i) for e, (i, n) in lattice.find(" babab")]
    lattice._long_posterior(6, spans, 2.0, logs)
    assert np.allclose(plain, logs) and math.isclose(sum(n * len(u) for n, u in zip(plain, names, strict=True)), 2.0 * 6)
    assert math.isfinite(lattice.log10(b"z" * 5000))


def base_scores(docs, held):
    counts = collections.Counter()
    for (_, text), out in zip(docs, held, strict=True):
        if not out:
            counts.update((text or "").encode().lower().split() + [None])
    total, scale = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    out = []
    for _, text in docs:
        words = (text or "").encode().lower().split() + [None]
        out.append((len(words), sum(counts[w] > 0 for w in words), total, sum(math.log10((counts[w] + 0.5) / scale) for w in words)))
    return out


@pytest.mark.parametrize("frequent", [lattice_lm.FREQUENT, 5])
def test_base_scores(spark, monkeypatch, frequent):
    """With few words in the tasks' own table, most counts come through the join: the same result."""
    frame = corpus.docs(spark)
    plain = lattice_lm.frequent_words
    monkeypatch.setattr(lattice_lm, "frequent_words", lambda counts: plain(counts, frequent))
    train = F.col("doc_id").isNull() | (F.col("doc_id") % 2 == 1)
    model = lattice_lm.train(frame.filter(train), PIECES)
    docs = [(d, t) for d, t, _ in corpus.ROWS]
    rows = lattice_lm.scores(frame, model).collect()
    want = base_scores(docs, [d is not None and d % 2 == 0 for d, _ in docs])
    got = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert got == sorted((d or -1, *w[:3], round(w[3], 6)) for (d, _), w in zip(docs, want, strict=True))
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    mass = model.unit.sum() + sum(model.words.values()) + model.end
    assert math.isclose(mass, 1.0)


def test_the_table_of_frequent_words_changes_no_score(spark, monkeypatch):
    frame, plain, got = corpus.docs(spark), lattice_lm.frequent_words, []
    for frequent in (lattice_lm.FREQUENT, 5, 0):
        monkeypatch.setattr(lattice_lm, "frequent_words", lambda counts, most=frequent: plain(counts, most))
        model = lattice_lm.train(frame.filter("doc_id % 2 = 1"), PIECES)
        got.append(sorted((r.doc_id or -1, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lattice_lm.scores(frame, model).collect()))
        assert math.isclose(model.unit.sum() + sum(model.words.values()) + model.end, 1.0)
    assert got[0] == got[1] == got[2]
    word = b"w1x1"  # a training word outside the table has its own share beside its pieces'
    n = next(r.n for r in model.counts.collect() if bytes(r.word) == word)
    pieces = lattice_lm.Lattice(model.units, model.unit, {})
    whole = 10 ** pieces.log10(word) + (n - lattice_lm.DISCOUNT) / model.mass
    one = lattice_lm.scores(spark.createDataFrame([(1, word.decode())], "doc_id long, text string"), model).first()
    assert math.isclose(one.score, math.log10(whole) + math.log10(model.end), rel_tol=1e-9)


def test_language_model_without_training_rows(spark):
    model = lattice_lm.train(corpus.none(spark), PIECES)
    rows = lattice_lm.scores(corpus.docs(spark), model).collect()
    assert len(rows) == len(corpus.ROWS) and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in rows)
    assert lattice_lm.scores(corpus.none(spark), model).count() == 0


def test_language_model_query(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    held = [zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs]
    want = {d: w for (d, _), w in zip(docs, base_scores(docs, held), strict=True)}
    for r in op1_lattice_lm(spark, small).collect():
        n, known, total, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and math.isclose(r.base_score, score, rel_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)


def test_held_out_languages(spark, small):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = [r for r in op3_language_id(spark, small).collect() if r.held_out]
    assert rows and sum(truth[r.doc_id] == r.lang_pred for r in rows) >= 0.93 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_rows(spark):
    model = language_id.train(corpus.docs(spark), F.lit(True))
    rows = language_id.identify(corpus.docs(spark), model).collect()
    assert len(rows) == len(corpus.ROWS)
    by = {r.doc_id: r for r in rows}
    assert [by[d].lang_pred for d in (4, 5, 6, 8)] == ["und"] * 4 and all(by[d].score == 0 for d in (4, 5, 6, 8))
    assert {r.lang_pred for r in rows} <= {"und", "en", "de", "fr"}
    assert language_id.identify(corpus.none(spark), model).count() == 0
    nothing = language_id.train(corpus.none(spark), F.lit(True))
    assert nothing is None and {r.lang_pred for r in language_id.identify(corpus.docs(spark), nothing).collect()} == {"und"}


def test_one_language_and_unlisted_ones(spark):
    rows = [(i, "zza zzb zzc zza" if i % 2 else "qqx qqy qqz qqx", "x1" if i % 2 else "x2") for i in range(40)]
    model = language_id.train(corpus.docs(spark, rows), F.lit(True))
    assert model.families.names == ["other"]
    assert {r.lang_pred == ("x1" if r.doc_id % 2 else "x2") for r in language_id.identify(corpus.docs(spark, rows), model).collect()} == {True}
    single = language_id.train(corpus.docs(spark, [(1, "only one", "xx")]), F.lit(True))
    assert language_id.identify(corpus.docs(spark, [(2, "any text", None)]), single).first().lang_pred == "xx"


def base(text):
    """The base columns, straight from their definition."""
    import re

    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, inside = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            inside |= set(range(i, i + 8))
    n = len(words)
    failed = n < 20 or 100 * len(inside) > 30 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), failed


def test_base_rules(spark):
    rows = quality_rules.assess(corpus.docs(spark)).collect()
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == sorted((d or -1, *base(t)) for d, t, _ in corpus.ROWS)
    assert not any(r.kept and r.base_failed for r in rows)
    assert quality_rules.assess(corpus.none(spark)).count() == 0
    kept = quality_rules.keep(corpus.docs(spark))
    assert kept.columns == corpus.docs(spark).columns and kept.count() == sum(r.kept for r in rows)


def distributions(docs):
    """References and verdicts from plain counts over all documents."""
    words, classes = {}, {}
    for _, text, lang in docs:
        if text is not None and lang is not None:
            words.setdefault(lang, collections.Counter()).update(text.encode().lower().split())
            classes[lang] = classes.get(lang, 0) + quality_rules._counts(text.encode())[0]
    words = {lang: c for lang, c in words.items() if c}
    common = {lang: {w: n / c.total() for w, n in sorted(c.items()) if n >= quality_rules.COMMON * c.total()} for lang, c in words.items()}
    return {"classes": {lang: classes[lang] / classes[lang].sum() for lang in words}, "words": common}


def test_references_are_exact(spark, small):
    frame = spark.read.parquet(f"{small}/documents.parquet")
    want = distributions([(r.doc_id, r.text, r.lang) for r in frame.collect()])
    got = quality_rules.references(frame)
    assert got["words"].keys() == want["words"].keys()
    for lang, shares in want["words"].items():
        assert got["words"][lang].keys() == shares.keys() and np.allclose([got["words"][lang][w] for w in shares], list(shares.values()))
        assert np.allclose(got["classes"][lang], want["classes"][lang])


def test_summaries_lose_no_common_word():
    draw = np.random.default_rng(0)
    held, exact = collections.Counter(), collections.Counter()
    for _ in range(40):
        part = collections.Counter(draw.zipf(1.3, 2000).tolist())
        exact.update(part)
        held.update(part)
        held = quality_rules._thinned(held, 50)
    least = exact.total() / 51
    assert all(w in held and held[w] >= n - least for w, n in exact.items() if n > least)


def test_verdicts(spark, small):
    frame = spark.read.parquet(f"{small}/documents.parquet")
    docs = frame.collect()
    judge = quality_rules.Judge(distributions([(r.doc_id, r.text, r.lang) for r in docs]))
    got = {r.doc_id: r for r in op10_quality_rules(spark, small).collect()}
    for r in docs:
        words = r.text.encode().lower().split()
        verdict = not base(r.text)[-1] and judge.within(words, quality_rules._counts(r.text.encode())[0])
        assert got[r.doc_id].kept == verdict
    shouting, symbols = "GO!! " * 3 + "NOW!! STOP!! HERE!! WHY!! NOT!! " * 30, " ".join(f"w{'#$%&'[i % 4] * 3}{i}" for i in range(80))
    junk = spark.createDataFrame([(1, shouting.replace("!!", "!!", 1), None), (2, symbols, "en")], "doc_id long, text string, lang string")
    assert not any(r.kept for r in quality_rules.assess(junk, quality_rules.references(frame)).collect())
    fine = [r for r in docs if len(r.text.split()) > 200 and "#" not in r.text and "|" not in r.text and r.text.upper() != r.text][:40]
    assert sum(got[r.doc_id].kept for r in fine) >= 0.9 * len(fine)


def test_distance():
    p, q = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert quality_rules.distance(p, q) == 1.0 and quality_rules.distance(p, p) == 0.0
