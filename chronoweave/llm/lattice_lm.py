"""Language-model scores by the likelihood of a subword lattice.

A word is the bytes of ``" " + word``. Its units are the pieces of an existing vocabulary (and all single bytes), plus whole
words that training saw; every way to cut the word into units counts. A unit has a probability, all units and the end of
a text add up to one, and a forward recursion in log space sums over all cuts. A text's probability is the product over its
words, times that of the end.

The probabilities come from the training rows. The pieces' existing scores (ranks) give the first weights; ``ROUNDS`` steps of
expectation and maximisation over the table of all distinct training words, on its tasks, give the final ones. Each training
word leaves ``DISCOUNT`` of its occurrences to be spelled by pieces: so pieces learn from words as they look when they are new,
and words never seen keep a fair share.

Beside the score stands a smoothed word unigram as a base. Both take a word's count from a bounded table of frequent words in
the tasks, and for all other words from a join with the stored table of counts, with the same result; after that join equal
words stand together, and each is spelled once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import common

#: The most frequent words, at most so many and of so many bytes, are known in every task and spare the join.
FREQUENT, FREQUENT_BYTES = 200_000, 64
#: Occurrences of a training word that pieces spell; pseudo-count of every piece; distinct words a task counts before it hands
#: them on.
DISCOUNT, PSEUDO, HELD_WORDS = 0.75, 0.1, 200_000
#: Steps of expectation and maximisation.
ROUNDS = 2
#: Up to so many bytes a word's posterior is worked out with plain probabilities: they can't underflow.
PLAIN_BYTES = 40


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[list[bytes], list[float]]:
    """Units of an existing piece vocabulary that can occur in lower-cased words, and their first weights: 1 / (2 + rank)."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weights = {bytes([b]): 1e-6 for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ")
        if " " in piece[1:] or any("A" <= c <= "Z" for c in piece):
            continue
        weights[piece.encode()] = 1 / (2 + max(0.0, -model.get_score(i)))
    return list(weights), list(weights.values())


class Lattice:
    """Cuts of words into units; ``unit``: probabilities of the vocabulary's units, ``word``: of whole words."""

    def __init__(self, units: list[bytes], unit: np.ndarray, word: dict[bytes, float]):
        self.p, self.word = unit.tolist(), word
        self.log = np.log(unit).tolist()
        self.find = automaton(tuple(units)).iter

    def posterior(self, word: bytes, n: float, expected: np.ndarray) -> None:
        """Add the expected uses of each unit of the vocabulary when ``word`` is spelled ``n`` times."""
        size = len(word) + 1
        spans = [(end + 1 - length, end + 1, i) for end, (i, length) in self.find(" " + word.decode("latin-1"))]
        if size > PLAIN_BYTES:
            return self._long_posterior(size, spans, n, expected)
        p = self.p
        ahead, behind = [0.0] * (size + 1), [0.0] * (size + 1)
        ahead[0] = behind[size] = 1.0
        for s, e, i in spans:  # ends ascend
            ahead[e] += ahead[s] * p[i]
        for s, e, i in reversed(spans):  # whatever starts at an end has a later end, so behind[e] is complete
            behind[s] += p[i] * behind[e]
        total = n / ahead[size]
        for s, e, i in spans:
            expected[i] += ahead[s] * p[i] * behind[e] * total

    def _long_posterior(self, size: int, spans: list, n: float, expected: np.ndarray) -> None:
        ahead, behind = [-math.inf] * (size + 1), [-math.inf] * (size + 1)
        ahead[0] = behind[size] = 0.0
        for s, e, i in spans:
            ahead[e] = log_add(ahead[e], ahead[s] + self.log[i])
        for s, e, i in reversed(spans):
            behind[s] = log_add(behind[s], behind[e] + self.log[i])
        for s, e, i in spans:
            expected[i] += n * math.exp(ahead[s] + self.log[i] + behind[e] - ahead[size])

    def log10(self, word: bytes, own: float = 0.0) -> float:
        """log10 of the word's probability, summed over all cuts; ``own``: that of the whole word, if ``word`` doesn't tell."""
        size, log = len(word) + 1, self.log
        ahead = [-math.inf] * (size + 1)
        ahead[0] = 0.0
        exp, log1p = math.exp, math.log1p
        for end, (i, length) in self.find(" " + word.decode("latin-1")):
            new, old = ahead[end + 1 - length] + log[i], ahead[end + 1]
            ahead[end + 1] = new + log1p(exp(old - new)) if new > old else old + log1p(exp(new - old))
        total = ahead[size]
        if own := self.word.get(word, own):
            total = log_add(total, math.log(own))
        return total / math.log(10)


def log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


@lru_cache(maxsize=2)
def automaton(units: tuple[bytes, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for i, unit in enumerate(units):
        out.add_word(unit.decode("latin-1"), (i, len(unit)))
    out.make_automaton()
    return out


def word_counts(texts: DataFrame) -> DataFrame:
    """``word`` (binary), ``n`` of all texts; counted in the tasks, then added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for data in common.texts_bytes(batch.column("text")):
                held.update((data or b"").lower().split())
            if len(held) > HELD_WORDS:
                yield rows()
                held = Counter()
        yield rows()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> dict[bytes, int]:
    """The most frequent short words: those above the lowest half power of two that leaves at most ``most`` of them."""
    short = counts.filter(F.octet_length("word") <= FREQUENT_BYTES)
    level = F.floor(F.log2("n") * 2).cast("int")
    sizes = {r["level"]: r["count"] for r in short.groupBy(level.alias("level")).count().collect()}
    total, least = 0, None
    for at in sorted(sizes, reverse=True):
        total += sizes[at]
        if total > most:
            break
        least = at
    if least is None:
        return {}
    return {bytes(r["word"]): r["n"] for r in short.filter(level >= least).collect()}


class Model:
    """What training gives: ``counts`` (a stored table), ``total`` and ``distinct`` tokens, ``texts`` (ends), ``frequent``
    counts, the probabilities of ``units``, of frequent ``words`` (under None of all other words together) and of the ``end``, and
    the ``mass`` by which counts are divided."""

    def __init__(self, **parts):
        self.__dict__ |= parts


def _expected(counts: DataFrame, units: list[bytes], p: np.ndarray) -> np.ndarray:
    """Expected uses of each unit, and ``PSEUDO``, when ``DISCOUNT`` of each word of ``counts`` is spelled under the
    probabilities ``p``."""

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, expected = Lattice(units, p, {}), np.zeros(len(units))
        for batch in batches:
            for word in batch.column("word").to_pylist():
                lattice.posterior(word, DISCOUNT, expected)
        used = np.flatnonzero(expected)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(expected[used], pa.float64())], ["unit", "n"])

    out = np.full(len(units), PSEUDO)
    for r in counts.select("word").mapInArrow(expect, "unit int, n double").groupBy("unit").agg(F.sum("n").alias("n")).collect():
        out[r["unit"]] += r["n"]
    return out


def train(texts: DataFrame, path: str, rounds: int = ROUNDS) -> Model:
    """Counts and unit probabilities from all rows of ``texts`` (``text``); null texts are empty ones. The driver holds the
    vocabulary's units and the frequent words, both of bounded number."""
    common.ready(texts.sparkSession)
    counts = common.stored(word_counts(texts), "word-counts")
    n_texts = texts.count()
    n_words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = frequent_words(counts)
    units, weights = vocabulary(path)
    unit = np.array(weights) / sum(weights)
    for _ in range(rounds):
        unit = _expected(counts, units, unit / unit.sum())
    word = {w: n - DISCOUNT for w, n in frequent.items()}
    end = n_texts + PSEUDO
    mass = unit.sum() + (n_words - DISCOUNT * distinct) + end
    words = {w: n / mass for w, n in word.items()} | {None: (n_words - DISCOUNT * distinct - sum(word.values())) / mass}
    return Model(
        counts=counts, total=n_words + n_texts, distinct=distinct + (n_texts > 0), texts=n_texts, frequent=frequent,
        units=units, unit=unit / mass, words=words, end=end / mass, mass=mass,
    )


def scores(docs: DataFrame, model: Model, passed: list[Column] | None = None) -> DataFrame:
    """``doc_id``, the columns ``passed``, ``n_tokens`` (words and the end), ``n_known``, ``train_tokens``, ``base_score`` and
    ``score`` (log10 probabilities of the whole text) of every row.

    A null, empty or blank text is an end alone. Repeated rows are scored each; a null ``doc_id`` stays. Without training rows
    every word is unknown and the score comes from pseudo-counts. Other columns are not read.
    """
    spark = common.ready(docs.sparkSession)
    scale = model.total + 0.5 * (model.distinct + 1)
    lattice = Lattice(model.units, model.unit, model.words)
    known = spark.sparkContext.broadcast({w: (math.log10((n + 0.5) / scale), lattice.log10(w)) for w, n in model.frequent.items()})
    units, unit, end, mass = model.units, model.unit, math.log10(model.end), model.mass
    end_base, end_known, unknown = math.log10((model.texts + 0.5) / scale), int(model.texts > 0), math.log10(0.5 / scale)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(passed or []), F.col("text").cast("string").alias("text"))
    kept = rows.columns[:-1]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = known.value.get
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for data in common.texts_bytes(batch.column("text")):
                words = (data or b"").lower().split()
                base, score, n_known, rare, times = end_base, end, end_known, [], []
                for word, n in Counter(words).items():
                    if (entry := find(word)) is None:
                        rare.append(word)
                        times.append(n)
                    else:
                        base += n * entry[0]
                        score += n * entry[1]
                        n_known += n
                for column, value in zip(out, (len(words) + 1, n_known, base, score, rare, times), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, out, kinds)], [*kept, "n_tokens", "_known", "_base", "_score", "_rare", "_times"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, last, value = Lattice(units, unit, {}), None, 0.0
        for batch in batches:
            values = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if word != last:  # equal words stand together after the join
                    last, value = word, lattice.log10(word, 0.0 if n is None else (n - DISCOUNT) / mass)
                values.append(value)
            times = batch.column("m").to_numpy()
            counts = batch.column("n").to_numpy(zero_copy_only=False).astype(np.float64)
            seen = ~np.isnan(counts)
            base = np.where(seen, np.log10((np.where(seen, counts, 0) + 0.5) / scale), unknown)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(np.where(seen, times, 0).astype(np.int64)), pa.array(times * base), pa.array(times * np.array(values))],
                ["_row", "k", "b", "s"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema += ", n_tokens long, _known long, _base double, _score double, _rare array<binary>, _times array<int>"
    scored = common.stored(rows.mapInArrow(look_up, schema).withColumn("_row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("_row", F.explode(F.arrays_zip("_rare", "_times")).alias("r")).select("_row", F.col("r._rare").alias("word"), F.col("r._times").alias("m"))
    spelled = rare.join(model.counts, "word", "left").select("_row", "word", "m", "n").mapInArrow(spell, "_row long, k long, b double, s double")
    found = spelled.groupBy("_row").agg(F.sum("k").alias("_k"), F.sum("b").alias("_b"), F.sum("s").alias("_s"))
    plus = lambda a, b, zero: F.col(a) + F.coalesce(F.col(b), F.lit(zero))
    return scored.select("_row", *(f"`{c}`" for c in kept), "n_tokens", "_known", "_base", "_score").join(found, "_row", "left").select(
        *(f"`{c}`" for c in kept), "n_tokens", plus("_known", "_k", 0).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        plus("_base", "_b", 0.0).alias("base_score"), plus("_score", "_s", 0.0).alias("score"),
    )
