"""Phrase collocations by the stripes pattern.

A *stripe* is a prefix of words and a counter of the words that follow it. Tasks build stripes of what they read and send them
as they are, a row for each prefix; stripes of one prefix are merged elementwise. The one structure then holds all that
scoring needs: an entry is the frequency of prefix and word together, the total of the empty prefix's stripe is the number of
words, and the largest entry of a stripe (and, by the phrases' ends, of those that put a word before) tells whether a longer
phrase is as frequent, so that the shorter one is only a part of it.

Stripes are built for prefixes of 0, 1, 2, ... words in turn. A phrase can be frequent only if both phrases it is made of, all
words but the last and all but the first, are, so each turn counts only where the turn before has found frequent phrases. The
tasks know these by a bitmap of fixed size (``SLOTS`` bits, broadcast): two phrases may share a slot, so it may let rare ones
pass, but never stops a frequent one, and counts are of the words themselves. Results don't depend on it.

A stripe as long as that of the empty prefix or of a very frequent word is dealt out in pieces by the next word, in
proportion to the share of all words that its prefix has. Prefixes with a share over ``1 / PIECES`` are at most ``PIECES``;
only these reach the driver.

Null texts are empty, a null language is ``und``, an empty table has no phrases. Repeated rows count each. Very long texts
are read in cuts between pieces. Columns other than ``text`` and ``lang`` are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm import common

#: Signs that end a piece: no phrase goes across them. Blanks and tabs divide words.
ENDS = b".,;:!?\n\x0b\x0c\r"
#: Bits of the bitmap of frequent phrases, as a power of two: 8 MB.
SLOTS = 26
#: Into how many pieces the stripe of the empty prefix is dealt.
PIECES = 4096
#: Words that a task gathers before it sends their stripes; bytes of a text that are split at once; stripes in one batch.
GATHERED, CUT_BYTES, SENT = 3_000_000, 1 << 20, 20_000

_LOWER = bytes.maketrans(bytes(range(65, 91)) + ENDS + b"\t", bytes(range(97, 123)) + b"." * len(ENDS) + b" ")
_MIX = 0x9E3779B97F4A7C15
_STRIPE = "lang string, prefix string, piece int, next array<string>, n array<long>"
_FREQUENT = "lang string, prefix string, next string, n long, h long"


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Lower-case words of a text with ``b"."`` between pieces, a bounded part at a time."""
    text = text.translate(_LOWER)
    at = 0
    while at < len(text):
        end = text.find(b".", at + CUT_BYTES)
        end = len(text) if end < 0 else end + 1
        yield text[at:end].replace(b".", b" . ").split()
        at = end


def _word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


def _mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word, from their hashes."""
    return (h ^ (h >> np.uint64(31))) * np.uint64(_MIX) + word


def phrase_hash(lang: bytes, words: Iterable[bytes], of: dict) -> int:
    """What :func:`_mixed` gives for a whole phrase; ``of`` maps words to their hashes."""
    h = _word_hash(lang)
    for word in words:
        h = ((h ^ (h >> 31)) * _MIX + of[word]) & 0xFFFFFFFFFFFFFFFF
    return h


class Gathered:
    """The words of one language, as numbers; 0 is an end of a piece."""

    def __init__(self):
        self.number = defaultdict(count().__next__)
        assert self.number[b"."] == 0
        self.parts: list[np.ndarray] = []

    def add(self, words: list[bytes]) -> int:
        self.parts.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        return len(words)

    def stripes(self, lang: bytes, k: int, bits: np.ndarray | None, hot: np.ndarray, pieces: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Stripes of prefixes of ``k - 1`` words. ``bits``: slots of frequent phrases of ``k - 1`` words; ``hot`` (sorted hashes
        of prefixes) and ``pieces``: into how many pieces their stripes go."""
        x = np.concatenate([*self.parts, np.zeros(1, np.int32)]).astype(np.int64)
        vocabulary = list(self.number)
        total, length = len(vocabulary), len(x)
        if length < k:
            return
        hashes = np.fromiter(map(_word_hash, vocabulary), np.uint64, total)
        start = np.full(length - k + 1, _word_hash(lang), np.uint64)
        if k == 1:
            at, prefix_of = np.flatnonzero(x), None
            prefix = start
        else:
            inside = x != 0
            whole = reduce(np.logical_and, (inside[j : length - k + 2 + j] for j in range(k - 1)))
            h = np.full(length - k + 2, _word_hash(lang), np.uint64)
            for j in range(k - 1):
                h = _mixed(h, hashes[x[j : length - k + 2 + j]])
            slot = (h >> np.uint64(64 - SLOTS)).astype(np.int64)
            known = whole & ((bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1) == 1)
            at, prefix = np.flatnonzero(known[:-1] & known[1:]), h
            if not len(at):
                return
            prefix_of = x[at]
            for j in range(1, k - 1):
                prefix_of = np.unique(prefix_of * total + x[at + j], return_inverse=True)[1]
        code = x[at + k - 1] if prefix_of is None else prefix_of * total + x[at + k - 1]
        entries, first, n = np.unique(code, return_index=True, return_counts=True)
        if not len(entries):
            return
        at, group, word = at[first], entries // total, entries % total
        where = np.searchsorted(hot, prefix[at])
        split = np.full(len(at), PIECES if k == 1 else 1)
        if len(hot):
            where = np.minimum(where, len(hot) - 1)
            split = np.where(hot[where] == prefix[at], pieces[where], split)
        piece = (hashes[word] >> np.uint64(17)).astype(np.int64) % split
        if piece.any():
            order = np.lexsort((piece, group))
            at, group, word, n, piece = at[order], group[order], word[order], n[order], piece[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (piece[1:] != piece[:-1])
        starts = np.append(np.flatnonzero(fresh), len(at))
        names = pa.array(vocabulary, pa.binary()).cast(pa.string())
        for low in range(0, len(starts) - 1, SENT):
            rows = starts[low : low + SENT + 1]
            a, b = rows[0], rows[-1]
            offsets, heads = pa.array(rows - a, pa.int32()), at[rows[:-1]]
            text = [names.take(pa.array(x[heads + j])) for j in range(k - 1)]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang], pa.binary()).cast(pa.string()).take(pa.array(np.zeros(len(heads), np.int64))),
                pc.binary_join_element_wise(*text, " ") if text else pa.array([""] * len(heads), pa.string()),
                pa.array(piece[rows[:-1]], pa.int32()),
                pa.ListArray.from_arrays(offsets, names.take(pa.array(word[a:b]))),
                pa.ListArray.from_arrays(offsets, pa.array(n[a:b], pa.int64())),
            ], names=["lang", "prefix", "piece", "next", "n"])


def spoken(docs: DataFrame) -> DataFrame:
    """``lang`` (null: ``und``) and ``text`` of the rows with a text."""
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")


def stripes(texts: DataFrame, k: int, bits, hot: list[tuple[int, int]]) -> DataFrame:
    """Merged entries ``lang, prefix, next, n`` of the stripes of prefixes of ``k - 1`` words. ``bits``: broadcast bitmap or None."""
    keys = np.array([h for h, _ in hot], np.uint64)
    shares = np.array([m for _, m in hot], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if bits is None else np.frombuffer(bits.value, np.uint8)
        held: dict[bytes, Gathered] = defaultdict(Gathered)
        words = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, gathered in held.items():
                yield from gathered.stripes(lang, k, known, keys, shares)
            held.clear()

        for batch in batches:
            for lang, text in zip(common.texts_bytes(batch.column(0)), common.texts_bytes(batch.column(1)), strict=True):
                into = held[lang]
                for part in tokens(text):
                    words += into.add(part)
                words += into.add([b"."])
                if words >= GATHERED:
                    yield from sent()
                    words = 0
        yield from sent()

    # dealt by prefix and piece, so that what is unpacked is merged where it arrives
    dealt = texts.mapInArrow(run, _STRIPE).repartition("lang", "prefix", "piece")
    rows = dealt.select("lang", "prefix", "piece", F.inline(F.arrays_zip("next", "n")))
    return rows.groupBy("lang", "prefix", "piece", "next").agg(F.sum("n").alias("n")).drop("piece")


def hashed(entries: DataFrame) -> DataFrame:
    """``entries`` with the hash ``h`` of prefix and word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = common.Memo(_word_hash, longest=256)
        for batch in batches:
            lang, prefix, word = (common.texts_bytes(batch.column(c)) for c in ("lang", "prefix", "next"))
            h = [phrase_hash(a, [*p.split(b" ")] * bool(p) + [w], of) for a, p, w in zip(lang, prefix, word, strict=True)]
            columns = [batch.column(c) for c in ("lang", "prefix", "next", "n")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array(h, np.uint64).view(np.int64))], names=["lang", "prefix", "next", "n", "h"])

    return entries.select("lang", "prefix", "next", "n").mapInArrow(run, _FREQUENT)


def bitmap(frequent: DataFrame) -> bytes:
    """Bits of the slots of all frequent phrases: at most 2 ** ``SLOTS`` bits reach the driver."""
    slot = F.shiftrightunsigned("h", 64 - SLOTS) + 1  # Spark's bitmaps number bits from 1
    parts = frequent.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = bytearray((1 << SLOTS) >> 3)
    for row in parts.toLocalIterator():
        at = (row.part - 1) * 4096
        out[at : at + 4096] = row.bits
    return bytes(out)


def frequencies(docs: DataFrame, least: int, longest: int) -> tuple[list[DataFrame], DataFrame]:
    """Entries of the stripes that count ``least`` or more, by the length of the phrase (stored tables, from length 1), and
    ``lang``, ``n``: all words."""
    spark = common.ready(docs.sparkSession)
    texts = spoken(docs)
    every = common.stored(stripes(texts, 1, None, []), "words")
    totals = common.stored(every.groupBy("lang").agg(F.sum("n").alias("n")), "word-totals")
    words = totals.agg(F.sum("n")).first()[0] or 0
    levels: list[DataFrame] = []
    for k in range(1, longest + 1):
        if k == 1:
            counted = every
        else:
            share = F.col("n") * PIECES
            hot = sorted((r.h & 0xFFFFFFFFFFFFFFFF, -(-r.n * PIECES // words)) for r in levels[-1].filter(share > words).select("h", "n").collect())
            bits = spark.sparkContext.broadcast(bitmap(levels[-1]))
            counted = stripes(texts, k, bits, hot)
        levels.append(common.stored(hashed(counted.filter(F.col("n") >= least)), f"phrases-{k}"))
        if k == 1:
            common.discard(every)
        else:
            bits.unpersist()
        common.release(spark)
    return levels, totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of 2 to ``longest`` words of each language, by score: ``lang``, ``rank``, ``phrase``, ``a``, ``l``,
    ``r``, ``n``, ``score``.

    ``a`` occurrences of the phrase, ``l`` and ``r`` of the two parts of the cut with the lowest score
    ``floor(1000 * a * n / (l * r))`` (the first of equal ones), ``n`` words of the language. Phrases within a longer one that
    is as frequent are left out. Equal scores: by ``a`` descending, then by the phrase's bytes.
    """
    levels, totals = frequencies(docs, least, longest)
    phrase = F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))
    counted = common.stored(reduce(DataFrame.unionByName, (t.select("lang", phrase.alias("phrase"), "n", "prefix", F.lit(k).alias("words")) for k, t in enumerate(levels, 1))), "phrases")
    longer = counted.filter("words > 2")
    ends = longer.select("lang", F.expr("substr(phrase, instr(phrase, ' ') + 1)").alias("phrase"), "n")
    maxima = longer.select("lang", F.col("prefix").alias("phrase"), "n").unionByName(ends).groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    own = counted.filter("words > 1").select("lang", "phrase", F.col("n").alias("a"), "words").join(maxima, ["lang", "phrase"], "left").filter("most IS NULL OR most < a")
    frequency = counted.select("lang", "phrase", "n")
    w = F.split("phrase", " ")
    cuts = own.select("lang", "phrase", "a", w.alias("w"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    cuts = cuts.join(frequency.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(frequency.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    scored = cuts.join(totals, "lang").withColumn("score", _score())
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    best = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _score() -> Column:
    """In whole numbers of up to 38 digits."""
    return F.expr("(1000 * cast(a AS decimal(17, 0)) * cast(n AS decimal(17, 0))) div (cast(l AS decimal(18, 0)) * cast(r AS decimal(18, 0)))")
