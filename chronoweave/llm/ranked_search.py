"""Ranked lexical search: MaxScore with bounds for pairs of terms.

:func:`index` writes an inverted index of *shards*, each made by one task of the documents it reads, with no shuffle: a row for each
term of a shard with its documents and frequencies, and one row with the shard's documents and lengths. Beside the lists
stand the document frequencies of all terms and, for the ``PAIR_TERMS`` most frequent terms, the intersection list of each
pair of them in each shard: how many documents hold both, the highest score that the two have together in one of them, and the
``k``-th highest. A document that holds both terms of a pair can't score more than the former; a document with one of them not
more than that term's maximum, so two terms together give at most the largest of three numbers, which is less than the sum of two
maxima as the two maxima are rarely met in one document. And ``k`` documents reach the latter, so it is a first threshold for every
item with both terms, known before any list is read.

:func:`search` joins the terms of a block of items to the lists and works through a shard at a time. An item's terms go by
falling maximum. When what the rest can still give, by disjoint pairs where these save most, is below the threshold, new
documents can't enter, and the rest of the lists is only looked up for documents that still can; those fall out as the rest
shrinks. Scores are exact, and documents fall out only when strictly below the threshold, so nothing is lost, ties included.
A shard hands on ``k`` rows of an item at most, and Spark cuts each task's rows to ``k`` before the last shuffle.

Scores: ``w * ((10**9 * tf) div (1000 * tf + 20 * m))`` summed over the terms of an item, with ``w = floor(1000 * ln((2N + 2) / (2df +
1)))`` and ``m = 50 + (50 * n * N) div L``. All are whole numbers. Each row of ``documents`` is a document, also where an id repeats;
equal scores go by id, null ids last. Documents without a term (null, empty) count nowhere. Items that agree in id and text are
one; items without a term, or none of whose terms occur, have no rows. Only ``doc_id``, ``item_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm import common

#: A shard holds texts of about so many bytes, and so many documents at most (numbers of two bytes).
SHARD_BYTES, SHARD_DOCS = 8 << 20, 1 << 16
#: Terms whose pairs have intersection lists: the most frequent ones. More cost time and space and tighten more bounds.
PAIR_TERMS = 64
#: Items that are worked through at once in a shard.
BLOCK = 512

#: Terms are runs of digits, letters and non-ASCII signs; only A-Z are lower-cased.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_POSTINGS = "shard long, term string, n long, total long, docs binary, counts binary, ids array<long>"
_PAIRS = "shard long, a string, b string, n long, most long, kth long"
_FOUND = "item long, doc_id long, score long"


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_TERMS).split() if text else []


def _binaries(parts: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Slices of ``parts`` at ``starts`` (with the end) as a binary column."""
    offsets = (starts * parts.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(parts).tobytes())])


class Shard:
    """Documents gathered by one task."""

    def __init__(self, limit: int):
        self.limit = limit
        self.of: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.numbers: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        held = Counter(terms(text))
        if held:
            of = self.of
            self.numbers.append(np.fromiter((of.setdefault(t, len(of)) for t in held), np.int64, len(held)))
            self.counts.append(np.fromiter(held.values(), np.uint32, len(held)))
            self.ids.append(doc_id)
            self.lengths.append(held.total())
            self.size += len(text)

    def full(self) -> bool:
        return self.size >= self.limit or len(self.ids) >= SHARD_DOCS

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64()))])
        lengths = np.array(self.lengths, np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array([shard]), pa.array([None], pa.string()), pa.array([len(lengths)]), pa.array([int(lengths.sum())]), pa.array([b""]),
            pa.array([lengths.tobytes()]), pa.array([self.ids], pa.list_(pa.int64()))], schema=schema)
        number = np.concatenate(self.numbers)
        docs = np.repeat(np.arange(len(lengths), dtype=np.uint16), [len(x) for x in self.numbers])
        # lists of a shard in the order of terms, so that readers of few terms skip most of a file
        names = sorted(self.of)
        rank = np.empty(len(names), np.int64)
        rank[np.fromiter((self.of[t] for t in names), np.int64, len(names))] = np.arange(len(names))
        order = np.argsort(rank[number], kind="stable")
        docs, counts = docs[order], np.concatenate(self.counts)[order]
        starts = np.append(0, np.cumsum(np.bincount(rank[number], minlength=len(names))))
        for low in range(0, len(names), 20_000):
            high = min(len(names), low + 20_000)
            cut = starts[low : high + 1]
            a, b, rows = cut[0], cut[-1], high - low
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(rows, shard)), pa.array(names[low:high], pa.binary()).cast(pa.string()), pa.array(np.diff(cut)), pa.nulls(rows, pa.int64()),
                _binaries(docs[a:b], cut - a), _binaries(counts[a:b], cut - a), pa.nulls(rows, pa.list_(pa.int64()))], schema=schema)


@dataclass
class Index:
    """``postings``: lists by shard and term (a null term: the shard's documents); ``frequencies``: ``term``, ``df``, ``w``;
    ``pairs``: intersection lists of frequent terms; ``docs``, ``words``: documents with a term, and all their terms."""

    postings: DataFrame
    frequencies: DataFrame
    pairs: DataFrame
    docs: int
    words: int
    k: int


def index(docs: DataFrame, k: int = 50, pair_terms: int = PAIR_TERMS, shard_bytes: int = SHARD_BYTES) -> Index:
    """An index of ``docs`` in the shared folder; ``k``: the list length for which pairs give a threshold."""
    spark = common.ready(docs.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, shard = TaskContext.get().partitionId(), 0, Shard(shard_bytes)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), common.texts_bytes(batch.column(1)), strict=True):
                shard.add(doc_id, text)
                if shard.full():
                    yield from shard.rows(task << 32 | made)
                    made, shard = made + 1, Shard(shard_bytes)
        if shard.ids:
            yield from shard.rows(task << 32 | made)

    postings = common.stored(common.texts_of(docs).mapInArrow(gather, _POSTINGS), "postings")
    row = postings.filter("term IS NULL").agg(F.sum("n"), F.sum("total")).first()
    n, words = row[0] or 0, row[1] or 0
    counted = postings.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(float(2 * n + 2))) / (2 * F.col("df") + 1))).cast("long")
    frequencies = common.stored(counted.withColumn("w", weight), "term-frequencies")
    frequent = [(r.term, r.w) for r in frequencies.orderBy(F.desc("df"), "term").limit(pair_terms).collect()]
    out = Index(postings, frequencies, None, n, words, k)
    out.pairs = common.stored(intersections(out, frequent), "term-pairs")
    return out


def smoothed(lengths: np.ndarray, n: int, words: int) -> np.ndarray:
    """``m`` of documents of ``lengths`` terms: whole numbers, also where 50 * n * N passes 64 bits."""
    if not len(lengths) or int(lengths.max()) * 50 * n < 1 << 63:
        return 50 + (50 * n * lengths) // words
    return np.array([50 + (50 * n * int(x)) // words for x in lengths], np.int64)


def impacts(w: int, counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = counts.astype(np.int64)
    return w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def _shard_groups(batches: Iterator[pa.RecordBatch], key: list[str], n: int, words: int) -> Iterator[tuple]:
    """Of each group: its table without the row of documents, their ids, and their ``m``."""
    for table in common.whole_runs(batches, key):
        bounds = common.run_starts(table, key)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            rows = table.slice(a, b - a)
            at = next((i for i, t in enumerate(rows.column("term").to_pylist()) if t is None), None)
            if at is not None:
                lengths = np.frombuffer(rows.column("counts")[at].as_py(), np.int64)
                yield rows, at, rows.column("ids")[at].as_py(), smoothed(lengths, n, words)


def intersections(of: Index, frequent: list[tuple[str, int]]) -> DataFrame:
    """Intersection lists of all pairs of the ``frequent`` terms (with their weights; a bounded number), by shard."""
    weights, n, words, k = dict(frequent), of.docs, of.words, of.k
    kept = of.postings.filter(F.col("term").isNull() | F.col("term").isin(list(weights))).select("shard", "term", "docs", "counts", "ids")

    def joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at, ids, m in _shard_groups(batches, ["shard"], n, words):
            names = [(t, i) for i, t in enumerate(rows.column("term").to_pylist()) if i != at]
            dense = np.full((len(names), len(ids)), -1, np.int64)
            for row, (t, i) in enumerate(names):
                docs = np.frombuffer(rows.column("docs")[i].as_py(), np.uint16)
                dense[row, docs] = impacts(weights[t], np.frombuffer(rows.column("counts")[i].as_py(), np.uint32), m[docs])
            out = []
            for x in range(len(names)):
                docs = np.flatnonzero(dense[x] >= 0)
                mine = dense[x, docs]
                for y in range(x):
                    theirs = dense[y, docs]
                    both = (mine + theirs)[theirs >= 0]
                    if len(both):
                        a, b = sorted((names[x][0], names[y][0]))
                        out.append((a, b, len(both), int(both.max()), int(np.partition(both, -k)[-k]) if len(both) >= k else 0))
            if out:
                shard = rows.column("shard")[0].as_py()
                a, b, size, most, kth = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(out)), *map(pa.array, (a, b, size, most, kth))], names=["shard", "a", "b", "n", "most", "kth"])

    return kept.repartition("shard").sortWithinPartitions("shard").mapInArrow(joint, _PAIRS)


def item_terms(items: DataFrame) -> DataFrame:
    """``item`` (a number), ``item_id`` and ``term`` of every item, each term once; stored."""
    common.ready(items.sparkSession)
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    kind = dict(rows.dtypes)["item_id"]
    rows = common.stored(rows.withColumn("item", F.monotonically_increasing_id()), "items")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms(t))) for t in common.texts_bytes(batch.column(2))]
            of = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
            words = pa.array([t for x in found for t in x], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), words], names=["item", "item_id", "term"])

    return common.stored(rows.select("item", "item_id", "text").mapInArrow(split, f"item long, item_id {kind}, term string"), "item-terms")


class Bounds:
    """What the terms of an item from the ``j``-th on can still give one document."""

    def __init__(self, most: list[int], pairs: dict[tuple[int, int], int]):
        """``most``: maxima of the terms; ``pairs``: joint maxima of those pairs that are known (0 where they never meet)."""
        # among equal savings the pair that comes later, as it stays whole longer
        saving = sorted(((most[a] + most[b] - max(most[a], most[b], j), a, b) for (a, b), j in pairs.items()), reverse=True)
        partner: dict[int, int] = {}
        for less, a, b in saving:
            if less > 0 and a not in partner and b not in partner:
                partner[a], partner[b] = b, a
        self.rest = [0] * (len(most) + 1)
        for j in range(len(most) - 1, -1, -1):
            p = partner.get(j, -1)
            if p > j:  # the pair is whole from here on: its bound replaces the single one of its later term
                both = pairs[min(j, p), max(j, p)]
                self.rest[j] = self.rest[j + 1] - most[p] + max(most[j], most[p], both)
            else:
                self.rest[j] = self.rest[j + 1] + most[j]


def best_of(lists: list[tuple[np.ndarray, np.ndarray]], bounds: Bounds, n_docs: int, k: int, threshold: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents that may be among the ``k`` best, their exact scores, and how many postings were read or looked up.

    ``lists``: documents (ascending) and impacts of each term, by falling maximum; ``threshold``: reached by ``k`` documents.
    """
    scores, touched, read = np.zeros(n_docs, np.int64), np.zeros(n_docs, bool), 0
    j = 0
    while j < len(lists) and bounds.rest[j] >= threshold:
        docs, gain = lists[j]
        scores[docs] += gain
        touched[docs] = True
        read += len(docs)
        j += 1
        if n_docs > k and j < len(lists):
            threshold = max(threshold, int(np.partition(scores, -k)[-k]))
    left = np.flatnonzero(touched & (scores + bounds.rest[j] >= threshold))
    while j < len(lists) and len(left):
        docs, gain = lists[j]
        at = np.minimum(np.searchsorted(docs, left), len(docs) - 1)
        scores[left] += np.where(docs[at] == left, gain[at], 0)
        read += min(len(left), len(docs))
        j += 1
        if len(left) > k:
            threshold = max(threshold, int(np.partition(scores[left], -k)[-k]))
        left = left[scores[left] + bounds.rest[j] >= threshold]
    return left, scores[left], read


def search(of: Index, items: DataFrame, k: int | None = None) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` best documents of each item (of the index's ``k`` by default)."""
    k = k or of.k
    n, words = of.docs, of.words
    asked = item_terms(items)
    named = asked.select("item", "item_id").distinct()
    blocks = max(1, -(-named.count() // BLOCK))
    weighted = asked.join(of.frequencies.select("term", "w"), "term")
    # first thresholds: k documents of one shard have both terms of a pair and score kth by them alone
    known = of.pairs.filter("kth > 0").groupBy("a", "b").agg(F.max("kth").alias("kth"))
    mine = asked.select("item", "term")
    seeds = mine.withColumnRenamed("term", "a").join(known, "a").join(mine.withColumnRenamed("term", "b"), ["item", "b"]).groupBy("item").agg(F.max("kth").alias("seed"))
    if k > of.k:
        seeds = seeds.withColumn("seed", F.lit(0).cast("long"))
    weighted = weighted.join(seeds, "item", "left").withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    uses = weighted.groupBy("block", "term").agg(F.first("w").alias("w"), F.collect_list(F.struct("item", F.coalesce("seed", F.lit(0)).alias("seed"))).alias("items"))
    uses = common.stored(uses, "asked-terms")
    lists = of.postings.filter("term IS NOT NULL").join(uses, "term").select("shard", "block", "term", "w", F.col("items.item").alias("item"), F.col("items.seed").alias("seed"), "docs", "counts", "ids", F.lit(None).cast("string").alias("b"), F.lit(None).cast("long").alias("most"))
    heads = of.postings.filter("term IS NULL").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    none = F.lit(None)
    heads = heads.select("shard", "block", "term", none.cast("long").alias("w"), none.cast("array<long>").alias("item"), none.cast("array<long>").alias("seed"), "docs", "counts", "ids", none.cast("string").alias("b"), none.cast("long").alias("most"))
    used = uses.select("block", "term")
    joint = of.pairs.join(used.withColumnRenamed("term", "a"), "a").join(used.withColumnRenamed("term", "b"), ["block", "b"])
    joint = joint.select("shard", "block", F.col("a").alias("term"), none.cast("long").alias("w"), none.cast("array<long>").alias("item"), none.cast("array<long>").alias("seed"), none.cast("binary").alias("docs"), none.cast("binary").alias("counts"), none.cast("array<long>").alias("ids"), "b", "most")
    whole = lists.unionByName(heads).unionByName(joint)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at, ids, m in _shard_groups(batches, ["shard", "block"], n, words):
            yield from _shard_best(rows, at, ids, m, k)

    found = whole.repartition("shard", "block").sortWithinPartitions("shard", "block").mapInArrow(ranked, _FOUND)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).join(named, "item").select("item_id", "rank", "doc_id", "score")


def _shard_best(rows: pa.Table, head: int, ids: list, m: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    names, others, most = (rows.column(c).to_pylist() for c in ("term", "b", "most"))
    lists: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    pairs: dict[tuple[str, str], int] = {}
    paired: set[str] = set()
    items: dict[int, list[str]] = {}
    seeds: dict[int, int] = {}
    for i, name in enumerate(names):
        if i == head:
            continue
        if others[i] is not None:
            pairs[name, others[i]] = most[i]
            paired |= {name, others[i]}
            continue
        docs = np.frombuffer(rows.column("docs")[i].as_py(), np.uint16).astype(np.int64)
        lists[name] = docs, impacts(rows.column("w")[i].as_py(), np.frombuffer(rows.column("counts")[i].as_py(), np.uint32), m[docs])
        for item, seed in zip(rows.column("item")[i].as_py(), rows.column("seed")[i].as_py(), strict=True):
            items.setdefault(item, []).append(name)
            seeds[item] = seed
    top = {t: int(gain.max()) for t, (_, gain) in lists.items()}
    key = np.array([(1 << 63) - 1 if x is None else x for x in ids], np.int64)
    missing = np.array([x is None for x in ids])
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    for item in sorted(items):
        own = sorted(items[item], key=lambda t: (-top[t], t))
        common_terms = [(t, a) for a, t in enumerate(own) if t in paired]
        known = {(a, b): pairs.get((min(s, t), max(s, t)), 0) for x, (s, a) in enumerate(common_terms) for t, b in common_terms[x + 1 :]}
        docs, scores, _ = best_of([lists[t] for t in own], Bounds([top[t] for t in own], known), len(ids), k, seeds[item])
        docs, scores = docs[scores > 0], scores[scores > 0]
        if len(docs) > k:
            order = np.lexsort((missing[docs], key[docs], -scores))[:k]
            docs, scores = docs[order], scores[order]
        if len(docs):
            out.append((item, docs, scores))
    if out:
        docs = np.concatenate([d for _, d, _ in out])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat([i for i, _, _ in out], [len(d) for _, d, _ in out])), pa.array(key[docs], mask=missing[docs]), pa.array(np.concatenate([s for _, _, s in out])),
        ], names=["item", "doc_id", "score"])
