"""SimHash near-duplicates with the generalised pigeonhole principle.

Fingerprints of 64 bits within distance ``D`` agree, for any division of the bits into ``m`` partitions and any integer
thresholds ``t_i >= -1`` with ``sum(t_i) = D - m + 1``, within ``t_i`` bits on some partition ``i``. Here

1. correlated bits are grouped into the same partition (from the correlation of bits over all distinct fingerprints), so that
   what partitions tell apart is spread evenly;
2. a dynamic program allots the thresholds by estimated candidates: exact pair counts of each partition's values, carried to
   larger thresholds by how often each bit differs; the number of partitions with the least total cost wins;
3. each fingerprint probes its partition values within their thresholds, colliding ones meet in bounded groups, and pairs are
   verified by their distance. A group emits a spanning forest of its links, which connects what all its pairs connect.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import common

BITS, SHINGLE, SEED, DISTANCE = 64, 3, 42, 3
#: Members of a block; a group holds at most about twice as many.
BLOCK = 512
#: Cost of a probe against that of a candidate, for the allotment.
PROBE_COST = 4.0
_ONE = np.uint64(1)


def fingerprint(text: bytes | None) -> int:
    """SimHash of a text's shingles of three words, repeats included: a bit is set if over half of their hashes have it."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    n = len(words) - SHINGLE + 1
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False)) if n > 0 else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((2 * ones > len(hashes)) @ (_ONE << np.arange(BITS, dtype=np.uint64)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed long) of every row, from whole texts."""
    common.ready(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t) for t in common.texts_bytes(batch.column("text"))], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64), pa.int64())], ["doc_id", "fp"])

    return common.map_batches(common.texts_of(docs), work, "doc_id long, fp long")


def bit_counts(prints: DataFrame) -> np.ndarray:
    """How often bits are set together: 64 x 64 counts over all distinct fingerprints, summed in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            bits = (fp[:, None] >> np.arange(BITS, dtype=np.uint64) & _ONE).astype(np.float32)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS), pa.int32()), pa.array(total.ravel(), pa.float64())], ["at", "n"])

    out = np.zeros(BITS * BITS)
    for r in prints.select("fp").mapInArrow(run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(BITS, BITS)


def group_bits(correlation: np.ndarray, partitions: int) -> list[list[int]]:
    """Bits in ``partitions`` groups of even size: each group starts from the bit left that is least tied to the others and
    takes, one by one, the bit most correlated with those it has."""
    strength = np.abs(correlation)
    left, groups = set(range(BITS)), []
    for g in range(partitions):
        size = (len(left) + partitions - g - 1) // (partitions - g)
        rest = sorted(left)
        seed = max(rest, key=lambda b: (strength[b, rest].sum(), -b))
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            best = max(sorted(left), key=lambda b: (strength[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def estimates(exact: float, differ: np.ndarray, n: int, most: int) -> list[float]:
    """Candidates of a partition for thresholds 0..most: the number of differing bits of a random pair is a sum of
    independent bits that differ with probabilities ``differ``; scaled to the exact count of equal values."""
    spread = np.array([1.0])
    for p in differ:
        spread = np.convolve(spread, [1 - p, p])
    total = n * (n - 1) / 2
    scale = max(1.0, exact / max(1e-300, total * spread[0]))
    return [min(total, max(exact, total * scale * spread[: t + 1].sum())) if t else exact for t in range(most + 1)]


def allot(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, -1 or more each, that sum to ``total`` at least cost; ``costs[i][t]`` is for threshold ``t`` of partition
    ``i``, and a partition with -1 is not probed."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, len(options)):
                new = (cost + (options[t] if t >= 0 else 0.0), [*chosen, t])
                if used + t not in following or new < following[used + t]:
                    following[used + t] = new
        best = following
    return best[total]


def masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(range(width), r)]


def packed(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The chosen bits of each fingerprint, as one number."""
    out = np.zeros(len(fp), dtype=np.uint64)
    for i, b in enumerate(bits):
        out |= (fp >> np.uint64(b) & _ONE) << np.uint64(i)
    return out


def plan(prints: DataFrame, distance: int = DISTANCE) -> tuple[list[list[int]], list[int]]:
    """Partitions of the bits and their thresholds, from all distinct fingerprints."""
    n = prints.count()
    if n < 2:
        return [list(range(BITS))], [0 if n == 0 else distance]
    together = bit_counts(prints)
    share = np.diag(together) / n
    deviation = np.sqrt(np.clip(share * (1 - share), 1e-12, None))
    correlation = (together / n - np.outer(share, share)) / np.outer(deviation, deviation)
    differ = 2 * share * (1 - share)
    divisions = [group_bits(correlation, m) for m in range(2, distance + 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            flat = [bits for groups in divisions for bits in groups]
            for at, bits in enumerate(flat):
                values, counts = np.unique(packed(fp, bits), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), at), pa.int32()), pa.array(values.view(np.int64), pa.int64()), pa.array(counts, pa.int64())],
                    ["at", "value", "n"],
                )

    counts = prints.select("fp").mapInArrow(run, "at int, value long, n long").groupBy("at", "value").agg(F.sum("n").cast("double").alias("n"))
    equal = {r["at"]: r["pairs"] for r in counts.groupBy("at").agg(F.sum(F.expr("n * (n - 1) / 2")).alias("pairs")).collect()}
    choices, at = [], 0
    for groups in divisions:
        costs = []
        for bits in groups:
            pairs = estimates(equal[at], differ[bits], n, distance)
            costs.append([PROBE_COST * n * len(masks(len(bits), t)) + pairs[t] for t in range(distance + 1 if len(groups) == 1 else distance)])
            at += 1
        choices.append((*allot(costs, distance - len(groups) + 1), groups))
    _, thresholds, groups = min(choices, key=lambda c: c[0])
    return groups, thresholds


def links(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Pairs ``a``, ``b`` of distinct fingerprints within ``distance`` that connect all that are; ``prints``: distinct ``fp``."""
    groups, thresholds = plan(prints, distance)
    probed = [(i, bits, t) for i, (bits, t) in enumerate(zip(groups, thresholds, strict=True)) if t >= 0]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for i, bits, t in probed:
                values = packed(fp, bits)
                for mask in masks(len(bits), t):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_mix(values ^ np.uint64(mask), i), pa.int64()), batch.column("fp"), pa.array(np.full(len(fp), mask == 0))],
                        ["key", "id", "own"],
                    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "left", "right"]
        for table in common.whole_runs(batches, names):
            ends = common.run_starts(table, names)
            fp = table.column("id").to_numpy().view(np.uint64)
            own = table.column("own").to_numpy()
            a, b = _linked(fp, own, ends, distance)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64), pa.int64()), pa.array(b.view(np.int64), pa.int64())], ["a", "b"])

    members = prints.select("fp").mapInArrow(probe, "key long, id long, own boolean")
    dealt = common.block_pairs(members, "key", block).repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "id")
    return dealt.select("key", "left", "right", "id", "own").mapInArrow(verify, "a long, b long").distinct()


def _mix(values: np.ndarray, partition: int) -> np.ndarray:
    """A bucket's number: one to one for values of up to 58 bits, and spread for wider ones (a clash only adds candidates)."""
    return (values * np.uint64(64) + np.uint64(partition) + (values >> np.uint64(58)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _linked(fp: np.ndarray, own: np.ndarray, ends: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the runs between ``ends``: small runs all at once, shift by shift; large ones as forests."""
    starts, sizes = ends[:-1], np.diff(ends)
    left, right = [], []
    small = sizes <= 32
    last = np.repeat(np.where(small, ends[1:], starts), sizes)
    n = len(fp)
    for shift in range(1, int(sizes[small].max(initial=1))):
        i = np.flatnonzero(np.arange(n - shift) + shift < last[: n - shift])
        if not len(i):
            break
        j = i + shift
        hit = (np.bitwise_count(fp[i] ^ fp[j]) <= distance) & (own[i] | own[j]) & (fp[i] != fp[j])
        left.append(fp[i[hit]])
        right.append(fp[j[hit]])
    for s, e in zip(starts[~small], ends[1:][~small], strict=True):
        part, mine, forest = fp[s:e], own[s:e], common.Forest(e - s)
        for i in range(e - s - 1):
            near = (np.bitwise_count(part[i + 1 :] ^ part[i]) <= distance) & (mine[i + 1 :] | mine[i])
            for j in np.flatnonzero(near) + i + 1:
                if forest.join(i, int(j)) and part[i] != part[j]:
                    left.append(part[i : i + 1])
                    right.append(part[j : j + 1])
    empty = np.zeros(0, dtype=np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def classes(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """``fp`` and ``component_id``: the smallest ``doc_id`` of documents whose fingerprints are linked, through any chain, to
    ``fp``. ``prints``: stored ``doc_id``, ``fp``. A component whose documents all lack an id has a null one."""
    least = common.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "fingerprints")
    roots = common.components(links(least, distance, block))
    rooted = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 lowercase hex digits) and ``component_id`` of every row.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Rows that repeat a ``doc_id`` have a row
    each; a null ``doc_id`` stays, and is never a component's id while another is there. Other columns are not read. An empty
    table gives an empty table.
    """
    prints = common.stored(fingerprints(docs), "simhash")
    labels = classes(prints, distance, block)
    return prints.join(labels.select("fp", "component_id"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def distinct_documents(docs: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` with one document of each component: that of the smallest ``doc_id`` (then fingerprint, then hash
    of the text). All columns stay. Of rows that repeat an id and a text, one stays; rows without an id only stay where a
    component has no other."""
    spark = common.ready(docs.sparkSession)
    keyed = common.texts_of(docs).select("doc_id", "text", common.text_hash(F.col("text")).alias("h"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t) for t in common.texts_bytes(batch.column("text"))], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(values.view(np.int64), pa.int64())], ["doc_id", "h", "fp"])

    prints = common.stored(common.map_batches(keyed, work, "doc_id long, h long, fp long"), "simhash")
    labels = classes(prints.select("doc_id", "fp"), distance, block).select("fp", "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "h")).alias("first")
    kept = common.stored(prints.join(labels, "fp").groupBy("root").agg(first).select(F.col("first.doc_id").alias("_kept_id"), F.col("first.h").alias("_kept_h")), "kept")
    match = docs["doc_id"].cast("long").eqNullSafe(kept["_kept_id"]) & (common.text_hash(docs["text"].cast("string")) == kept["_kept_h"])
    out = docs.join(kept, match, "left_semi")
    repeats = prints.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    common.release(spark)
    return out.dropDuplicates(["doc_id", "text"]) if repeats else out
