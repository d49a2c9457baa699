"""Exact removal of repeated byte strings, by prefix doubling over the positions that can matter.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier is removed. A position's rank among all is known
by a name: the names of two strings side by side, ``size`` bytes apart, are mixed to the name of both, for sizes 1, 2, 4, 8,
16 within the tasks. What doubling by Spark's sorts then has to tell apart is thinned so that unique positions drop out early:

1. **32 bytes.** Each string of 100 has a minimiser: the least name of its 32-byte substrings (the leftmost of equals). Equal
   strings have it at the same offset. Consecutive positions with the same minimiser form a *stretch*, whose bytes decide all
   its strings; a stretch is one row. Spark sorts the rows by the minimiser's name, the stretch's and the place. A stretch
   that equals an earlier one is repeated throughout; one whose minimiser no other stretch has is unique and drops out.
2. **93 bytes.** What is left is cut into blocks of up to eight positions, at the same offsets from the minimiser. All strings
   of a block have 93 bytes in common; Spark sorts by their name, that of the whole block and the place, and blocks are
   settled as stretches were.
3. **100 bytes.** The blocks left, about one at each end of a repeated passage, go on position by position: the names 32, 64 and
   68 bytes further on are joined to a position's own, and Spark sorts by the joined name and the place. All places of a name
   but the first are repeated. The threshold is reached, so no round follows.

Names that decide have 104 bits or more. Rows that many places share are pre-aggregated: a task batch sends one place of each
name and settles the others itself. Rows of one minimiser in very many stretches are spread by the name of the stretch: a task
that sees two stretches of a minimiser sends them on as left over, and tells the minimiser's own task so in one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import common

LENGTH, GRAM = 100, 32
#: Offsets at which names of 32 bytes are joined to one of 100: no byte is left out.
OFFSETS = (0, 32, 64, 68)
_SPAN = LENGTH - GRAM + 1
_INDEX = np.uint64((1 << 31) - 1)
#: Positions of a block; bytes of texts that are named at once.
BLOCK, GROUP = 8, 1 << 20
#: Rows of a stretch table: by anchor, by stretch (its anchor has others), or only the news that an anchor has others.
BY_ANCHOR, BY_STRETCH, NEWS = 0, 1, 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


def gram_hashes(data: np.ndarray, factor: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """A 64-bit name of the 32 bytes from each position, by doubling; positions near the end hold no whole gram."""
    h, size = _mix(data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
    while size < GRAM:
        after = np.zeros_like(h)
        after[: len(h) - size] = h[size:]
        h = h * np.uint64(factor) + after
        factor = (factor * factor + 0x632BE59BD9B4E019 | 1) % (1 << 64)
        size *= 2
    return _mix(h)


def stretches(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of all texts: number of the text, first position and number of further positions, anchor's offset and hash, of every
    stretch, in order. Texts are worked on in groups of about ``GROUP`` bytes: a position takes some dozen bytes meanwhile."""
    parts, begin, size = [], 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= GROUP or i == len(texts) - 1:
            of, *rest = _stretches(texts[begin : i + 1])
            parts.append((of + begin, *rest))
            begin, size = i + 1, 0
    return tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else _stretches([])


def _stretches(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = len(data)
    empty = np.zeros(0, dtype=np.int64)
    if n < LENGTH:
        return empty, empty, empty, empty, empty.astype(np.uint64)
    hashes = gram_hashes(data)
    least = hashes & ~_INDEX | np.arange(n, dtype=np.uint64)
    size = 1
    while size * 2 <= _SPAN:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if size < _SPAN:
        least = np.minimum(least[: len(least) - (_SPAN - size)], least[_SPAN - size :])
    last = np.repeat(ends - LENGTH, sizes)  # the last position of the text with a whole string
    p = np.flatnonzero(np.arange(len(least)) <= last[: len(least)])
    anchor = (least[p] & _INDEX).astype(np.int64)
    if not len(p):
        return empty, empty, empty, empty, empty.astype(np.uint64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)]))
    more = np.diff(np.append(new, len(p))) - 1
    first, anchor = p[new], anchor[new]
    of = np.searchsorted(ends, first, side="right")
    return of, first - (ends - sizes)[of], more, anchor - first, hashes[anchor]


def stretch_rows(docs: DataFrame) -> DataFrame:
    """One row a stretch: ``k1`` (40 bits of the anchor's hash, 24 of the stretch's), ``k2`` (64 more of it), ``doc_id``, ``h``,
    ``at`` (position, offset of the anchor, further positions), ``kind``; ``repeated`` where an equal one stands earlier in
    the same batch."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        order = np.array(sorted(range(batch.num_rows), key=_order(batch)))
        docs_, h = batch.column("doc_id").take(pa.array(order)), batch.column("h").take(pa.array(order))
        data = common.texts_bytes(batch.column("text"))
        texts = [data[i] or b"" for i in order]
        of, first, more, offset, anchor = stretches(texts)
        digest = xxhash.xxh3_128_digest
        names = [digest(texts[t][s : s + m + LENGTH], o) for t, s, m, o in zip(of.tolist(), first.tolist(), more.tolist(), offset.tolist(), strict=True)]
        return _settled(anchor, names, of, first << 16 | offset << 8 | more, docs_, h)

    return common.map_batches(docs, work, "k1 long, k2 long, doc_id long, h long, at long, kind byte, repeated boolean")


def _settled(key: np.ndarray, names: list[bytes], of: np.ndarray, at: np.ndarray, docs: pa.Array, h: pa.Array) -> pa.RecordBatch:
    """Rows of one batch, in the order of places: equal ones after the first are repeated; where a key has several names, its
    rows are sent by name, and one row tells the key's own task."""
    words = np.frombuffer(b"".join(names), dtype="<u8").reshape(-1, 2)
    low = np.uint64((1 << 24) - 1)
    k1, k2 = key & ~low | words[:, 0] & low, words[:, 1]
    by = np.lexsort((np.arange(len(k1)), k2, k1))
    same = np.zeros(len(k1), dtype=bool)
    same[by[1:]] = (k1[by[1:]] == k1[by[:-1]]) & (k2[by[1:]] == k2[by[:-1]])
    own = by[~same[by]]  # one of each name, sorted by key
    many = np.zeros(len(k1), dtype=bool)
    twin = (k1[own[1:]] ^ k1[own[:-1]]) >> np.uint64(24) == 0
    many[own[1:][twin]] = many[own[:-1][twin]] = True
    heads = own[1:][twin & np.concatenate([[True], ~twin[:-1]])] if len(own) > 1 else own[:0]
    rows = np.concatenate([np.arange(len(k1)), heads]).astype(np.int64)
    kind = np.concatenate([np.where(many, BY_STRETCH, BY_ANCHOR), np.full(len(heads), NEWS)]).astype(np.int8)
    ids = pa.array(of[rows], pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(k1[rows].view(np.int64)), pa.array(k2[rows].view(np.int64)), docs.take(ids), h.take(ids), pa.array(at[rows]),
            pa.array(kind), pa.array(np.concatenate([same, np.zeros(len(heads), dtype=bool)])),
        ],
        ["k1", "k2", "doc_id", "h", "at", "kind", "repeated"],
    )


def block_rows(left: DataFrame) -> DataFrame:
    """Rows as of :func:`stretch_rows` for the blocks of the stretches ``left`` over (``doc_id``, ``h``, ``text``, ``ats``)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        order = np.array(sorted(range(batch.num_rows), key=_order(batch)))
        docs, h = batch.column("doc_id").take(pa.array(order)), batch.column("h").take(pa.array(order))
        texts, ats = common.texts_bytes(batch.column("text")), batch.column("ats").to_pylist()
        of, at, cores, names = [], [], [], []
        for i, row in enumerate(order.tolist()):
            text = texts[row]
            for packed in sorted(ats[row]):
                first, offset, more = packed >> 16, packed >> 8 & 255, packed & 255
                anchor, p, stop = first + offset, first, first + more
                while p <= stop:
                    block = (anchor - p) // BLOCK
                    last = min(stop, anchor - block * BLOCK)
                    core = text[anchor - block * BLOCK : anchor - block * BLOCK - BLOCK + 1 + LENGTH]
                    of.append(i)
                    at.append(p << 16 | last - p)
                    cores.append(xxhash.xxh3_64_intdigest(core, block))
                    names.append(xxhash.xxh3_128_digest(text[p : last + LENGTH], (anchor - p) << 8 | block))
                    p = last + 1
        return _settled(np.array(cores, dtype=np.uint64), names, np.array(of, dtype=np.int64), np.array(at, dtype=np.int64), docs, h)

    return common.map_batches(left, work, "k1 long, k2 long, doc_id long, h long, at long, kind byte, repeated boolean")


def _order(batch: pa.RecordBatch):
    ids, h = batch.column("doc_id").to_pylist(), batch.column("h").to_pylist()
    return lambda i: (ids[i] is None, ids[i] or 0, h[i])


def sorted_out(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``h``, ``at``, ``repeated`` of stretches that are repeated throughout, and of those left over (false)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.whole_runs(batches, ["anchor"]):
            anchor, k1, k2 = (table.column(c).to_numpy() for c in ("anchor", "k1", "k2"))
            kind, repeated = table.column("kind").to_numpy(), table.column("repeated").to_numpy().copy()
            place = kind != NEWS
            n = len(k1)
            fresh = np.ones(n, dtype=bool)
            fresh[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            several = np.add.reduceat(fresh.astype(np.int64), start) > 1
            several |= np.add.reduceat((~place).astype(np.int64), start) > 0
            several = np.repeat(several, np.diff(np.append(start, n))) | (kind == BY_STRETCH)
            # Of equal stretches the first place is new; news rows are none.
            group = np.cumsum(fresh) - 1
            lead = np.full(group[-1] + 1 if n else 0, -1)
            where = np.flatnonzero(place & ~repeated)[::-1]
            lead[group[where]] = where
            first = np.zeros(n, dtype=bool)
            first[lead[lead >= 0]] = True
            repeated |= place & ~first
            out = pa.array(np.flatnonzero(place & (repeated | several)))
            yield pa.RecordBatch.from_arrays(
                [table.column(c).combine_chunks().take(out) for c in ("doc_id", "h", "at")] + [pa.array(repeated).take(out)], ["doc_id", "h", "at", "repeated"]
            )

    route = F.when(F.col("kind") == BY_STRETCH, F.xxhash64("k1", "k2")).otherwise(F.xxhash64(F.shiftright("k1", 24)))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, route).sortWithinPartitions("k1", "k2", F.col("doc_id").asc_nulls_last(), "h", "at")
    columns = dealt.select(F.shiftright("k1", 24).alias("anchor"), "k1", "k2", "doc_id", "h", "at", "kind", "repeated")
    return columns.mapInArrow(run, "doc_id long, h long, at long, repeated boolean")


def position_rows(left: DataFrame) -> DataFrame:
    """One row for each position of the stretches ``left`` over (``doc_id``, ``h``, ``text``, ``ats``): ``n1``, ``n2`` (its name),
    the place, and whether an earlier position of the same batch has the name; such ones come as runs."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        order = np.array(sorted(range(batch.num_rows), key=_order(batch)))
        docs, h = batch.column("doc_id").take(pa.array(order)), batch.column("h").take(pa.array(order))
        texts, ats = common.texts_bytes(batch.column("text")), batch.column("ats").to_pylist()
        of, begin, size, slices = [], [], [], []
        for i, row in enumerate(order.tolist()):
            for at in sorted(ats[row]):
                first, more = at >> 16, at & 255
                of.append(i)
                begin.append(first)
                size.append(more + 1)
                slices.append(texts[row][first : first + more + LENGTH])
        data = np.frombuffer(b"".join(slices), dtype=np.uint8)
        size, widths = np.array(size, dtype=np.int64), np.array([len(x) for x in slices], dtype=np.int64)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        p = np.repeat(np.cumsum(widths) - widths, size) + within  # in the data
        names = []
        for factor in (0x2545F4914F6CDD1D, 0xD1342543DE82EF95):
            gram, name = gram_hashes(data, factor), np.zeros(len(p), dtype=np.uint64)
            for offset in OFFSETS:
                name = _mix(name * np.uint64(factor) + gram[p + offset])
            names.append(name)
        n1, n2 = names
        place, of = np.repeat(np.array(begin, dtype=np.int64), size) + within, np.repeat(np.array(of, dtype=np.int64), size)
        by = np.lexsort((np.arange(len(p)), n2, n1))
        same = np.zeros(len(p), dtype=bool)
        same[by[1:]] = (n1[by[1:]] == n1[by[:-1]]) & (n2[by[1:]] == n2[by[:-1]])
        new = np.flatnonzero(~same)
        again = np.flatnonzero(same)
        cut = np.concatenate([[True], (np.diff(place[again]) != 1) | (np.diff(of[again]) != 0)]) if len(again) else np.zeros(0, dtype=bool)
        run = np.flatnonzero(cut)
        length = np.diff(np.append(run, len(again)))
        head = again[run]
        rows = np.concatenate([new, head])
        ids = pa.array(of[rows])
        more = np.concatenate([np.zeros(len(new), dtype=np.int64), length - 1])
        zero = np.zeros(len(head), dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([n1[new].view(np.int64), zero])), pa.array(np.concatenate([n2[new].view(np.int64), zero])),
                docs.take(ids), h.take(ids), pa.array(place[rows]), pa.array(more), pa.array(np.arange(len(rows)) >= len(new)),
            ],
            ["n1", "n2", "doc_id", "h", "first", "more", "repeated"],
        )

    return common.map_batches(left, work, "n1 long, n2 long, doc_id long, h long, first long, more long, repeated boolean")


def repeated_positions(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``h``, ``first``, ``more`` of positions whose string also starts earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            n1, n2, repeated = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n1", "n2", "repeated"))
            out = np.zeros(len(n1), dtype=bool)
            out[1:] = (n1[1:] == n1[:-1]) & (n2[1:] == n2[:-1]) & ~repeated[:-1]
            if before is not None:
                out[0] = before == (n1[0], n2[0])
            out |= repeated
            before = None if repeated[-1] else (n1[-1], n2[-1])
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(np.flatnonzero(out))) for c in ("doc_id", "h", "first", "more")], ["doc_id", "h", "first", "more"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    route = F.when(F.col("repeated"), F.xxhash64("doc_id", "first")).otherwise(F.col("n1"))
    dealt = rows.repartition(n, route).sortWithinPartitions("repeated", "n1", "n2", F.col("doc_id").asc_nulls_last(), "h", "first")
    return dealt.mapInArrow(run, "doc_id long, h long, first long, more long")


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id``, ``text`` and ``h``, which tells rows of one id apart (a hash of the text, or zero where ids are unique), of
    all rows, and of one row for each document."""
    rows = common.texts_of(docs)
    twice = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    rows = rows.withColumn("h", common.text_hash(F.col("text")) if twice else F.lit(0).cast("long"))
    return rows, rows.dropDuplicates(["doc_id", "h"]) if twice else rows


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``h`` and ``starts`` (array of first position, further positions) where strings start that also start
    earlier. ``rows``: one for each document, from :func:`keyed`."""
    spark = rows.sparkSession
    judged = common.stored(sorted_out(stretch_rows(rows)), "stretches")
    common.release(spark)

    def with_texts(left: DataFrame) -> DataFrame:
        ats = left.filter(~F.col("repeated")).groupBy(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).agg(F.collect_list("at").alias("ats"))
        return rows.join(ats, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))).select("doc_id", "h", "text", "ats")

    blocks = common.stored(sorted_out(block_rows(with_texts(judged))), "blocks")
    common.release(spark)
    found = common.stored(repeated_positions(position_rows(with_texts(blocks))), "positions")
    common.release(spark)
    whole = judged.union(blocks).filter("repeated").select("doc_id", "h", F.shiftright("at", 16).alias("first"), F.col("at").bitwiseAND(255).alias("more"))
    return whole.union(found).groupBy("doc_id", "h").agg(F.collect_list(F.struct("first", "more")).alias("starts"))


def _spans(starts: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for first, more in sorted((s["first"], s["more"]) for s in starts):
        stop = min(size, first + more + LENGTH)
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([first, stop])
    return [(s, e) for s, e in out]


def cleaned(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``kept`` (binary), ``n_bytes``, ``spans`` (array of start, stop of removed runs) of every row.

    A null text is empty. Rows that agree in id and text are one document: they keep and lose the same. Of rows with one id
    and different texts, that with the smaller hash of the text is earlier; a null id comes last. Texts of fewer than
    ``LENGTH`` bytes lose nothing. An empty table gives an empty table. Other columns are not read.
    """
    common.ready(docs.sparkSession)
    rows, documents = keyed(docs)
    ranges = repeated_ranges(documents).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "starts")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, sizes, runs = [], [], []
        for data, starts in zip(common.texts_bytes(batch.column("text")), batch.column("starts").to_pylist(), strict=True):
            data = data or b""
            spans, at, parts = _spans(starts or [], len(data)), 0, []
            for s, e in spans:
                parts.append(data[at:s])
                at = e
            kept.append(b"".join([*parts, data[at:]]))
            sizes.append(len(data))
            runs.append([{"start": s, "stop": e} for s, e in spans])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(runs, kind)], ["doc_id", "kept", "n_bytes", "spans"])

    joined = rows.join(ranges, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left").select("doc_id", "text", "starts")
    return common.map_batches(joined, work, "doc_id long, kept binary, n_bytes long, spans array<struct<start: bigint, stop: bigint>>")


def report(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of what :func:`cleaned` gives."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["stop"] - x["start"])
    return cleaned(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
