"""Segments: the searchable ledger cut by tenant and time, so that a question meets only what it may see.

A *segment* is one row: up to ``SEGMENT_ROWS`` versions of one tenant as columns, the postings of their tokens, and the bounds of
their times and scopes. Versions are cut by how long they were valid (still open ones apart, the others by powers of two of a
day) and sorted by their start. Versions of one class that are valid at one instant then start within twice the class's length of
each other: they lie in few neighbouring segments with tight bounds, and long or open intervals don't widen the bounds of
short ones. A question skips every segment whose bounds its instant, its knowledge time or its ceiling rule out.

Text search reads postings shortest list first and block by block in the order of ids. A block keeps the largest count in it. Once
the pool is full, blocks, and then whole lists, whose best possible score is below the pool's last, or equal to it with later
ids, are passed over. What a task has found in earlier segments counts: a question's full pool of them is the least that later ones
must beat. Only versions that are looked at are checked against the hard filters. Results are exact, ties included.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.frames import frame_bytes
from chronoweave.ledger import org_bucket
from chronoweave.operators.ordered import keep_top
from chronoweave.session import cut_lineage, prepare

SEGMENT_ROWS, POSTING_BLOCK = 16384, 256
#: Segments of a large ledger hold more, so that a question meets fewer of them, as long as each core has about so many.
MOST_ROWS, SEGMENTS_A_CORE = 131_072, 8
#: Rows of segments that are made in one task, and lie in one file.
FILE_ROWS = 32768
#: Filters whose versions a segment in a task remembers, within so many bytes.
MASKS, MASK_BYTES = 1000, 32 << 20
#: Beyond the room for a broadcast, neighbouring files of about so many rows together meet a question in one task, which tells one
#: pool for all of them; more questions than this are dealt to several tasks, and the segments sent to each.
GROUP_ROWS, GROUP_QUESTIONS = 262_144, 16_384
GROUPS_A_CORE = 4  # while there are files for as many groups
#: Questions up to this measured size are sent to all tasks; more meet the segments by a join of the bounds.
QUESTION_BYTES = 32 << 20
#: Questions that meet the segments of a task at once beyond that.
QUESTION_BLOCK = 2000
#: What stands for no end, and for nothing learned: later and earlier than any instant.
FAR = 1 << 62
DAY_US = 86_400_000_000
#: What stands for no known scope: above any ceiling.
NO_SCOPE = 1 << 30
TEXT_UNIT = 0.1  # fixed value: one occurrence of a word

_TIMES = {"from_us": "valid_from", "until_us": "valid_until", "rec_us": "recorded_at", "learned_us": "valid_until_recorded_at", "revoked_us": "revoked_at"}
_BOUNDS = ("min_from", "max_until", "min_rec", "max_learned", "min_scope")
_NAMES = ("entity_type", "external_id", "property", "source_id")
_ASKED = {"entity_type": "entity_type", "external_id": "external_ids", "property": "properties", "source_id": "source_ids"}
_FILTERS = ("valid_us", "known_us", "ceiling", "min_authority", "min_confidence", *_ASKED.values())


def lasting() -> Column:
    """The class of a version: 0 under a day, then by doublings; open ones come last."""
    days = (F.unix_micros("valid_until") - F.unix_micros("valid_from")) / F.lit(DAY_US)
    return F.when(F.col("valid_until").isNull(), 99).otherwise(F.floor(F.log2(1 + F.greatest(days, F.lit(0.0))))).cast("int")


def _schema(org_type: str, id_type: str) -> str:
    return (
        f"organization_id {org_type}, segment long, n int, min_from long, max_until long, min_rec long, max_learned long, min_scope int, "
        f"ids array<{id_type}>, from_us array<long>, until_us array<long>, rec_us array<long>, learned_us array<long>, revoked_us array<long>, "
        "scope array<int>, authority array<int>, confidence array<double>, entity_type array<string>, external_id array<string>, "
        "property array<string>, source_id array<string>, tokens array<string>, ends array<int>, docs array<int>, counts array<int>"
    )


def build(rows: DataFrame, docs: DataFrame, folder: str, *, size: int | None = None) -> DataFrame:
    """Write the segments of ``rows`` (:func:`retrieval.searchable` versions) with the tokens of ``docs``, and read them back.
    ``size``: the most versions of a segment; by default it follows the rows."""
    spark = prepare(rows.sparkSession)
    org_type, id_type = (rows.schema[c].dataType.simpleString() for c in ("organization_id", "id"))
    ends = {"until_us": FAR, "learned_us": -FAR, "revoked_us": FAR, "from_us": FAR, "rec_us": FAR}
    times = [F.coalesce(F.unix_micros(c), F.lit(ends[n])).alias(n) for n, c in _TIMES.items()]
    joined = rows.join(docs.select("organization_id", "id", "tokens"), ["organization_id", "id"])
    flat = joined.select(
        "organization_id", "id", lasting().alias("class"), *times, F.coalesce("scope", F.lit(NO_SCOPE)).alias("scope"), F.col("authority").cast("int").alias("authority"),
        F.col("confidence").cast("double").alias("confidence"), *[F.col(c).cast("string").alias(c) for c in _NAMES], "tokens",
    )
    n = rows.count()
    if size is None:
        size = min(max(n // (SEGMENTS_A_CORE * spark.sparkContext.defaultParallelism), SEGMENT_ROWS), MOST_ROWS)
    parts = max(1, math.ceil(n / max(size, FILE_ROWS)))
    order = ["organization_id", "class", "from_us", "id"]
    schema = pa.schema([(f.name, f.type) for f in _arrow(_schema(org_type, id_type))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, task, held = 0, TaskContext.get().partitionId(), []

        def closed(table: pa.Table) -> pa.RecordBatch:
            nonlocal made
            made += 1
            return _segment(table, task << 32 | made - 1, schema)

        table = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.concat_tables([*held, pa.Table.from_batches([batch])]).combine_chunks()
            key = pc.binary_join_element_wise(table["organization_id"].cast(pa.string()), table["class"].cast(pa.string()), " ")
            codes = key.combine_chunks().dictionary_encode().indices.to_numpy()
            edges = np.append(np.append(0, np.flatnonzero(np.diff(codes)) + 1), len(codes))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                while b - a >= size or b < len(codes) and b > a:
                    yield closed(table.slice(a, min(size, b - a)))
                    a += min(size, b - a)
            held = [table.slice(a)]
        if held and held[0].num_rows:
            yield closed(held[0])

    segments = flat.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(cut, _schema(org_type, id_type))
    segments.withColumn("org_bucket", org_bucket()).write.mode("overwrite").partitionBy("org_bucket").parquet(folder)
    return spark.read.schema(_schema(org_type, id_type) + ", org_bucket int").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Segments that :func:`build` has written."""
    return prepare(spark).read.parquet(folder)


def _arrow(ddl: str) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return list(to_arrow_schema(StructType.fromDDL(ddl)))


def _segment(table: pa.Table, number: int, schema: pa.Schema) -> pa.RecordBatch:
    table = table.sort_by("id").combine_chunks()
    column = lambda c: table[c].chunk(0) if table[c].num_chunks else pa.array([], table.schema.field(c).type)
    us = {c: column(c).to_numpy() for c in _TIMES}
    scope = column("scope").to_numpy()
    lists = column("tokens")
    flat = lists.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(lists), dtype=np.int64), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    words = flat.dictionary
    code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pair, counts = np.unique(code * len(lists) + doc, return_counts=True)
    ends = np.searchsorted(pair // max(1, len(lists)), np.arange(len(words) + 1))
    value = {
        "organization_id": column("organization_id")[0], "segment": number, "n": table.num_rows, "min_from": us["from_us"].min(),
        "max_until": us["until_us"].max(), "min_rec": us["rec_us"].min(), "max_learned": us["learned_us"].max(), "min_scope": scope.min(),
        "tokens": words, "ends": ends, "docs": pair % max(1, len(lists)), "counts": counts, "ids": column("id"),
    } | {c: column(c) for c in (*_TIMES, "scope", "authority", "confidence", *_NAMES)}

    def single(field: pa.Field) -> pa.Array:
        v = value[field.name]
        if pa.types.is_list(field.type):
            v = v if isinstance(v, pa.Array) else pa.array(v)
            return pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v.cast(field.type.value_type))
        return pa.array([v.as_py() if isinstance(v, pa.Scalar) else v], field.type)

    return pa.RecordBatch.from_arrays([single(f) for f in schema], schema=schema)


class Segment:
    """One segment in a task."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.batch, self.row = batch, row
        self.n = batch.column("n")[row].as_py()
        self.array = {c: self._values(c).to_numpy() for c in (*_TIMES, "scope", "authority", "confidence")}
        self.codes: dict[str, tuple[np.ndarray, dict]] = {}
        self._places: dict[str, int] | None = None
        self._lists: dict[str, tuple | None] = {}
        self._numbers: np.ndarray | None = None
        self._masks: dict[tuple, np.ndarray | dict] = {}
        self._held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self._seen: np.ndarray | None = None

    def _values(self, name: str) -> pa.Array:
        return self.batch.column(name)[self.row].values

    def ids(self) -> pa.Array:
        return self._values("ids")

    def numbers(self) -> np.ndarray:
        """The ids as an array."""
        if self._numbers is None:
            self._numbers = self.ids().to_numpy(zero_copy_only=False)
        return self._numbers

    def names(self, docs: np.ndarray) -> np.ndarray:
        """The ids of some versions as they are; among nulls, numbers alone would become inexact."""
        ids = self.ids()
        return np.array(ids.take(pa.array(docs)).to_pylist(), dtype=object) if ids.null_count else self.numbers()[docs]

    def postings(self, token: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int] | None:
        """Of a token: documents, counts, largest count and first document of each block, and the largest count of all. Most tokens of
        a segment are never asked for."""
        if self._places is None:
            self._places = {word: k for k, word in enumerate(self._values("tokens").to_pylist())}
            self._held = tuple(self._values(c).to_numpy() for c in ("ends", "docs", "counts"))
        if token not in self._places:
            return None
        if token not in self._lists:
            k, (ends, docs, counts) = self._places[token], self._held
            held, c = docs[ends[k] : ends[k + 1]], counts[ends[k] : ends[k + 1]]
            blocks = np.maximum.reduceat(c, np.arange(0, len(c), POSTING_BLOCK))
            self._lists[token] = held, c, blocks, held[::POSTING_BLOCK], int(blocks.max())
        return self._lists[token]

    def coded(self, name: str) -> tuple[np.ndarray, dict]:
        if name not in self.codes:
            d = self._values(name).dictionary_encode()
            self.codes[name] = d.indices.fill_null(-1).to_numpy(), {v: k for k, v in enumerate(d.dictionary.to_pylist())}
        return self.codes[name]

    def eligible(self, q: dict, docs: np.ndarray | slice) -> np.ndarray:
        """The hard filters of one question for some of the versions."""
        a, at, known = self.array, q["valid_us"], q["known_us"]
        ok = a["from_us"][docs] <= at
        if known is None:
            ok &= (a["until_us"][docs] > at) & (a["revoked_us"][docs] == FAR)
        else:
            ok &= (a["rec_us"][docs] <= known) & ((a["until_us"][docs] > at) | (a["learned_us"][docs] > known)) & (a["revoked_us"][docs] > known)
        ok &= a["scope"][docs] <= q["ceiling"]
        if q["min_authority"] is not None:
            ok &= a["authority"][docs] >= q["min_authority"]
        if q["min_confidence"] is not None:
            ok &= a["confidence"][docs] >= q["min_confidence"]
        for name, asked in _ASKED.items():
            wanted = q[asked]
            if wanted is not None:
                codes, numbers = self.coded(name)
                some = [numbers[w] for w in ([wanted] if isinstance(wanted, str) else wanted) if w in numbers]
                ok &= np.isin(codes[docs], some)
        return ok

    def seen_by(self, q: dict, docs: np.ndarray) -> np.ndarray:
        """:meth:`eligible`; for filters that come again with another question it is worked out for all versions at once, and kept."""
        if "filters" not in q:
            q["filters"] = tuple(tuple(v) if isinstance(v, list) else v for v in map(q.get, _FILTERS))
        key = q["filters"]
        held = self._masks.get(key)
        if held is None or held is q:
            if len(self._masks) >= min(MASKS, max(1, MASK_BYTES // self.n)):
                self._masks.clear()
            self._masks[key] = q
            return self.eligible(q, docs)
        if isinstance(held, dict):
            self._masks[key] = held = self.eligible(q, slice(None))
        return held[docs]

    def text_hits(self, q: dict, least: tuple | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """The pool's versions with their counts, and how many postings were looked at. ``least``: a score and an id that a version
        must beat."""
        pool, looked = q["pool"], 0
        own = sorted((x for x in map(self.postings, q["tokens"]) if x is not None), key=lambda x: len(x[0]))
        best = [most for *_, most in own]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self._seen is None:
            self._seen = np.zeros(self.n, bool)
        seen, touched = self._seen, []
        # the last score and place that may be in the pool, once it is full
        floor = None if least is None else (least[0], int(np.searchsorted(self.numbers(), least[1])) - 1)
        last: tuple[int, int] | None = floor
        for i, (held, counts, blocks, firsts, _) in enumerate(own):
            rest = sum(best[i + 1 :])
            if last and best[i] + rest < last[0]:
                break
            some = np.arange(len(blocks))
            if last:
                some = np.flatnonzero((blocks + rest > last[0]) | (blocks + rest == last[0]) & (firsts <= last[1]))
            for b in some.tolist():
                part = held[b * POSTING_BLOCK : (b + 1) * POSTING_BLOCK]
                if last and int(blocks[b]) + rest <= last[0]:  # none beats it, or equals it with an earlier id only
                    part = part[: np.searchsorted(part, last[1], "right")] if int(blocks[b]) + rest == last[0] else part[:0]
                    if not len(part):
                        continue
                looked += len(part)
                fresh = ~seen[part]
                fresh[fresh] = self.seen_by(q, part[fresh])
                seen[part] = True
                touched.append(part)
                new, sums = part[fresh], counts[b * POSTING_BLOCK : b * POSTING_BLOCK + len(part)][fresh].astype(np.int64)
                if not len(new):
                    continue
                for others, their, *_ in own[i + 1 :]:
                    at = np.minimum(np.searchsorted(others, new), len(others) - 1)
                    sums = sums + np.where(others[at] == new, their[at], 0)
                docs, scores = np.concatenate([docs, new]), np.concatenate([scores, sums])
                if len(docs) >= pool:
                    order = np.lexsort((docs, -scores))[:pool]
                    docs, scores = docs[order], scores[order]
                    last = int(scores[-1]), int(docs[-1])
                    if floor and (floor[0], -floor[1]) > (last[0], -last[1]):
                        last = floor
        for part in touched:
            seen[part] = False
        if floor:
            better = (scores > floor[0]) | (scores == floor[0]) & (docs <= floor[1])
            docs, scores = docs[better], scores[better]
        return docs, scores, looked


def _bounds(asked: DataFrame) -> Column:
    """Whether a segment (plain names) can hold anything for a question (``valid_us``, ``known_us``, ``ceiling``)."""
    known = F.col("known_us")
    return (
        (F.col("min_from") <= F.col("valid_us")) & (F.col("min_scope") <= F.col("ceiling")) & (known.isNull() | (F.col("min_rec") <= known))
        & ((F.col("max_until") > F.col("valid_us")) | F.coalesce(F.col("max_learned") > known, F.lit(False)))
    )


def asked_columns(questions: DataFrame, tokens: Column | None = None) -> DataFrame:
    """What segments read of normalised questions."""
    return questions.select(
        "question_id", "organization_id", "pool", F.unix_micros("valid_at").alias("valid_us"), F.unix_micros("known_at").alias("known_us"),
        F.col("ceiling").cast("int").alias("ceiling"), "entity_type", "external_ids", "properties",
        F.transform("source_ids", lambda x: x.cast("string")).alias("source_ids"),
        F.col("min_authority").cast("int").alias("min_authority"), F.col("min_confidence").cast("double").alias("min_confidence"),
        (F.array().cast("array<string>") if tokens is None else tokens).alias("tokens"),
    )


def meet(
    segments: DataFrame, asked: DataFrame, work: Callable[[Segment, dict, dict], tuple | None], types: list[pa.DataType], schema: str, *,
    told: Callable[[tuple], tuple] | None = None, question_bytes: int = QUESTION_BYTES, group_rows: int = GROUP_ROWS, group_questions: int = GROUP_QUESTIONS,
) -> DataFrame:
    """``work(segment, question, notes)`` for every segment and question that the bounds don't part; ``work`` returns equally long
    columns, which stand behind ``question_id`` and ``organization_id``, and may keep notes for later segments of its task, under
    the ``id`` of the question. With ``told`` only what it makes of a question's notes, once its task's segments are through, is
    returned."""
    spark = segments.sparkSession
    asked = cut_lineage(asked)  # measured, and then sent
    kinds = [_arrow(f"x {asked.schema[c].dataType.simpleString()}")[0].type for c in ("question_id", "organization_id")]
    full = f"question_id {asked.schema['question_id'].dataType.simpleString()}, organization_id {asked.schema['organization_id'].dataType.simpleString()}, {schema}"
    names = [f.name for f in _arrow(full)]

    def let_in(some: list[dict], low: int, until: int, rec: int, learned: int, scope: int) -> list[dict]:
        return [
            q for q in some
            if low <= q["valid_us"] and scope <= q["ceiling"] and (until > q["valid_us"] or q["known_us"] is not None and learned > q["known_us"])
            and (q["known_us"] is None or rec <= q["known_us"])
        ]

    def answered(segment: Segment, some: list[dict], notes: dict) -> Iterator[pa.RecordBatch]:
        found = [(q, work(segment, q, notes)) for q in some]
        if told is None:
            yield from batch_of([(q, columns) for q, columns in found if len(columns[0])])

    def concluded(some: list[dict], notes: dict) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(some) if told else 0, QUESTION_BLOCK):
            yield from batch_of([(q, told(notes[id(q)])) for q in some[low : low + QUESTION_BLOCK] if id(q) in notes])

    def batch_of(found: list[tuple[dict, tuple]]) -> Iterator[pa.RecordBatch]:
        if found:
            sizes = [len(columns[0]) for _, columns in found]
            number = pa.array(np.repeat(np.arange(len(found)), sizes))
            asked_by = [pa.array([q[c] for q, _ in found], kind).take(number) for c, kind in zip(("question_id", "organization_id"), kinds, strict=True)]
            rest = [pa.concat_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c in parts]) for parts, t in zip(zip(*(columns for _, columns in found), strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*asked_by, *rest], names=names)

    if frame_bytes(asked) <= question_bytes:
        by_org: dict = {}
        for row in asked.toLocalIterator():
            by_org.setdefault(row.organization_id, []).append(row.asDict())
        sent = spark.sparkContext.broadcast(by_org)
        heads = asked.agg(F.max("valid_us").alias("t"), F.min("valid_us").alias("first"), F.min("known_us").alias("k"), F.max("ceiling").alias("c")).first()
        if not by_org:
            return spark.createDataFrame([], full)
        # bounds of all questions together prune row groups, buckets of their tenants prune folders
        buckets = [r[0] for r in asked.select(org_bucket().alias("b")).distinct().collect()]
        near = segments.where(F.col("org_bucket").isin(buckets) & (F.col("min_from") <= heads.t) & (F.col("min_scope") <= heads.c))
        late = F.col("max_until") > heads.first
        near = near.where(late if heads.k is None else late | (F.col("max_learned") > heads.k)).drop("org_bucket")
        # neighbours are asked the same questions: dealt out, no task gets all of the much asked ones
        near = near.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "segment")

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            notes: dict = {}
            for batch in batches:
                orgs, bounds = batch.column("organization_id").to_pylist(), [batch.column(c).to_pylist() for c in _BOUNDS]
                for row, (org, *own) in enumerate(zip(orgs, *bounds, strict=True)):
                    some = let_in(sent.value.get(org, ()), *own)
                    if some:
                        yield from answered(Segment(batch, row), some, notes)
            for some in sent.value.values():
                yield from concluded(some, notes)

        return near.mapInArrow(scan, full)
    # The files that :func:`build` has made lie in order: neighbours stay together, each question is sent to them once, and only if
    # their bounds together let it in.
    sizes = segments.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.countDistinct(F.shiftright("segment", 32)).alias("files")).first()
    wanted = max(-(-sizes.rows // group_rows), min(sizes.files, GROUPS_A_CORE * spark.sparkContext.defaultParallelism), 1)
    part = F.floor(F.shiftright("segment", 32) / F.lit(max(1, round(sizes.files / wanted)))).cast("long")
    lows, highs = (F.min(c).alias(c) for c in ("min_from", "min_rec", "min_scope")), (F.max(c).alias(c) for c in ("max_until", "max_learned"))
    bounds = segments.groupBy("organization_id", part.alias("part")).agg(*lows, *highs)
    right = asked.join(F.broadcast(bounds), "organization_id").where(_bounds(asked)).select(F.col("organization_id").alias("of"), "part", *asked.columns)
    left = segments.drop("org_bucket").withColumn("__part", part)
    most = right.groupBy("of", "part").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = -(-most // group_questions)
    block = F.lit(0)
    if blocks > 1:  # only the parts that many questions see are sent to several tasks
        of = right.groupBy(F.col("of").alias("organization_id"), F.col("part").alias("__part")).agg(F.ceil(F.count(F.lit(1)) / F.lit(group_questions)).cast("int").alias("__blocks"))
        of = cut_lineage(of)
        left = left.join(F.broadcast(of), ["organization_id", "__part"]).withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).drop("__blocks")
        right = right.join(F.broadcast(of.select(F.col("organization_id").alias("of"), F.col("__part").alias("part"), "__blocks")), ["of", "part"])
        right = right.withColumn("block", F.pmod(F.xxhash64("question_id"), F.col("__blocks")).cast("int")).drop("__blocks")
    else:
        left, right = left.withColumn("__block", block), right.withColumn("block", block)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes may be much work: not left to their size
    kinds_all = pa.schema([(n, t) for n, t in zip(names, [*kinds, *types], strict=True)])

    def group(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            held = [(Segment(batch, row), [batch.column(c)[row].as_py() for c in _BOUNDS]) for batch in a.to_batches() for row in range(batch.num_rows)]
            for low in range(0, b.num_rows, QUESTION_BLOCK):
                some, notes = b.slice(low, QUESTION_BLOCK).to_pylist(), {}
                out += [x for segment, own in held for x in answered(segment, let_in(some, *own), notes)]
                out += concluded(some, notes)
        return pa.Table.from_batches(out).cast(kinds_all) if out else kinds_all.empty_table()

    left, right = left.repartition(tasks, "organization_id", "__part", "__block"), right.repartition(tasks, "of", "part", "block")
    return left.groupBy("organization_id", "__part", "__block").cogroup(right.groupBy("of", "part", "block")).applyInArrow(group, full)


def text_hits(segments: DataFrame, asked: DataFrame, max_pool: int, *, question_bytes: int = QUESTION_BYTES) -> DataFrame:
    """(question_id, organization_id, id, text_score, text_rank) of versions sharing any token of :func:`asked_columns`."""
    id_type = segments.schema["ids"].dataType.elementType.simpleString()

    def work(segment: Segment, q: dict, notes: dict):
        held = notes.get(id(q))
        docs, scores, _ = segment.text_hits(q, held and held[-1])
        if len(docs):
            ids, names, sums, least = segment.numbers()[docs], segment.names(docs), scores, None
            if held:
                ids, names, sums = (np.concatenate(x) for x in zip(held[:-1], (ids, names, sums), strict=True))
            if len(ids) >= q["pool"]:
                order = np.lexsort((ids, -sums))[: q["pool"]]
                ids, names, sums = ids[order], names[order], sums[order]
                least = int(sums[-1]), ids[-1]
            notes[id(q)] = ids, names, sums, least

    types = [_arrow(f"x {id_type}")[0].type, pa.int64()]
    found = meet(segments, asked, work, types, f"id {id_type}, hits long", told=lambda held: held[1:3], question_bytes=question_bytes)
    scored = found.withColumn("text_score", F.col("hits") * TEXT_UNIT).drop("hits")
    top = keep_top(scored, ["question_id"], [F.col("text_score").desc(), F.col("id")], max_pool, "text_rank")
    return top.join(asked.select("question_id", F.col("pool").alias("__pool")), "question_id").where(F.col("text_rank") <= F.col("__pool")).drop("__pool")


def eligible_counts(segments: DataFrame, asked: DataFrame, *, question_bytes: int = QUESTION_BYTES) -> DataFrame:
    """How many versions each question may see, a row for each segment that has any: ``question_id``, ``organization_id``, ``versions``."""

    def work(segment: Segment, q: dict, notes: dict):
        n = int(segment.eligible(q, slice(None)).sum())
        return ([n] if n else [],)

    return meet(segments, asked, work, [pa.int64()], "versions long", question_bytes=question_bytes)


def text_work(segments: DataFrame, asked: DataFrame) -> DataFrame:
    """Per question and segment met: postings ``looked`` at, postings ``held`` of the question's tokens, ``versions`` of the segment."""

    def work(segment: Segment, q: dict, notes: dict):
        own = [x for x in map(segment.postings, q["tokens"]) if x is not None]
        return [segment.text_hits(q)[2]], [sum(len(x[0]) for x in own)], [segment.n]

    return meet(segments, asked, work, [pa.int64()] * 3, "looked long, held long, versions long")
