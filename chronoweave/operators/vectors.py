"""Nearest neighbours as blocked matrix products inside Spark tasks.

Rows never meet questions as pairs in a shuffle: a task multiplies its block of vectors with a
block of question vectors, keeps the best ``pool`` per question, and only those rows travel.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.frames import frame_bytes
from chronoweave.operators.ordered import keep_top
from chronoweave.session import cut_lineage

QUESTION_BYTES = 32 << 20  # questions up to this measured size are broadcast, more meet blocks of rows by cell
BLOCK_BYTES = 32 << 20  # questions of a cell beyond this are split into blocks, and its rows are sent to each
BLOCK_PAIRS = (100_000_000, 2_000_000_000)  # so are those that make more pairs than these with a block of rows: of a second to ten
GROUPS_A_CORE = 8  # tells which, between the two: so that all cores have about so many tasks to end alike
BLOCK_ROWS = 200_000  # the larger, the fewer copies of questions and the fewer pools of theirs
SAMPLE, PROBED = 8, (4, 32)  # one in so many rows tells how near the nearest few pools of a block are, which are tried first
SAMPLED = 8192  # of a large block a sparser sample, of about so many rows, tells it
BLOCK_CELLS = 4_000_000  # distances a task holds at once
SINGLE = 4e-7  # what a product of unit vectors in single precision may be off by, for each of their numbers
# Decimal places by which distances are ordered. Sums of other engines differ in their last digits; rounded, equal vectors tie
# in any of them. What is returned is not rounded: to round it again to fewer places would not give the nearest number.
PLACES = 9

# Of a block of rows and a table of questions: which questions may see anything of the block, and a function of a question's
# place and places of rows that tells which of these rows it may see.
Mask = Callable[[pd.DataFrame, pd.DataFrame], tuple[np.ndarray, Callable[[int, np.ndarray], np.ndarray]]]


def unit(vectors: Sequence) -> np.ndarray:
    m = np.asarray(list(vectors), dtype=np.float64)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0, 1.0, norm)


def _promising(row: np.ndarray, least: float, pool: int, allowed: Callable[[np.ndarray], np.ndarray], slack: float) -> np.ndarray:
    """Places of at least this likeness that a full pool of allowed ones does not surely beat. The likest, as a sample of the
    block tells, are tried first, so that most of a block is never checked."""
    every = max(SAMPLE, len(row) // SAMPLED)
    some = row[::every]
    for pools in PROBED:
        size = -(-pools * pool // every)
        if not 0 < size < len(some):
            break
        bar = np.partition(some, len(some) - size)[len(some) - size]
        if bar <= least:
            break
        first = np.flatnonzero(row >= bar)
        likely = row[first[allowed(first)]]
        if len(likely) >= pool:
            least = max(least, np.partition(likely, len(likely) - pool)[len(likely) - pool] - 2 * slack)
            break
    return np.flatnonzero(row >= least)


def pick_nearest(
    ids: np.ndarray, vectors: np.ndarray, who: np.ndarray, asked: np.ndarray, pools, limits: np.ndarray, allowed=None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Who asked, ids and distances of the nearest rows of one block for each question, ties at the edge by id.

    ``who`` numbers the questions whose unit vectors are ``asked``; ``pools`` rows are wanted (of each, or of all alike);
    ``limits``, by number, is the distance within which a question has already found that many in earlier blocks of the
    task: what is farther is not worth sending. ``allowed(question, places)`` may mask the rows at some places.

    A product in single precision, with its error allowed for, picks the rows whose distances are then taken exactly.
    """
    pools = np.broadcast_to(np.asarray(pools), len(who))
    out_who, out_ids, out_distances = [who[:0]], [ids[:0]], [np.zeros(0)]
    step = max(1, BLOCK_CELLS // max(1, len(ids)))
    slack = SINGLE * vectors.shape[1] + 10.0**-PLACES if vectors.ndim == 2 else 1.0
    rough = np.ascontiguousarray(vectors.astype(np.float32).T)
    for low in range(0, len(who) if len(ids) else 0, step):
        part = asked[low : low + step]
        likeness = part.astype(np.float32) @ rough
        for j in range(len(part)):
            row, pool, number = likeness[j], int(pools[low + j]), who[low + j]
            least = 1.0 - limits[number] - slack
            if allowed is None:
                near = np.flatnonzero(row >= least)
            else:
                may = partial(allowed, low + j)
                found = np.isfinite(limits[number])  # earlier blocks have left little to check
                near = np.flatnonzero(row >= least) if found else _promising(row, least, pool, may, slack)
                near = near[may(near)]
            if len(near) > 2 * pool:
                some = row[near]
                near = near[some >= np.partition(some, len(some) - pool)[len(some) - pool] - 2 * slack]
            if not len(near):
                continue
            exact = 1.0 - (vectors[near] * part[j]).sum(axis=1)  # row by row: the same for equal vectors in any block
            column = np.round(exact, PLACES)
            kept = np.isfinite(column) & (column <= limits[number])
            near, column, exact = near[kept], column[kept], exact[kept]
            if len(near) >= pool:
                edge = np.partition(column, pool - 1)[pool - 1]
                kept = column <= edge  # ties at the edge are settled by id below
                near, column, exact = near[kept], column[kept], exact[kept]
                limits[number] = edge
            order = np.lexsort((ids[near], column))[:pool]
            if len(order):
                out_who.append(np.repeat(who[low + j : low + j + 1], len(order)))
                out_ids.append(ids[near[order]])
                out_distances.append(exact[order])
    return np.concatenate(out_who), np.concatenate(out_ids), np.concatenate(out_distances)


class _Pools:
    """The nearest rows that the questions of a group have found in the blocks of one task so far."""

    def __init__(self, pools: np.ndarray):
        self.pools, self.limits = pools, np.full(len(pools), np.inf)
        self.found: list[tuple] = []
        self.size, self.room = 0, 2 * int(pools.sum()) + BLOCK_ROWS

    def add(self, who: np.ndarray, ids: np.ndarray, distances: np.ndarray) -> None:
        if len(who):
            self.found.append((who, ids, distances))
            self.size += len(who)
        if self.size > self.room:
            self.found = [self.best()]
            self.size = len(self.found[0][0])

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """No more than a pool for each question; what is farther than a full pool is not looked at again."""
        if len(self.found) < 2:
            return self.found[0]
        who, ids, distances = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((ids, np.round(distances, PLACES), who))
        who, ids, distances = who[order], ids[order], distances[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        last = place == self.pools[who] - 1
        self.limits[who[last]] = np.round(distances[last], PLACES)
        kept = place < self.pools[who]
        return who[kept], ids[kept], distances[kept]


def _look(rows: pd.DataFrame, by_group: dict, group: list[str], mask: Mask | None, pools: dict) -> None:
    """Add to ``pools`` the nearest rows of one block for each question of the same group. ``by_group``: questions of a group and
    their unit vectors."""
    for key, part in rows.groupby(group):
        if key not in by_group:
            continue
        asked, vectors = by_group[key]
        held = pools.setdefault(key, _Pools(asked["pool"].to_numpy()))
        who, allowed = np.arange(len(asked)), None
        if mask is not None:
            may, pairs = mask(part, asked)
            who = np.flatnonzero(may)
            allowed = lambda j, places, who=who, pairs=pairs: pairs(who[j], places)
        held.add(*pick_nearest(part["id"].to_numpy(), unit(part["embedding"]), who, vectors[who], held.pools[who], held.limits, allowed))


def _told(by_group: dict, pools: dict, ids: np.ndarray) -> pd.DataFrame:
    """What the pools hold; ``ids``: of the type of ids."""
    names, found, distances = [], [], []
    for key, held in pools.items():
        if held.found:
            who, some, distance = held.best()
            names.append(by_group[key][0]["question_id"].to_numpy()[who])
            found.append(some)
            distances.append(distance)
    if names:
        return pd.DataFrame({"question_id": np.concatenate(names), "id": np.concatenate(found), "distance": np.concatenate(distances)})
    return pd.DataFrame({"question_id": np.zeros(0, object), "id": ids[:0], "distance": np.zeros(0)})


def _best(rows: pd.DataFrame, by_group: dict, group: list[str], mask: Mask | None) -> pd.DataFrame:
    """The ``pool`` nearest rows of one block for each question of the same group."""
    pools: dict = {}
    _look(rows, by_group, group, mask, pools)
    return _told(by_group, pools, rows["id"].to_numpy())


def _grouped(questions: pd.DataFrame, group: list[str]) -> dict:
    return {key: (part, unit(part["vector"])) for key, part in questions.groupby(group)} if len(questions) else {}


def nearest_blocks(
    rows: DataFrame,
    questions: DataFrame,
    *,
    group: list[str],
    dims: int,
    mask: Mask | None = None,
    cell: Column | None = None,
    bounds: Mapping[str, Column] | None = None,
    meets: Column | None = None,
    order: Sequence[str] = (),
    question_bytes: int = QUESTION_BYTES,
    block_bytes: int = BLOCK_BYTES,
    block_rows: int = BLOCK_ROWS,
    block_pairs: tuple[int, int] = BLOCK_PAIRS,
) -> DataFrame:
    """(question_id, id, distance, rank): the ``pool`` nearest rows of the same group per question.

    ``rows``: ``id, embedding``, the group columns and what ``mask`` reads; ``questions``:
    ``question_id, vector, pool``, the group columns and what ``mask`` reads. Distances are ordered as rounded to ``PLACES``,
    so equal vectors tie whatever blocks they were computed in; ties go by id.

    Blocks are cut from rows of one ``cell`` of a group. ``bounds`` are aggregates of a cell's rows, and ``meets``, of these
    and the questions' columns, tells whether a question can see anything of it. Where the questions are broadcast, batches
    are cut from the rows in ``order``.
    """
    spark = rows.sparkSession
    id_type = rows.schema["id"].dataType.simpleString()
    q_type = questions.schema["question_id"].dataType.simpleString()
    schema = f"question_id {q_type}, id {id_type}, distance double"
    questions = cut_lineage(questions)  # counted, measured and sent
    n_asked = questions.count()
    asked_bytes = frame_bytes(questions.withColumn("vector", F.size("vector"))) + n_asked * 8 * dims
    if asked_bytes <= question_bytes:
        shared = spark.sparkContext.broadcast(questions.toPandas())

        def scan(batches):
            pools: dict = {}
            by_group, ids = _grouped(shared.value, group), None
            for batch in batches:
                _look(batch, by_group, group, mask, pools)
                ids = batch["id"].to_numpy()[:0]
            if ids is not None:
                yield _told(by_group, pools, ids)

        if order:
            tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
            rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        local = rows.mapInPandas(scan, schema)
    else:
        # Blocks of rows meet the questions of the same group; groups and cells nobody can see stay out. A row is sent once, unless
        # more questions than a task can hold see its cell.
        home = [*group, "__cell"]
        rows = rows.withColumn("__cell", F.lit("") if cell is None else cell)
        salts = F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("__salts")
        sizes = rows.groupBy(*home).agg(salts, F.count(F.lit(1)).alias("__rows"), *[c.alias(n) for n, c in (bounds or {}).items()])
        q = questions.join(F.broadcast(sizes), group)
        q = (q if meets is None else q.where(meets)).drop(*(bounds or {}))
        q = q.withColumn("__cell", F.concat("__cell", F.lit("")))  # a column of its own: both sides have it from the rows
        held = F.count(F.lit(1)) * F.lit(-(-asked_bytes // max(1, n_asked)))
        pairs = F.count(F.lit(1)) * F.max("__rows")
        seen = cut_lineage(q.groupBy(*home, "__salts").agg(held.alias("__held"), pairs.alias("__pairs")))
        every = seen.agg(F.sum("__pairs")).first()[0] or 0
        most = min(max(every // (GROUPS_A_CORE * spark.sparkContext.defaultParallelism), block_pairs[0]), block_pairs[1])
        blocks = F.greatest(F.col("__held") / F.lit(block_bytes), F.col("__pairs") / F.col("__salts") / F.lit(most))
        met = seen.select(*home, "__salts", F.ceil(blocks).cast("int").alias("__blocks"))
        q = q.drop("__rows")
        number = F.pmod(F.xxhash64("question_id"), F.col("__blocks")).cast("int")
        q = q.join(F.broadcast(met.drop("__salts")), home).withColumn("__qb", number).drop("__blocks")
        q = q.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts")
        r = rows.join(F.broadcast(met), home).withColumn("__salt", F.pmod(F.xxhash64("id"), F.col("__salts")).cast("int"))
        r = r.withColumn("__qb", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).drop("__salts", "__blocks")
        key = [*home, "__qb", "__salt"]
        # few bytes may be much work: the number of tasks is not left to their size
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        local = (
            r.repartition(tasks, *key).groupBy(*key).cogroup(q.repartition(tasks, *key).groupBy(*key)).applyInPandas(
                lambda left, right: _best(left, _grouped(right, group), group, mask), schema
            )
        )
    pools = questions.groupBy("question_id").agg(F.max("pool").alias("__pool"))
    largest = pools.agg(F.max("__pool")).first()[0] or 0
    top = keep_top(local, ["question_id"], [F.round("distance", PLACES), F.col("id")], largest, "rank")
    return top.join(pools, "question_id").where(F.col("rank") <= F.col("__pool")).drop("__pool")


def nearest(rows: DataFrame, questions: DataFrame, n: int, dims: int, group: list[str]) -> DataFrame:
    """The n nearest rows of the same tenant and model."""
    return nearest_blocks(rows, questions.withColumn("pool", F.lit(n)), group=group, dims=dims)


def ann_recall(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Per question the share of the exact top k that the approximate top k found."""
    e = exact.where(F.col("rank") <= k).select("question_id", "id")
    a = approx.where(F.col("rank") <= k).select("question_id", "id", F.lit(1).alias("__hit"))
    return (
        e.join(a, ["question_id", "id"], "left")
        .groupBy("question_id")
        .agg((F.coalesce(F.sum("__hit"), F.lit(0)) / k).alias("recall"))
    )
