"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector passes it when it lies in the cap around that direction. Two near vectors share some cap with high
probability, two others hardly ever, so only vectors that passed the same filter are compared. The directions form a random
product code: a vector is rotated at random (signs and a Hadamard transform) and cut into blocks, each block has a small code
of random unit vectors, and every combination of one code word a block is a direction. There are millions of directions from
hundreds of words, and :meth:`Code.decode` lists all that a vector passes without trying the others: block by block it keeps
the partial sums that can still reach the threshold, and takes the last block's words from a sorted list. A vector in no cap of
a code passes the direction nearest to it.

The code fits the largest group: the larger it is, the narrower the caps, so that a cap holds about ``CAP`` unrelated vectors at any
size. Codes, each with a rotation of its own, are added until, of ``TRIED`` random pairs at exactly the least cosine, a share of ``RECALL``
have a filter in common; nearer pairs are found more often. Both depend only on the group's size, the dimension and the seed.

Every pair found is compared exactly (in doubles) and counted once, in the first filter that its vectors share. Pairs are not
emitted: a group of a filter gives each vector's number of links and one edge to a root of its spanning forest.

Hot groups. Equal vectors are one, with a multiplicity. Where a filter holds more than ``block`` vectors, those within half the angle of
the filter's first vector form a *ball*: any two of them are near, so their links are counted by the ball's size and
not compared. What is left meets in blocks of bounded size: loose vectors with all, balls with other balls.

Vectors link only when their labels are equal and not null, and their dimensions are equal. Vectors that are null, empty or zero, or
hold null or non-finite components, link with nothing. Rows that repeat in full are one vector; an id with several vectors
keeps a row for each and is one node for ``component_id``. A null id links with nothing, has no component and is kept. Columns other
than ``vec_id``, ``label`` and ``embedding`` are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import common

#: Share of pairs at the least cosine that must have a filter in common, and the pairs it is measured on.
RECALL, TRIED = 0.99, 4000
#: Unrelated vectors of a group that a cap holds on average, and directions of one code that a vector passes on average.
CAP, PASSES = 32, 2
#: Vectors of a filter that are compared at once.
BLOCK = 1024
SEED = 20

_KEY = ["label", "dim", "filter", "left", "right"]
_PASSED = "label long, dim int, id long, h1 long, h2 long, copies long, unit binary, filters array<long>"
_LINKS = "label long, id long, h1 long, h2 long, links long, to long"


def _rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Rows of ``x`` after signs and a Hadamard transform, three times, in the next power of two of dimensions: lengths and
    angles stay."""
    size = 1 << max(0, (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), size))
    out[:, : x.shape[1]] = x
    draw = np.random.default_rng(seed)
    for _ in range(3):
        out *= draw.choice([-1.0, 1.0], size)
        step = 1
        while step < size:
            pairs = out.reshape(len(x), size // (2 * step), 2, step)
            out = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(x), size)
            step *= 2
        out /= math.sqrt(size)
    return out


class Code:
    """Directions for one dimension: ``blocks`` blocks with ``words`` code words each, and the threshold of a cap."""

    def __init__(self, dim: int, blocks: int, words: int, tail: float, seed: int = SEED):
        self.dim, self.blocks, self.words, self.seed = dim, blocks, words, seed
        size = 1 << max(0, (dim - 1).bit_length())
        self.cuts = [size * b // blocks for b in range(blocks + 1)]
        draw = np.random.default_rng((seed, words))
        self.codes = []
        for b in range(blocks):
            code = draw.standard_normal((words, self.cuts[b + 1] - self.cuts[b]))
            self.codes.append(code / np.linalg.norm(code, axis=1, keepdims=True) / math.sqrt(blocks))
        # from the normal tail down, until random vectors pass ``PASSES`` directions on average
        probe = np.random.default_rng((seed, dim)).standard_normal((300, dim))
        probe /= np.linalg.norm(probe, axis=1, keepdims=True)
        self.least = NormalDist().inv_cdf(1 - tail) / math.sqrt(size)
        while len(self.decode(probe)[0]) < PASSES * len(probe):
            self.least *= 0.98

    def scores(self, units: np.ndarray) -> list[np.ndarray]:
        turned = _rotated(units, self.seed)
        return [turned[:, a:b] @ code.T for a, b, code in zip(self.cuts[:-1], self.cuts[1:], self.codes, strict=True)]

    def decode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``row``, ``filter`` of all directions that the rows of ``units`` pass, in no order. The nearest direction always counts as
        passed, so that no vector is without a filter."""
        scores = self.scores(units)
        highest = [s.max(axis=1) for s in scores]
        row, name, total = np.arange(len(units)), np.zeros(len(units), np.int64), np.zeros(len(units))
        for b, s in enumerate(scores[:-1]):
            rest = sum(highest[b + 1 :])
            need = self.least - rest[row] - total  # a word with less can't be completed
            keep, word = np.nonzero(s[row] >= need[:, None])
            total = total[keep] + s[row[keep], word]
            name = name[keep] * self.words + word
            row = row[keep]
        # the last block: from each row's sorted list, those that are enough; rows are laid out apart on one line
        order = np.argsort(-scores[-1], axis=1, kind="stable")
        line = np.take_along_axis(-scores[-1], order, axis=1) + 4.0 * np.arange(len(units))[:, None]
        enough = np.searchsorted(line.ravel(), total - self.least + 4.0 * row, side="right") - row * self.words
        enough = np.clip(enough, 0, self.words)
        at = np.arange(enough.sum()) - np.repeat(np.cumsum(enough) - enough, enough)
        row, name = np.repeat(row, enough), np.repeat(name, enough)
        name = name * self.words + order[row, at]
        none = np.flatnonzero(sum(highest) < self.least)
        nearest = np.zeros(len(units), np.int64)
        for s in scores:
            nearest = nearest * self.words + s.argmax(axis=1)
        return np.concatenate([row, none]), np.concatenate([name, nearest[none]])


class Codes:
    """Several product codes, each with a rotation of its own, so that a pair that one code divides has new chances in the others."""

    def __init__(self, dim: int, blocks: int, words: int, tail: float):
        self.dim, self.span = dim, words**blocks
        self.make = lambda k: Code(dim, blocks, words, tail, SEED + 7 * k)
        self.codes: list[Code] = []

    def grow(self) -> Code:
        self.codes.append(self.make(len(self.codes)))
        return self.codes[-1]

    def decode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``row``, ``filter`` of all directions of all codes that the rows of ``units`` pass."""
        found = [code.decode(units) for code in self.codes]
        return np.concatenate([row for row, _ in found]), np.concatenate([name + k * self.span for k, (_, name) in enumerate(found)])


def pairs_at(dim: int, cosine: float, tried: int = TRIED, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors with this cosine."""
    draw = np.random.default_rng(seed + 1)
    x, z = draw.standard_normal((2, tried, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return x, cosine * x + math.sqrt(1 - cosine**2) * z


def shared(code: Code | Codes, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of ``x`` and ``y`` pass a filter together."""
    met = np.zeros(len(x), bool)
    for low in range(0, len(x), 500):
        (i, f), (j, g) = code.decode(x[low : low + 500]), code.decode(y[low : low + 500])
        span = max(f.max(initial=0), g.max(initial=0)) + 1
        met[low + np.unique(np.intersect1d(i * span + f, j * span + g) // span)] = True
    return met


@lru_cache(maxsize=64)
def fitted(dim: int, size: int, cosine: float) -> Codes | None:
    """The codes for groups of up to ``size`` vectors; None for fewer than three dimensions, where one filter takes all.

    A code has ``PASSES`` times as many directions as it takes to cover a vector once on average; codes are added until the measured
    share of pairs is reached. Below 16 dimensions blocks are too short for a product, and caps stay wide enough for a plain code.
    """
    if dim < 3:
        return None
    tail = min(0.02, CAP / max(1, size))
    if dim < 16:
        tail = max(tail, 1e-4)
    blocks = 1 if dim < 16 else 2 if size < 1 << 20 else 3
    codes = Codes(dim, blocks, math.ceil((PASSES / tail) ** (1 / blocks)), tail)
    x, y = pairs_at(dim, cosine)
    met = np.zeros(TRIED, bool)
    while met.mean() < RECALL:
        left = np.flatnonzero(~met)
        met[left] = shared(codes.grow(), x[left], y[left])
    return codes


def usable(vectors: DataFrame) -> DataFrame:
    """``id``, ``label``, ``embedding`` (doubles) and two hashes of the vectors that may link, each once."""
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(sound)
    return v.withColumns({"h1": F.xxhash64(F.lit(1), "v"), "h2": F.xxhash64(F.lit(2), "v")})


def _units(column: pa.Array, dims: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``dim``, rows and unit vectors of an array column."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        v = flat[offsets[rows][:, None] + np.arange(dim)].astype(np.float64)
        v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
        yield int(dim), rows, v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def passed(vectors: DataFrame, cosine: float) -> DataFrame:
    """Each different vector of a label once, with its multiplicity and the filters it passes; stored."""
    rows = usable(vectors)
    members = rows.select("label", "h1", "h2", "id").distinct()
    classes = members.groupBy("label", "h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    first = rows.join(classes, ["label", "h1", "h2", "id"]).groupBy("label", "h1", "h2", "id").agg(F.first("copies").alias("copies"), F.first("v").alias("v"))
    first = common.stored(first, "vectors")
    size = first.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(5)
        dims = np.diff(column.offsets.to_numpy())
        units: list[bytes] = [b""] * batch.num_rows
        filters: list[list[int]] = [[]] * batch.num_rows
        for dim, rows, unit in _units(column, dims):
            code = fitted(dim, size, cosine)
            for i, u in zip(rows, unit, strict=True):
                units[i] = u.tobytes()
            if code is None:
                for i in rows:
                    filters[i] = [0]
                continue
            row, name = code.decode(unit)
            order = np.lexsort((name, row))
            ends = np.searchsorted(row[order], np.arange(len(rows) + 1))
            for k, i in enumerate(rows):
                filters[i] = name[order][ends[k] : ends[k + 1]]
        columns = [batch.column(0), pa.array(dims, pa.int32()), *(batch.column(c) for c in (3, 1, 2, 4))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(units), pa.array(filters, pa.list_(pa.int64()))], names=["label", "dim", "id", "h1", "h2", "copies", "unit", "filters"])

    return common.stored(common.map_batches(first.select("label", "h1", "h2", "id", "copies", "v"), work, _PASSED), "passed")


def balls(keys: DataFrame, hot: DataFrame, cosine: float) -> DataFrame:
    """``label, id, h1, h2, ball``: vectors within half the least angle of the first vector of a hot filter; ``ball`` is that vector's
    id, the smallest where there are several."""
    flat = keys.select("label", "dim", F.explode("filters").alias("filter"), "id", "h1", "h2", "unit")
    there = flat.join(hot.select("label", "dim", "filter", F.col("pivot.id").alias("ball"), F.col("pivot.h1").alias("p1"), F.col("pivot.h2").alias("p2")), ["label", "dim", "filter"])
    # a vector meets each different pivot of its filters once
    there = there.select("label", "id", "h1", "h2", "ball", "p1", "p2").distinct()
    pivots = hot.select("label", F.col("pivot.id").alias("ball"), F.col("pivot.h1").alias("p1"), F.col("pivot.h2").alias("p2")).distinct()
    pivots = pivots.join(keys.select("label", F.col("id").alias("ball"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("unit").alias("centre")), ["label", "ball", "p1", "p2"])
    met = there.join(pivots, ["label", "ball", "p1", "p2"]).join(keys.select("label", "id", "h1", "h2", "unit"), ["label", "id", "h1", "h2"])
    half = math.cos(math.acos(cosine) / 2) + 1e-9

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        near = [float(np.dot(np.frombuffer(a), np.frombuffer(b))) >= half for a, b in zip(batch.column("unit").to_pylist(), batch.column("centre").to_pylist(), strict=True)]
        return batch.select(["label", "id", "h1", "h2", "ball", "p1", "p2"]).filter(pa.array(near))

    near = common.map_batches(met.select("label", "id", "h1", "h2", "ball", "p1", "p2", "unit", "centre"), work, "label long, id long, h1 long, h2 long, ball long, p1 long, p2 long")
    own = near.groupBy("label", "id", "h1", "h2").agg(F.min(F.struct("ball", "p1", "p2")).alias("p"))
    # the pivot's hashes go along: an id may have several vectors
    return own.select("label", "id", "h1", "h2", F.col("p.ball").alias("pivot"), F.xxhash64("label", "p.ball", "p.p1", "p.p2").alias("ball"))


def _mates(key: list[str], units: DataFrame, hot: DataFrame) -> DataFrame:
    """``unit`` pairs of hot filters whose members have to be compared: ``left``, ``right`` for every ``unit`` that takes part."""
    loose = units.filter("ball IS NULL")
    left = loose.select(*key, F.col("unit").alias("left"))
    with_loose = left.join(units.select(*key, F.col("unit").alias("right"), F.col("ball")), key).filter("ball IS NOT NULL OR left <= right").select(*key, "left", "right")
    heads = units.filter("ball IS NOT NULL").select(*key, "ball", "pieces").distinct()
    two = heads.select(*key, F.col("ball").alias("b1")).join(heads.select(*key, F.col("ball").alias("b2")), key).filter("b1 < b2")
    one = units.filter("ball IS NOT NULL").select(*key, "ball", "unit")
    across = two.join(one.withColumnsRenamed({"ball": "b1", "unit": "left"}), [*key, "b1"]).join(one.withColumnsRenamed({"ball": "b2", "unit": "right"}), [*key, "b2"]).select(*key, "left", "right")
    pairs = with_loose.unionByName(across)
    ends = pairs.select(*key, "left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("unit"))
    return ends


def _compared(table: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of a group that are near, not of one ball, and in no earlier common filter."""
    units = np.stack([np.frombuffer(u) for u in table.column("unit").to_pylist()])
    left, right = table.column("left")[0].as_py(), table.column("right")[0].as_py()
    if left == right:
        i, j = np.nonzero(np.triu(units @ units.T >= cosine, 1))
    else:
        own = table.column("unit_of").to_numpy()
        a, b = np.flatnonzero(own == left), np.flatnonzero(own == right)
        if not len(a) or not len(b):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i, j = np.nonzero(units[a] @ units[b].T >= cosine)
        i, j = a[i], b[j]
    ball = table.column("ball").to_pylist()
    number = {b: n for n, b in enumerate(sorted({b for b in ball if b is not None}))}
    code = np.array([-1 - n if b is None else number[b] for n, b in enumerate(ball)])
    keep = code[i] != code[j]
    i, j = i[keep], j[keep]
    if len(i):
        this = table.column("filter")[0].as_py()
        earlier = [[f for f in fs if f < this] for fs in table.column("filters").to_pylist()]
        width = max(1, max(map(len, earlier)))
        lists = np.full((len(earlier), width), -1, np.int64)
        for n, fs in enumerate(earlier):
            lists[n, : len(fs)] = fs
        first = np.ones(len(i), bool)
        for low in range(0, len(i), 20_000):
            a, b = lists[i[low : low + 20_000]], lists[j[low : low + 20_000]]
            met = np.zeros(len(a), bool)
            for c in range(width):
                met |= ((a[:, c, None] == b) & (a[:, c, None] >= 0)).any(axis=1)
            first[low : low + 20_000] = ~met
        i, j = i[first], j[first]
    return i, j


def links(keys: DataFrame, cosine: float, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Of the vectors of :func:`passed`: ``label, id, h1, h2, links, to`` per group (links found there, an id linked with it), and the
    vectors in balls; both stored."""
    key = ["label", "dim", "filter"]
    narrow = keys.select("label", "dim", F.explode("filters").alias("filter"), "id", "h1", "h2")
    sizes = narrow.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "h1", "h2")).alias("pivot"))
    hot = common.stored(sizes.filter(F.col("n") > block), "hot-filters")
    ball = common.stored(balls(keys, hot, cosine), "balls")
    wide = keys.join(ball.drop("pivot"), ["label", "id", "h1", "h2"], "left")
    wide = wide.select("label", "dim", F.explode("filters").alias("filter"), "id", "h1", "h2", "copies", "unit", "filters", "ball")
    zero = F.lit(0).cast("long")
    cold = wide.join(hot.select(*key), key, "left_anti").withColumns({"unit_of": zero, "left": zero, "right": zero})
    # members of a hot filter: those of a ball, and those of none, in units of at most about a block
    members = narrow.join(hot.select(*key), key).join(ball.drop("pivot"), ["label", "id", "h1", "h2"], "left")
    counted = members.groupBy(*key, "ball").agg(F.count(F.lit(1)).alias("m")).withColumn("pieces", F.ceil(F.col("m") / block).cast("long"))
    counted = common.stored(counted, "hot-units")
    named = F.xxhash64(F.coalesce("ball", zero), F.col("ball").isNull(), "piece")
    units = counted.withColumn("piece", F.explode(F.sequence(zero, F.col("pieces") - 1))).withColumn("unit", named)
    mates = _mates(key, units, hot)
    hottest = wide.join(counted.withColumnRenamed("ball", "of").select(*key, "of", "pieces"), [wide[c] == counted[c] for c in key] + [wide["ball"].eqNullSafe(F.col("of"))])
    hottest = hottest.select(*(wide[c] for c in wide.columns), "pieces").withColumn("piece", F.pmod(F.xxhash64("id", "h1"), F.col("pieces"))).withColumn("unit_of", named).drop("pieces", "piece")
    dealt = hottest.join(mates.withColumnRenamed("unit", "unit_of"), [*key, "unit_of"])
    columns = [*_KEY, "unit_of", "id", "h1", "h2", "copies", "unit", "filters", "ball"]
    rows = cold.select(*columns).unionByName(dealt.select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.whole_runs(batches, _KEY):
            bounds = common.run_starts(table, _KEY)
            out: list[pa.Table] = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a < 2:
                    continue
                group = table.slice(a, b - a)
                i, j = _compared(group, cosine)
                if not len(i):
                    continue
                copies, ids = group.column("copies").to_numpy(), group.column("id").to_numpy()
                found = np.zeros(b - a, np.int64)
                np.add.at(found, i, copies[j])
                np.add.at(found, j, copies[i])
                forest = common.Forest(b - a)
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    forest.join(x, y)
                at = np.flatnonzero(found)
                to = ids[[forest.root(x) for x in at.tolist()]]
                out.append(pa.table([group.column("label").take(pa.array(at)), pa.array(ids[at]), group.column("h1").take(pa.array(at)), group.column("h2").take(pa.array(at)), pa.array(found[at]), pa.array(to)], names=["label", "id", "h1", "h2", "links", "to"]))
            if out:
                yield from pa.concat_tables(out).to_batches()

    found = rows.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(run, _LINKS)
    return common.stored(found, "vector-links"), ball


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, block: int = BLOCK) -> DataFrame:
    """``vec_id``, ``n_links`` (other vectors linked directly), ``component_id`` (smallest id reachable), ``kept`` (whether that is the
    vector's own id), a row per vector."""
    common.ready(vectors.sparkSession)
    keys = passed(vectors, cosine)
    found, ball = links(keys, cosine, block)
    own = ["label", "id", "h1", "h2"]
    in_ball = ball.join(keys.select(*own, "copies"), own)
    held = in_ball.groupBy("ball").agg(F.sum("copies").alias("held"))
    by_ball = in_ball.join(held, "ball").select(*own, (F.col("held") - F.col("copies")).alias("links"))
    counts = found.select(*own, "links").unionByName(by_ball).groupBy(*own).agg(F.sum("links").alias("links"))
    counted = keys.select(*own, "copies").join(counts, own, "left").select("label", "h1", "h2", F.col("id").alias("rep"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    members = usable(vectors).select("label", "h1", "h2", "id").distinct()
    of_class = members.join(counted, ["label", "h1", "h2"])
    edges = found.select(F.col("id").alias("a"), F.col("to").alias("b")).unionByName(ball.select(F.col("id").alias("a"), F.col("pivot").alias("b")))
    edges = edges.unionByName(of_class.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    roots = common.components(edges)
    linked = of_class.join(roots, of_class["id"] == roots["node"], "left").select("id", "n_links", F.coalesce("root", "id").alias("component_id"))
    one = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    hashes = {"h1": F.xxhash64(F.lit(1), "v"), "h2": F.xxhash64(F.lit(2), "v"), "none": F.col("v").isNull()}
    alone = one.withColumns(hashes).select("id", "label", "h1", "h2", "none").distinct()
    alone = alone.join(members, alone["id"].eqNullSafe(members["id"]) & alone["label"].eqNullSafe(members["label"]) & (alone["h1"] == members["h1"]) & (alone["h2"] == members["h2"]), "left_anti")
    # an id with several vectors, one of which links, is one node
    alone = alone.join(roots, alone["id"] == roots["node"], "left").select("id", F.lit(0).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
