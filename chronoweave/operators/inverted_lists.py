"""Inverted lists kept in folders: a vector index that is built once, grows by appending and is read in part.

Centroids have two levels. Coarse ones cut the sphere into cells and are few enough for every task; each cell has its fine
centroids, one per list, which travel only to where the cell's rows and questions are. A list is a folder, so a search reads the
folders of the lists that its questions probe (partition pruning) and nothing else.

How many lists a question probes follows from the gap between centroids: all lists whose centroid is at most ``gap`` farther
than the nearest. The gap is measured when the index is built: rows of a sample ask, their exact neighbours are looked up, and the
gap is set so that the wanted share of neighbours lies in probed lists. In well separated data that is one or two lists; where
nothing separates it is many, and recall holds all the same.

Fitting uses a sample bounded by ``FIT_ROWS`` a list; every row is indexed.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.frames import frame_bytes
from chronoweave.operators.ordered import keep_top
from chronoweave.operators.vectors import PLACES, QUESTION_BYTES, nearest, nearest_blocks, pick_nearest, unit

#: Lists of one index; the number of folders.
MAX_LISTS = 16_384
#: Rows of the fitting sample per list, rows of it that one cell may train on, and rows that ask for the gap.
FIT_ROWS, CELL_ROWS, ASKING_ROWS = 256, 20_000, 512
#: Rows that are assigned to lists at once.
BLOCK_ROWS = 20_000
#: Lists of one cell are numbered from ``cell * STRIDE``.
STRIDE = MAX_LISTS


@dataclass
class ListIndex:
    """Where the lists are, and what a search needs before it reads any: coarse centroids; of each cell the angles to its
    nearest and farthest fine centroid; the gap."""

    folder: str
    dims: int
    id_type: str
    gap: float
    coarse: list[list[float]]
    inner: list[float] = field(default_factory=list)
    outer: list[float] = field(default_factory=list)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"id {self.id_type}, embedding array<float>, list int").parquet(f"{self.folder}/rows")

    def centroids(self, spark: SparkSession) -> DataFrame:
        """``cell``, ``list``, ``centroid``."""
        return spark.read.parquet(f"{self.folder}/centroids")


def _lloyd(points: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centroids of unit vectors on the sphere; empty ones are dropped."""
    draw = np.random.default_rng(seed)
    centres = points[draw.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        of = np.argmax(points @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, points)
        held = np.bincount(of, minlength=len(centres)) > 0
        centres = unit(sums[held])
    return centres


def _nearest_cell(coarse: np.ndarray):
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=np.argmax(unit(batch["embedding"]) @ coarse.T, axis=1).astype(np.int32))

    return add


def _celled(rows: DataFrame, coarse: np.ndarray) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(_nearest_cell(coarse), f"{schema}, cell int")


def assign(rows: DataFrame, index: ListIndex) -> DataFrame:
    """``rows`` with ``list``: the nearest fine centroid of the nearest cell. Cells however large are dealt out in bounded blocks."""
    spark = rows.sparkSession
    celled = _celled(rows, np.asarray(index.coarse))
    sizes = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("salts"))
    dealt = celled.join(F.broadcast(sizes), "cell").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("salts")
    centres = index.centroids(spark).join(F.broadcast(sizes), "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def choose(block: pd.DataFrame, fine: pd.DataFrame) -> pd.DataFrame:
        block = block.drop(columns=["cell", "salt"])
        if not len(block):
            return block.assign(list=np.zeros(0, np.int32))
        fine = fine.sort_values("list")
        of = np.argmax(unit(block["embedding"]) @ unit(fine["centroid"]).T, axis=1)
        return block.assign(list=fine["list"].to_numpy()[of].astype(np.int32))

    return dealt.groupBy("cell", "salt").cogroup(centres.groupBy("cell", "salt")).applyInPandas(choose, f"{schema}, list int")


def append(index: ListIndex, rows: DataFrame) -> None:
    """Add ``rows`` (``id``, ``embedding``) to the lists; nothing that is stored is rewritten."""
    assign(rows.select("id", "embedding"), index).write.mode("append").partitionBy("list").parquet(f"{index.folder}/rows")


def build(rows: DataFrame, folder: str, lists: int, dims: int, *, recall: float = 0.97, seed: int = 7, neighbours: int = 10) -> ListIndex:
    """Fit, fill and measure an index of ``rows`` (``id``, ``embedding``) in ``folder``, with about ``lists`` lists; ``recall``: the share of
    exact neighbours that should lie in probed lists."""
    if lists > MAX_LISTS:
        raise ValueError(f"{lists} lists; at most {MAX_LISTS} are supported")
    spark = rows.sparkSession
    rows = rows.select("id", "embedding")
    n = rows.count()
    share = max(1, n // max(1, FIT_ROWS * lists))
    rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(share)) == 0).write.mode("overwrite").parquet(f"{folder}/sample")
    sample = spark.read.parquet(f"{folder}/sample")
    cells = max(1, round(math.sqrt(lists)))
    fewer = max(1, sample.count() // (FIT_ROWS * cells))
    first = sample.where(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(fewer)) == 0).select("embedding").toPandas()
    coarse = _lloyd(unit(first["embedding"]), cells, seed) if len(first) else np.zeros((1, dims))
    present = sorted(r[0] for r in _celled(sample, coarse).select("cell").distinct().collect())
    coarse = coarse[present] if present else coarse  # a cell without rows has no lists
    celled = _celled(sample, coarse)
    held = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("held"))
    total = F.lit(max(1, sample.count()))
    wanted = held.select("cell", F.greatest(F.lit(1), F.round(F.lit(lists) * F.col("held") / total)).cast("int").alias("fine"), F.ceil(F.col("held") / CELL_ROWS).cast("int").alias("every"))
    trained = celled.join(F.broadcast(wanted), "cell").where(F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.col("every")) == 0)

    def train(cell: pd.DataFrame) -> pd.DataFrame:
        c = int(cell["cell"].iloc[0])
        centres = _lloyd(unit(cell.sort_values("id")["embedding"]), int(cell["fine"].iloc[0]), seed)
        angles = np.arccos(np.clip(centres @ coarse[c], -1, 1))
        return pd.DataFrame({"cell": np.int32(c), "list": (c * STRIDE + np.arange(len(centres))).astype(np.int32), "centroid": list(centres), "angle": angles})

    fine = trained.groupBy("cell").applyInPandas(train, "cell int, list int, centroid array<double>, angle double")
    fine.write.mode("overwrite").parquet(f"{folder}/centroids")
    spans = {r.cell: (r.low, r.high) for r in spark.read.parquet(f"{folder}/centroids").groupBy("cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high")).collect()}
    inner, outer = ([spans[c][i] for c in range(len(coarse))] if spans else [0.0] for i in (0, 1))
    index = ListIndex(folder, dims, rows.schema["id"].dataType.simpleString(), 0.0, coarse.tolist(), inner, outer)
    append(index, rows.withColumn("embedding", F.col("embedding").cast("array<float>")))
    if n:
        index.gap = _measured_gap(index, spark, n, recall, seed, neighbours)
    _save(index, spark)
    return index


def _save(index: ListIndex, spark: SparkSession) -> None:
    spark.createDataFrame([(json.dumps(asdict(index)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{index.folder}/index")


def load(spark: SparkSession, folder: str) -> ListIndex:
    return ListIndex(**json.loads(spark.read.text(f"{folder}/index").first()[0]) | {"folder": folder})


def _measured_gap(index: ListIndex, spark: SparkSession, n: int, recall: float, seed: int, neighbours: int) -> float:
    """The gap within which a share of ``recall`` of the exact neighbours of sampled rows lie, themselves left out."""
    stored = index.rows(spark)
    every = max(1, n // ASKING_ROWS)
    asking = stored.where(F.pmod(F.xxhash64("id", F.lit(seed + 3)), F.lit(every)) == 0)
    asking = asking.select(F.col("id").alias("question_id"), F.col("embedding").alias("vector"), F.lit(0).alias("g")).limit(2 * ASKING_ROWS)
    found = nearest(stored.select("id", "embedding", F.lit(0).alias("g")), asking, neighbours + 1, index.dims, ["g"]).where("question_id <> id")
    where = stored.select("id", "list")
    distances = list_distances(index, asking.drop("g"), everything=True)
    least = distances.groupBy("question_id").agg(F.min("distance").alias("least"))
    gaps = found.select("question_id", "id").join(where, "id").join(distances, ["question_id", "list"]).join(least, "question_id")
    share = gaps.select((F.col("distance") - F.col("least")).alias("gap")).agg(F.percentile("gap", F.lit(recall))).first()[0]
    return float(share or 0.0) + 1e-9


def list_distances(index: ListIndex, questions: DataFrame, *, everything: bool = False) -> DataFrame:
    """``question_id``, ``list``, ``distance`` of all lists that can lie within the gap (or of all). A cell is left out when even its
    farthest-reaching fine centroid is beyond the gap for sure, by the triangle inequality of angles."""
    spark = questions.sparkSession
    q_type = questions.schema["question_id"].dataType.simpleString()
    coarse, gap = np.asarray(index.coarse), index.gap
    inner, outer = np.asarray(index.inner), np.asarray(index.outer)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            angle = np.arccos(np.clip(unit(batch["vector"]) @ coarse.T, -1, 1))
            surely = 1 - np.cos(np.minimum(np.pi, (angle + inner).min(axis=1)))  # some list is at least so near
            at_best = 1 - np.cos(np.maximum(0, angle - outer))
            meets = np.ones_like(at_best, dtype=bool) if everything else at_best <= surely[:, None] + gap + 1e-9
            row, cell = np.nonzero(meets)
            yield pd.DataFrame({"question_id": batch["question_id"].to_numpy()[row], "vector": list(batch["vector"].to_numpy()[row]), "cell": cell.astype(np.int32)})

    vector = questions.schema["vector"].dataType.simpleString()
    asked = questions.select("question_id", "vector").mapInPandas(cells, f"question_id {q_type}, vector {vector}, cell int")
    salts = 1 + questions.count() // BLOCK_ROWS
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("question_id"), F.lit(salts)).cast("int"))
    centres = index.centroids(spark).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(int(salts - 1)))))

    def measure(block: pd.DataFrame, fine: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(fine):
            return pd.DataFrame({"question_id": block["question_id"].iloc[:0], "list": np.zeros(0, np.int32), "distance": np.zeros(0)})
        distance = np.round(1.0 - unit(block["vector"]) @ unit(fine["centroid"]).T, PLACES)
        return pd.DataFrame({
            "question_id": np.repeat(block["question_id"].to_numpy(), len(fine)),
            "list": np.tile(fine["list"].to_numpy(), len(block)), "distance": distance.ravel(),
        })

    out = asked.groupBy("cell", "salt").cogroup(centres.groupBy("cell", "salt")).applyInPandas(measure, f"question_id {q_type}, list int, distance double")
    return out


def probed(index: ListIndex, questions: DataFrame) -> DataFrame:
    """``question_id``, ``list``: the lists that each question reads."""
    distances = list_distances(index, questions)
    least = distances.groupBy("question_id").agg(F.min("distance").alias("least"))
    return distances.join(least, "question_id").where(F.col("distance") <= F.col("least") + index.gap).select("question_id", "list")


def read_lists(index: ListIndex, spark: SparkSession, probes: DataFrame) -> DataFrame:
    """The rows of the lists that are probed: other folders are not opened. At most ``MAX_LISTS`` numbers reach the driver."""
    numbers = sorted(r[0] for r in probes.select("list").distinct().collect())
    return index.rows(spark).where(F.col("list").isin(numbers))


def search(index: ListIndex, questions: DataFrame, n: int, *, question_bytes: int = QUESTION_BYTES) -> DataFrame:
    """``question_id``, ``id``, ``distance``, ``rank``: the ``n`` nearest rows among the probed lists of each question (``question_id``,
    ``vector``), by exact distance.

    Up to ``question_bytes``, as measured, the questions go to all tasks once, with the numbers of those that probe a list;
    beyond that blocks of questions meet blocks of some lists' rows: a question is sent to a bin of lists once, with those of
    them that it probes.
    """
    spark = questions.sparkSession
    questions = questions.select("question_id", "vector")
    probes = probed(index, questions).persist()
    try:
        probes.count()
        rows = read_lists(index, spark, probes)
        asked = questions.count()
        size = asked * 8 * index.dims + frame_bytes(probes)
        if size <= question_bytes:
            return _scanned(rows, questions, probes, n)
        bins = F.lit(int(max(1, rows.count() // BLOCK_ROWS)))
        some = probes.groupBy("question_id", F.pmod("list", bins).alias("bin")).agg(F.collect_list("list").alias("lists"))
        probing = some.join(questions, "question_id").withColumn("pool", F.lit(n))
        return nearest_blocks(
            rows.withColumn("bin", F.pmod("list", bins)), probing, group=["bin"], dims=index.dims, mask=_probing, question_bytes=question_bytes
        )
    finally:
        probes.unpersist()


def _probing(rows: pd.DataFrame, asked: pd.DataFrame):
    """Which rows of a bin lie in lists that a question probes."""
    held, probed_lists = rows["list"].to_numpy(), asked["lists"].to_numpy()
    return np.ones(len(asked), bool), lambda q, places: np.isin(held[places], probed_lists[q])


def _scanned(rows: DataFrame, questions: DataFrame, probes: DataFrame, n: int) -> DataFrame:
    spark = rows.sparkSession
    id_type = rows.schema["id"].dataType.simpleString()
    q_type = questions.schema["question_id"].dataType.simpleString()
    asked = questions.toPandas()
    number = {q: i for i, q in enumerate(asked["question_id"])}
    by_list = {k: np.array([number[q] for q in part], np.int64) for k, part in probes.toPandas().groupby("list")["question_id"]}
    shared = spark.sparkContext.broadcast((asked["question_id"].to_numpy(), unit(asked["vector"]) if len(asked) else np.zeros((0, 1)), by_list))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, vectors, asking = shared.value
        limits = np.full(len(names), np.inf)  # what farther rows of this task need not beat
        for batch in batches:
            found = []
            for key, part in batch.groupby("list"):
                who = asking.get(key)
                if who is not None:
                    found.append(pick_nearest(part["id"].to_numpy(), unit(part["embedding"]), who, vectors[who], n, limits))
            who, ids, distance = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), batch["id"].to_numpy()[:0], np.zeros(0))
            yield pd.DataFrame({"question_id": names[who], "id": ids, "distance": distance})

    local = rows.mapInPandas(scan, f"question_id {q_type}, id {id_type}, distance double")
    return keep_top(local, ["question_id"], [F.round("distance", PLACES), F.col("id")], n, "rank")
