"""Helpers shared by the corpus operators: tables in the shared folder, Arrow batches, runs of equal keys, components.

A *document key* is ``(doc_id, text_hash)``: rows that agree in both are repetitions of one document. Every operator reads
only the columns it names, so other columns, whatever their names, cannot clash with its own.
"""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.session import checkpoint_root, prepare

#: Rows of one Arrow batch, and its bytes: what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Settings of the library, and batches small enough for very long texts."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: a cut in the lineage that survives lost executors
    and still prunes columns."""
    path = scratch(df.sparkSession, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`stored` has written and nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished phases now, not whenever the driver next collects its garbage."""
    for _ in range(2):  # what the first round frees may hold what the second can
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def texts_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, and nothing else, whatever other columns are called."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def texts_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable], schema: str) -> DataFrame:
    """``work`` on each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return df.mapInArrow(run, schema)


def whole_runs(batches: Iterable[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Batches sorted by ``key``, cut anew so that no run of equal keys is divided. Runs have a bounded length (see
    :func:`block_pairs`); so has what is held here."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        first, last = batch.slice(0, 1), batch.slice(batch.num_rows - 1)
        same = all(first.column(k)[0].equals(last.column(k)[0]) for k in key)
        if same:
            continue
        cut = batch.num_rows - 1
        columns = [batch.column(k) for k in key]
        ends = [last.column(k)[0] for k in key]
        low, high = 0, cut  # the first row of the last run
        while low < high:
            mid = (low + high) // 2
            if all(c[mid].equals(e) for c, e in zip(columns, ends, strict=True)):
                high = mid
            else:
                low = mid + 1
        held[-1] = batch.slice(0, low)
        yield pa.Table.from_batches(held)
        held = [batch.slice(low)]
    if held:
        yield pa.Table.from_batches(held)


def run_starts(table: pa.Table, key: list[str]) -> np.ndarray:
    """Offsets of the runs of equal keys, and the number of rows at the end. Key columns are integers without nulls."""
    n = table.num_rows
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
        for k in key:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), n)


def block_pairs(members: DataFrame, key: str, block: int) -> DataFrame:
    """Members of every bucket with two or more, dealt to groups of at most about ``2 * block`` rows so that any two
    members of a bucket meet in a group.

    A bucket of up to ``block`` members is one group. A larger one is cut into blocks by the hash of ``id``, and each pair
    of blocks is a group. Input: ``key`` (long), ``id`` (long) and whatever else a pair is judged by; output: the same
    columns, ``left`` and ``right`` (the blocks).
    """
    sizes = members.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    cut = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(17)), F.col("_b").cast("long")).cast("int")
    return (
        members.join(sizes, key)
        .withColumn("_b", cut)
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
        .withColumn("left", F.least("_own", "_other"))
        .withColumn("right", F.greatest("_own", "_other"))
        .drop("_n", "_b", "_own", "_other")
    )


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``links`` (``a``, ``b``: long), as rows ``node``, ``root``: the smallest node reachable.

    Alternating large-star and small-star steps: each node hands its larger neighbours to its smallest one, until every
    edge leads to a root. Minima are pre-aggregated and joins are split by AQE where a node has very many neighbours.
    Every round is written to the shared folder; only two numbers a round reach the driver.
    """
    spark = links.sparkSession

    def step(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))
        if large:  # neighbours above the node move to its minimum
            out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:  # edges lead down: neighbours below the node, and the node itself, move to its minimum
            out = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    def mark(edges: DataFrame):
        return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = mark(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        last, edges = edges, stored(step(step(edges, True), False), "stars")
        discard(last)
        after = mark(edges)
        if tuple(after) == tuple(before):
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


class Forest:
    """Union-find over the positions of one bounded group, so that a group emits a spanning forest and not all its pairs."""

    def __init__(self, n: int):
        self.of = list(range(n))

    def root(self, x: int) -> int:
        of = self.of
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.of[max(x, y)] = min(x, y)
        return True


class Memo(dict):
    """A dictionary that works out what is missing: bounded memory, the same answers.

    When full it starts anew and keeps the full one beside it, so what is often asked for is not worked out again. Strings
    longer than ``longest`` are never kept.
    """

    def __init__(self, make: Callable, most: int = 200_000, longest: int | None = None):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        if self.longest is not None and len(key) > self.longest:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
