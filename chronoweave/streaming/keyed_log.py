"""Keyed state of a stream in folders: deltas a micro-batch, compacted into a base, read by the buckets that a batch touches.

A key's rows lie in the bucket of its hash, a folder of its own. Each micro-batch writes its delta; after ``every`` deltas the base
and they become a new base with one row a key. So a batch reads, of the buckets its keys fall into, one base and at most
``every`` deltas more, however long the stream has run: the cost follows the number of keys, not the history.

Replays. A batch that runs again must not see itself or what came of it: it reads the last base before itself and the deltas in
between. A new base is complete before it is used (its writer's success mark), and what it replaces is only deleted by the next
compaction, so the base before it is still there for the batch that made it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVERY, BUCKETS = 8, 64


class KeyedLog:
    """State under ``root``. ``key``: its key columns; ``latest``: the column whose largest value is a key's current row (None:
    rows are their keys). ``buckets`` must stay what it was first."""

    def __init__(self, root: str, key: list[str], *, latest: str | None = None, buckets: int = BUCKETS, every: int = EVERY):
        self.root, self.key, self.latest, self.buckets, self.every = root.rstrip("/"), key, latest, buckets, every

    def _fs(self, spark: SparkSession, path: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()), p

    def _numbers(self, spark: SparkSession, kind: str) -> list[int]:
        """Batches with a complete folder of this kind."""
        fs, path = self._fs(spark, f"{self.root}/{kind}")
        if not fs.exists(path):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n) for n in found if n.isdigit() and fs.exists(self._fs(spark, f"{self.root}/{kind}/{n}/_SUCCESS")[1]))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def folders(self, spark: SparkSession, batch_id: int) -> list[str]:
        """What holds the state before ``batch_id``: the last base, and the deltas since."""
        bases = [n for n in self._numbers(spark, "base") if n < batch_id]
        since = bases[-1] if bases else -1
        deltas = [n for n in self._numbers(spark, "delta") if since < n < batch_id]
        return [f"{self.root}/base/{n}" for n in bases[-1:]] + [f"{self.root}/delta/{n}" for n in deltas]

    def _current(self, rows: DataFrame) -> DataFrame:
        if self.latest is None:
            return rows.dropDuplicates(self.key)
        rest = [c for c in rows.columns if c not in (*self.key, self.latest, "bucket")]
        return rows.groupBy(*self.key).agg(F.max(F.struct(self.latest, *rest)).alias("__r")).select(*self.key, "__r.*")

    def _rows(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        parts = [spark.read.parquet(f) for f in self.folders(spark, batch_id) if self._filled(spark, f)]
        return reduce(lambda a, b: a.unionByName(b), parts) if parts else None

    def _filled(self, spark: SparkSession, folder: str) -> bool:
        fs, path = self._fs(spark, folder)
        return any(s.isDirectory() for s in fs.listStatus(path))

    def touched(self, spark: SparkSession, keys: DataFrame, batch_id: int) -> DataFrame | None:
        """The stored rows, by bucket, that may belong to ``keys``; None when nothing is stored. At most ``buckets`` numbers reach the
        driver."""
        rows = self._rows(spark, batch_id)
        if rows is None:
            return None
        numbers = [r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect()]
        return rows.where(F.col("bucket").isin(numbers))

    def find(self, spark: SparkSession, keys: DataFrame, batch_id: int) -> DataFrame | None:
        """The current row of each of ``keys`` before ``batch_id``; None when nothing is stored."""
        rows = self.touched(spark, keys, batch_id)
        return None if rows is None else self._current(rows.drop("bucket").join(keys.select(*self.key).distinct(), self.key, "left_semi"))

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Write the delta of a batch (again, if it is replayed), and compact when enough have gathered."""
        spark = rows.sparkSession
        self._delete(spark, "base", [n for n in self._numbers(spark, "base") if n >= batch_id])  # made from what is replaced now
        self._write(rows, f"{self.root}/delta/{batch_id}")
        bases = [n for n in self._numbers(spark, "base") if n < batch_id]
        deltas = [n for n in self._numbers(spark, "delta") if n > (bases[-1] if bases else -1)]
        if len(deltas) >= self.every:
            self._compact(spark, batch_id)

    def _write(self, rows: DataFrame, folder: str) -> None:
        out = rows.drop("bucket").withColumn("bucket", self.bucket())
        # the whole folder is replaced, not only the buckets that have rows
        out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(folder)

    def _compact(self, spark: SparkSession, batch_id: int) -> None:
        rows = self._rows(spark, batch_id + 1)
        if rows is None:
            return
        before = [n for n in self._numbers(spark, "base") if n < batch_id]
        self._write(self._current(rows.drop("bucket")), f"{self.root}/base/{batch_id}")
        # the base before this one and the deltas since stay, for a replay of this batch; what is older has been replaced
        self._delete(spark, "base", before[:-1])
        self._delete(spark, "delta", [n for n in self._numbers(spark, "delta") if before and n <= before[-1]])

    def _delete(self, spark: SparkSession, kind: str, numbers: list[int]) -> None:
        for n in numbers:
            fs, path = self._fs(spark, f"{self.root}/{kind}/{n}")
            fs.delete(path, True)
