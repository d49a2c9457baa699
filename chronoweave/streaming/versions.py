"""Building versions and finding contradictions as claims arrive.

Each micro-batch runs the batch planner on its claims together with the stored head of every fact
it touches, so a fact with very many claims is split exactly as in the batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators.build import FACT, build_versions
from chronoweave.operators.contradictions import value_conflicts
from chronoweave.operators.ordered import HOT_ROWS
from chronoweave.operators.temporal import latest_versions
from chronoweave.session import cut_lineage
from chronoweave.streaming.keyed_log import BUCKETS, EVERY, KeyedLog

TABLES = ("versions", "closures", "rejects", "contradictions")


class VersionStore:
    """Append-only folders, one sub-folder per micro-batch; the heads as keyed state, read by the buckets a batch touches."""

    def __init__(self, root: str, *, buckets: int = BUCKETS, every: int = EVERY):
        self.root, self.buckets, self.every = root, buckets, every

    def exists(self, spark: SparkSession, name: str) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, spark: SparkSession, name: str) -> DataFrame | None:
        return spark.read.parquet(f"{self.root}/{name}") if self.exists(spark, name) else None

    def write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch_id={batch_id}")

    def heads(self) -> KeyedLog:
        """Latest version of each fact. The last version of a fact is never closed by its own batch, so its row is current."""
        return KeyedLog(f"{self.root}/heads", FACT, latest="version", buckets=self.buckets, every=self.every)


def apply_claims_batch(batch: DataFrame, batch_id: int, store: VersionStore, *, hot_rows: int = HOT_ROWS) -> None:
    spark = batch.sparkSession
    claims = cut_lineage(batch)
    log = store.heads()
    heads = log.find(spark, claims, batch_id)
    if heads is not None:
        heads = cut_lineage(heads)
    built = build_versions(claims, heads, hot_rows=hot_rows)
    versions = cut_lineage(built.versions)
    store.write(built.closures, "closures", batch_id)
    store.write(built.rejects, "rejects", batch_id)
    chain = versions
    if heads is not None:  # the stored head is the version before the first new one
        before = heads.join(versions.select(*FACT).distinct(), FACT, "left_semi")
        chain = versions.unionByName(before.select(*versions.columns))
    conflicts = value_conflicts(chain)
    store.write(conflicts, "contradictions", batch_id)
    log.append(latest_versions(versions), batch_id)
    store.write(versions, "versions", batch_id)


def stream_versions(claims: DataFrame, store: VersionStore, checkpoint: str, *, hot_rows: int = HOT_ROWS, **trigger):
    """Start the builder on a stream of claims; by default it works off what is available and stops."""
    return (
        claims.writeStream.foreachBatch(lambda b, i: apply_claims_batch(b, i, store, hot_rows=hot_rows))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
