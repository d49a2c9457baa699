"""Event streams: Kafka in production, a folder of JSON lines where there is no broker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.streaming.events import PREFIX, envelopes, topics

MESSAGE_SCHEMA = "topic string, partition int, offset long, key string, value string"


def read_events(
    spark: SparkSession, *, servers: str | None = None, folder: str | None = None, prefix: str = PREFIX,
    files_per_trigger: int | None = None, streaming: bool = True,
) -> DataFrame:
    """``topic, partition, offset, key, value`` of the three topics, earliest first, committed only."""
    reader = spark.readStream if streaming else spark.read
    if servers is not None:
        df = (
            reader.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("subscribe", ",".join(topics(prefix)))
            .option("startingOffsets", "earliest")
            .option("kafka.isolation.level", "read_committed")
            .load()
        )
        return df.select(
            "topic", "partition", "offset", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")
        )
    reader = reader.schema(MESSAGE_SCHEMA)
    if streaming and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder)


def write_events(events: DataFrame, *, servers: str | None = None, folder: str | None = None, checkpoint: str | None = None, prefix: str = PREFIX):
    """Publish events keyed by tenant. A streaming frame returns its query; a batch frame returns None."""
    messages = envelopes(events, prefix=prefix)
    if servers is not None:
        out = messages.select("topic", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "headers")
        if events.isStreaming:
            return (
                out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("includeHeaders", "true")
                .option("checkpointLocation", checkpoint).start()
            )
        return out.write.format("kafka").option("kafka.bootstrap.servers", servers).option("includeHeaders", "true").save()
    # A folder keeps one line per message; the partition stands for the tenant's Kafka partition.
    lines = messages.select(
        "topic", F.pmod(F.xxhash64("key"), F.lit(8)).cast("int").alias("partition"),
        F.monotonically_increasing_id().alias("offset"), "key", "value",
    )
    if events.isStreaming:
        return lines.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).start()
    return lines.write.mode("append").json(folder)
