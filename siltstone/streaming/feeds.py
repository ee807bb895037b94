"""Structured Streaming over the change log: the feed, forward-only heads, delivery with retries.

Delivery is at least once, and every sink is keyed by (record, revision), so duplicates and reordering do no
harm.  A watermark here is a feed position, never an event time: late events get later positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASE_S, MAX_S, DEAD_AFTER = 5, 3600, 8


def feed_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    """The log as a stream of its files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def heads(log: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's latest (generation, revision), as a streaming or batch aggregation."""
    rank = F.struct("generation", "revision")
    return log.groupBy(*keys).agg(F.max(rank).alias("head")).select(*keys, "head.generation", "head.revision")


def superseded(log: DataFrame, keys: list[str]) -> DataFrame:
    """The log's rows with whether a later revision of the key is there."""
    last = F.max("revision").over(Window.partitionBy(*keys))
    return log.withColumn("superseded", F.col("revision") < last)


def backoff(failures: Column) -> Column:
    """Seconds to the next try after so many failures."""
    return F.least(F.lit(BASE_S) * F.pow(F.lit(2), F.greatest(failures - 1, F.lit(0))), F.lit(MAX_S)).cast("long")


def delivery_state(failures: Column, delivered: Column) -> Column:
    return F.when(delivered, "delivered").when(failures >= DEAD_AFTER, "dead-letter").when(failures > 0, "degraded").otherwise("pending")


def status(outbox: DataFrame, head: int) -> DataFrame:
    """By delivery state (from failures, delivered) how many there are, the oldest `ts`, and the greatest lag behind the log's head."""
    rows = outbox.withColumn("state", delivery_state(F.col("failures"), F.col("delivered")))
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("oldest"), F.max(F.lit(head) - F.col("position")).alias("lag"))


def repaired(outbox: DataFrame, keys: list[str], retry: DataFrame, cancel: DataFrame) -> DataFrame:
    """The outbox after an operator's retries, which start from no failures, and cancellations; what is delivered stays so."""
    rows = outbox.join(retry.select(*keys).distinct().withColumn("_again", F.lit(True)), keys, "left").join(cancel.select(*keys).distinct().withColumn("_off", F.lit(True)), keys, "left")
    failures = F.when(F.col("_again") & ~F.col("delivered"), 0).otherwise(F.col("failures"))
    state = F.when(F.col("_off") & ~F.col("delivered"), "cancelled").otherwise(delivery_state(failures, F.col("delivered")))
    return rows.withColumn("state", state).withColumn("failures", failures).drop("_again", "_off")


def projected(stream: DataFrame, folder: str, checkpoint: str, keys: list[str], trigger: dict | None = None):
    """Start writing each micro-batch's newest row per key to <folder>/batch=N; a batch run again overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("revision")))).filter("_r = 1").drop("_r")
        newest.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The newest row of each key over all batches written."""
    rows = spark.read.parquet(folder)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "revision").alias("x")).select(*keys, "x.*")
