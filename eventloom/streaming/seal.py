"""Streams of events: every micro-batch seals one immutable chunk of the store; positions go on from the last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventloom.operators.ordering import assign_positions
from eventloom.operators.sealed import folders


def sealed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


def seal_batch(batch: DataFrame, batch_id: int, path: str, key: list[Column]) -> None:
    """Write batch ``batch_id`` to a folder of its own, so a repeated batch replaces itself.

    A chunk's positions begin after those of lower ids.
    """
    spark = batch.sparkSession
    first = 0
    below = [n for n in folders(spark, path, "batch=") if n < f"batch={batch_id:012d}"]
    if below:  # the last one's statistics hold its last position
        first = spark.read.parquet(f"{path}/{below[-1]}").agg(F.max("position")).first()[0] + 1
    out = assign_positions(batch, key).withColumn("position", F.col("position") + first)
    out.sortWithinPartitions("position").write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")


def seal_stream(events: DataFrame, path: str, checkpoint: str, key: list[Column], **trigger) -> StreamingQuery:
    writer = events.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return writer.foreachBatch(lambda df, i: seal_batch(df, i, path, key) if not df.isEmpty() else None).start()


def in_time(events: DataFrame, start: str, end: str, column: str = "ledger_closed_at") -> DataFrame:
    """Events whose time is in [start, end)."""
    return events.where((F.col(column) >= F.lit(start).cast("timestamp")) & (F.col(column) < F.lit(end).cast("timestamp")))


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes", column: str = "ledger_closed_at") -> DataFrame:
    """Events by time window and type, with a watermark for late ones; a batch has no watermark."""
    e = events.withWatermark(column, delay) if events.isStreaming else events
    return e.groupBy(F.window(column, width), "event_type").agg(F.count(F.lit(1)).alias("n"))
