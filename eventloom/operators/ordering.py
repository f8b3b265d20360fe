"""Order of events and dense global positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.model import TX_LEVEL
from eventloom.scratch import cut


def order_key(ledger: str = "ledger_sequence", tx: str = "transaction_index", op: str = "operation_index", event: str = "event_index") -> list[Column]:
    """Transaction-level events (operation 65535) come before those of operations."""
    return [F.col(ledger), F.col(tx), F.when(F.col(op) == TX_LEVEL, F.lit(-1)).otherwise(F.col(op)), F.col(event)]


def assign_positions(df: DataFrame, key: list[Column], partitions: int | None = None) -> DataFrame:
    """``df`` with ``position``, dense from 0 in the order of ``key``; no task sees all rows.

    Rows are dealt out by ranges of the key, sorted within each, numbered there, and written once, since a second
    evaluation may draw other ranges. The counts of the ranges, one row each, then give every range its offset.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_k{i}" for i in range(len(key))]
    keyed = df.select("*", *[k.alias(x) for k, x in zip(key, names, strict=True)])
    pid = F.spark_partition_id()
    dealt = keyed.repartitionByRange(n, *names).sortWithinPartitions(*names)
    local = dealt.withColumns({"_pid": pid, "_local": F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)}).drop(*names)
    kept = cut(local, "positions")
    sizes = kept.groupBy("_pid").agg((F.max("_local") + 1).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    return kept.join(F.broadcast(offsets), "_pid").withColumn("position", F.col("_from") + F.col("_local")).drop("_pid", "_local", "_from")
