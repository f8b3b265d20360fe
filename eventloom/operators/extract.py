"""Ledgers with nested transactions to flat events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.model import TX_LEVEL, EventType


def flatten_events(ledgers: DataFrame) -> DataFrame:
    """RAW_EVENT rows of rows of ``LEDGER_DDL``.

    Diagnostics are dropped but keep their index, so indexes have gaps. A body version other than 0 has no topics and
    no data. Events of failed transactions stay.
    """
    tx = ledgers.select("ledger_sequence", "closed_at", F.explode("transactions").alias("tx"))

    def tag(e: Column, op: Column, i: Column) -> Column:
        return F.struct(e.alias("e"), op.cast("int").alias("op"), i.cast("int").alias("i"))

    top = F.transform(F.coalesce("tx.events", F.array()), lambda e, i: tag(e, F.lit(TX_LEVEL), i))
    ops = F.flatten(F.transform(F.coalesce("tx.operations", F.array()), lambda o, k: F.transform(F.coalesce(o["events"], F.array()), lambda e, i: tag(e, k, i))))
    flat = tx.select("ledger_sequence", "closed_at", "tx", F.explode(F.concat(top, ops)).alias("x"))
    v0 = F.coalesce(F.col("x.e.body_version"), F.lit(0)) == 0
    return flat.where(F.col("x.e.type") != int(EventType.DIAGNOSTIC)).select(
        F.col("x.e.contract_id").alias("contract_id"),
        F.when(v0, F.coalesce("x.e.topics", F.array().cast("array<binary>"))).otherwise(F.array().cast("array<binary>")).alias("topics"),
        F.coalesce("tx.hash", F.unhex(F.lit("00" * 32))).alias("tx_hash"), F.col("x.e.type").alias("event_type"),
        F.when(v0, F.coalesce("x.e.data", F.unhex(F.lit("")))).otherwise(F.unhex(F.lit(""))).alias("data_bytes"),
        F.col("closed_at").alias("ledger_closed_at"), F.col("tx.successful").alias("successful"), "ledger_sequence",
        F.col("tx.tx_index").alias("transaction_index"), F.col("x.op").alias("operation_index"), F.col("x.i").alias("event_index"))
