"""Event to bytes and back as Column expressions: no Python on the executors.

Layout: version, type, flags (1 contract, 2 successful), topic count, contract (32), transaction hash (32), seconds
(8, big-endian), data length (4), then each topic as a 2-byte length and bytes, then the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.model import FORMAT_VERSION, HEADER_SIZE


def _be(value: Column, n_bytes: int) -> Column:
    """Big-endian hex of a non-negative or two's complement long."""
    return F.substring(F.lpad(F.hex(value.cast("long")), 16, "0"), 17 - 2 * n_bytes, 2 * n_bytes)


def _fixed(value: Column, size: int) -> Column:
    """Exactly ``size`` bytes: cut, or filled with zeros; null is all zeros."""
    return F.rpad(F.coalesce(F.hex(F.substring(value, 1, size)), F.lit("")), 2 * size, "0")


def encode_event(contract_id: str = "contract_id", topics: str = "topics", tx_hash: str = "tx_hash", event_type: str = "event_type", data: str = "data_bytes", closed_at: str = "ledger_closed_at", successful: str = "successful") -> Column:
    """The encoded event. Over 255 topics or a topic over 65,535 bytes is an error instead of silent corruption."""
    c = F.col
    has = F.coalesce(F.octet_length(contract_id) >= 32, F.lit(False))
    flags = has.cast("int") + 2 * c(successful).cast("int")
    body = F.array_join(F.transform(topics, lambda t: F.concat(_be(F.octet_length(t), 2), F.hex(t))), "")
    head = F.concat(
        F.lit(f"{FORMAT_VERSION:02X}"), _be(F.pmod(c(event_type).cast("long"), F.lit(256)), 1), _be(flags, 1), _be(F.size(topics), 1),
        F.when(has, _fixed(c(contract_id), 32)).otherwise(F.lit("0" * 64)), _fixed(c(tx_hash), 32), _be(F.unix_seconds(closed_at), 8), _be(F.octet_length(data), 4))
    too_many = F.size(topics) > 255
    too_long = F.exists(topics, lambda t: F.octet_length(t) > 65535)
    good = F.unhex(F.concat(head, body, F.hex(data)))
    return F.when(too_many, F.raise_error(F.lit("event: more than 255 topics")).cast("binary")).when(too_long, F.raise_error(F.lit("event: topic longer than 65535 bytes")).cast("binary")).otherwise(good)


def _num(item: Column, at: Column | int, n: int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(item, at, F.lit(n))), 16, 10).cast("decimal(20,0)").cast("long")


def walk_topics(item: Column) -> Column:
    """struct<off, topics, bad>: the topics, the 1-based offset behind them, the first topic that does not fit (or -1)."""
    size = F.octet_length(item)
    n = _num(item, 4, 1).cast("int")
    start = F.struct(F.lit(HEADER_SIZE + 1).alias("off"), F.array().cast("array<binary>").alias("topics"), F.lit(-1).alias("bad"))

    def step(acc: Column, i: Column) -> Column:
        length = _num(item, acc["off"], 2).cast("int")
        fits = (acc["off"] + 1 <= size) & (acc["off"] + 1 + length <= size)
        good = F.struct((acc["off"] + 2 + length).alias("off"), F.concat(acc["topics"], F.array(F.substring(item, acc["off"] + 2, length))).alias("topics"), acc["bad"].alias("bad"))
        bad = F.struct(acc["off"].alias("off"), acc["topics"].alias("topics"), i.alias("bad"))
        return F.when(acc["bad"] >= 0, acc).when(F.coalesce(fits, F.lit(False)), good).otherwise(bad)

    return F.aggregate(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), start, step)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _error(item: Column, walked: Column) -> Column:
    return (
        F.when(item.isNull() | (F.octet_length(item) < HEADER_SIZE), F.lit("too short"))
        .when(_num(item, 1, 1) != FORMAT_VERSION, F.lit("unsupported version"))
        .when(walked["bad"] >= 0, F.concat(F.lit("truncated topic "), walked["bad"].cast("string")))
        .when(walked["off"] - 1 + _num(item, 77, 4) > F.octet_length(item), F.lit("truncated data"))
    )


def decode_error(item: Column) -> Column:
    """What is wrong with an encoded event, or null."""
    return _let(walk_topics(item), lambda walked: _error(item, walked))


def decode_event(item: str | Column, mode: str = "FAILFAST") -> Column:
    """A struct of the stored columns. FAILFAST raises on a malformed item; PERMISSIVE gives nulls and fills ``error``."""
    item = F.col(item) if isinstance(item, str) else item
    kind = "struct<contract_id:binary,topics:array<binary>,tx_hash:binary,event_type:int,data_bytes:binary,ledger_closed_at:timestamp,successful:boolean,error:string>"

    def event(walked: Column) -> Column:
        flags = _num(item, 3, 1).cast("int")
        return F.struct(
            F.when(flags.bitwiseAND(1) == 1, F.substring(item, 5, 32)).alias("contract_id"), walked["topics"].alias("topics"),
            F.substring(item, 37, 32).alias("tx_hash"), _num(item, 2, 1).cast("int").alias("event_type"),
            F.substring(item, walked["off"], _num(item, 77, 4).cast("int")).alias("data_bytes"),
            F.timestamp_seconds(_signed(item)).alias("ledger_closed_at"), (flags.bitwiseAND(2) == 2).alias("successful"), F.lit(None).cast("string").alias("error")).cast(kind)

    def whole(w: Column) -> Column:
        if mode == "FAILFAST":
            return F.when(w["error"].isNotNull(), F.raise_error(F.concat(F.lit("event: "), w["error"])).cast(kind)).otherwise(event(w["walked"]))
        nothing = F.from_json(F.lit("{}"), kind)
        return F.when(w["error"].isNull(), event(w["walked"])).otherwise(nothing.withField("error", w["error"]))

    return _let(walk_topics(item), lambda walked: _let(F.struct(walked.alias("walked"), _error(item, walked).alias("error")), whole))


def _signed(item: Column) -> Column:
    high, low = _num(item, 69, 4), _num(item, 73, 4)
    return F.when(high >= 1 << 31, high - (1 << 32)).otherwise(high) * F.lit(1 << 32) + low
