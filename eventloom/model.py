"""Index fields, errors, and the schema of nested ledgers."""

from __future__ import annotations

from enum import IntEnum

TX_LEVEL = 65535
FORMAT_VERSION = 2
HEADER_SIZE = 80
INDEXED_TOPICS = 4


class Field(IntEnum):
    """What an index key is taken from."""

    CONTRACT = 1
    TOPIC0 = 2
    TOPIC1 = 3
    TOPIC2 = 4
    TOPIC3 = 5


class EventType(IntEnum):
    SYSTEM = 0
    CONTRACT = 1
    DIAGNOSTIC = 2


class PositionOutOfRange(ValueError):
    pass


class KeyNotFound(KeyError):
    pass


class Corrupt(ValueError):
    pass


class ChecksumMismatch(Corrupt):
    pass


class HashMismatch(Corrupt):
    pass


class EmptyIndex(ValueError):
    pass


#: Nested input of ``flatten_events``: one row per ledger.
_RAW = "struct<contract_id:binary,type:tinyint,body_version:int,topics:array<binary>,data:binary>"
LEDGER_DDL = (
    "ledger_sequence bigint, closed_at timestamp, transactions array<struct<tx_index:bigint,hash:binary,successful:boolean,"
    f"events:array<{_RAW}>,operations:array<struct<events:array<{_RAW}>>>>>"
)
