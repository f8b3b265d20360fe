"""CRC32C (Castagnoli); Spark's crc32 has another polynomial."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_POLY = 0x82F63B78


def _tables() -> np.ndarray:
    t = np.zeros((8, 256), dtype=np.uint32)
    for i in range(256):
        c = i
        for _ in range(8):
            c = c >> 1 ^ (_POLY if c & 1 else 0)
        t[0, i] = c
    for k in range(1, 8):
        t[k] = t[k - 1] >> np.uint32(8) ^ t[0][t[k - 1] & 255]
    return t


_T = _tables()
_LISTS = [row.tolist() for row in _T]


def crc32c(data: bytes, start: int = 0) -> int:
    """Eight bytes a step."""
    t0, t1, t2, t3, t4, t5, t6, t7 = _LISTS
    c, n = start ^ 0xFFFFFFFF, len(data) & ~7
    for w in np.frombuffer(data, dtype="<u8", count=n // 8).tolist():
        w ^= c
        c = t7[w & 255] ^ t6[w >> 8 & 255] ^ t5[w >> 16 & 255] ^ t4[w >> 24 & 255] ^ t3[w >> 32 & 255] ^ t2[w >> 40 & 255] ^ t1[w >> 48 & 255] ^ t0[w >> 56]
    for b in data[n:]:
        c = c >> 8 ^ t0[(c ^ b) & 255]
    return c ^ 0xFFFFFFFF


def crc32c_many(items: list[bytes], long: int = 4096) -> np.ndarray:
    """The checksums of many items, a byte of all of them a step; items over ``long`` bytes one by one."""
    size = np.fromiter(map(len, items), dtype=np.int64, count=len(items))
    out = np.zeros(len(items), dtype=np.int64)
    for i in np.flatnonzero(size > long).tolist():
        out[i] = crc32c(items[i])
    few = np.flatnonzero(size <= long)
    few = few[np.argsort(-size[few], kind="stable")]  # longest first: those with a byte at a place are the first ones
    n = size[few]
    flat = np.frombuffer(b"".join([items[i] for i in few.tolist()]), dtype=np.uint8)
    begin, c = np.cumsum(n) - n, np.full(len(few), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(int(n[0]) if len(n) else 0):
        m = int(np.searchsorted(-n, -at, side="left"))  # items longer than ``at``
        c[:m] = _T[0][(c[:m] ^ flat[begin[:m] + at]) & 255] ^ (c[:m] >> np.uint32(8))
    out[few] = (c ^ np.uint32(0xFFFFFFFF)).astype(np.int64)
    return out


def crc32c_of(column: str) -> Column:
    """The checksum of a binary column, by Arrow batches."""

    @F.pandas_udf("long")
    def of(items: pd.Series) -> pd.Series:
        there = items.notna()
        out = pd.Series(index=items.index, dtype="Int64")
        out[there] = crc32c_many([bytes(x) for x in items[there]])
        return out

    return of(column)
