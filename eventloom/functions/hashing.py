"""Content hash: SHA-256 over the digests of chunks of n items, each item behind its little-endian length."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _prefixed(item: Column) -> Column:
    n = F.lpad(F.hex(F.octet_length(item).cast("long")), 8, "0")
    little = F.concat(*[F.substring(n, i, 2) for i in (7, 5, 3, 1)])
    return F.concat(little, F.hex(item))


def chunk_digests(items: DataFrame, n: int = 128) -> DataFrame:
    """(chunk, digest) of (position, item): one group of at most n items each."""
    if n < 1:
        raise ValueError("a chunk has one item at least")
    listed = F.array_sort(F.collect_list(F.struct("position", _prefixed(F.col("item")).alias("hx"))))
    return items.groupBy(F.expr(f"position DIV {int(n)}").alias("chunk")).agg(
        F.sha2(F.unhex(F.array_join(F.transform(listed, lambda s: s["hx"]), "")), 256).alias("digest"))


def content_hash(items: DataFrame, n: int = 128) -> DataFrame:
    """One row: ``hash``, lower-case hex. Without items it is the hash of nothing.

    The digests (64 characters for n items) meet in one row; ``content_hash_value`` streams them instead.
    """
    listed = F.array_sort(F.collect_list(F.struct("chunk", "digest")))
    return chunk_digests(items, n).agg(F.sha2(F.unhex(F.array_join(F.transform(listed, lambda s: s["digest"]), "")), 256).alias("hash"))


def content_hash_value(items: DataFrame, n: int = 128) -> str:
    """The same value, digests hashed on the driver as they arrive in order: memory of one partition."""
    h = hashlib.sha256()
    for row in chunk_digests(items, n).orderBy("chunk").select("digest").toLocalIterator():
        h.update(bytes.fromhex(row[0]))
    return h.hexdigest()
