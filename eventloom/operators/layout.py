"""Records of n items: sizes, frame-of-reference widths, offsets, compression."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def records(items: DataFrame, n: int = 128) -> DataFrame:
    """(rec, n_items, min_size, max_size, bytes) of (position, size)."""
    return items.groupBy(F.expr(f"position DIV {int(n)}").alias("rec")).agg(
        F.count(F.lit(1)).alias("n_items"), F.min("size").cast("long").alias("min_size"), F.max("size").cast("long").alias("max_size"), F.sum("size").cast("long").alias("bytes"))


def offsets(recs: DataFrame, per_group: int = 1 << 16) -> DataFrame:
    """``recs`` with the byte offset of each record: a prefix sum within groups of records, then over the groups."""
    g = recs.withColumn("_g", F.expr(f"rec DIV {int(per_group)}"))
    inner = Window.partitionBy("_g").orderBy("rec").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)  # one row for each 65,536 records
    base = g.groupBy("_g").agg(F.sum("bytes").alias("_b")).select("_g", F.coalesce(F.sum("_b").over(outer), F.lit(0)).alias("_base"))
    local = g.withColumn("_in", F.coalesce(F.sum("bytes").over(inner), F.lit(0)))
    return local.join(base, "_g").withColumn("offset", (F.col("_base") + F.col("_in")).cast("long")).drop("_g", "_in", "_base")


def for_width(recs: DataFrame) -> DataFrame:
    """(rec, width, packed_bytes): bits a size takes above the record's smallest, one at least, and the packed group."""
    w = F.greatest(F.lit(1), F.length(F.bin(F.col("max_size") - F.col("min_size"))))
    return recs.select("rec", w.cast("long").alias("width"), (F.ceil(w * F.col("n_items") / 8) + 5).cast("long").alias("packed_bytes"))


def totals(items: DataFrame) -> DataFrame:
    return items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes")).select(
        "n", "total_bytes", F.when(F.col("n") > 0, F.expr("total_bytes DIV n")).otherwise(F.lit(0)).cast("long").alias("avg_bytes"))


def compression(items: DataFrame, n: int = 128, level: int = 3) -> DataFrame:
    """(items_per_record, records, raw_bytes, compressed_bytes, ratio) of (position, item), one zstd frame a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        c = zstandard.ZstdCompressor(level=level, write_checksum=True)
        for batch in batches:
            raws = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(list(map(len, raws)), pa.int64()), pa.array([len(c.compress(r)) for r in raws], pa.int64())], names=["raw", "packed"])

    blobs = items.groupBy(F.expr(f"position DIV {int(n)}").alias("rec")).agg(F.array_sort(F.collect_list(F.struct("position", "item"))).alias("x"))
    joined = blobs.select(F.unhex(F.array_join(F.transform("x", lambda s: F.hex(s["item"])), "")).alias("raw"))
    got = joined.mapInArrow(run, "raw long, packed long").agg(F.count(F.lit(1)).alias("records"), F.sum("raw").alias("raw_bytes"), F.sum("packed").alias("compressed_bytes"))
    return got.select(F.lit(int(n)).alias("items_per_record"), "records", "raw_bytes", "compressed_bytes", (F.col("raw_bytes") / F.col("compressed_bytes")).alias("ratio"))


def scattered(total: int, count: int, seed: int = 0) -> list[int]:
    """Distinct positions, ascending."""
    return sorted(random.Random(seed).sample(range(total), min(count, total)))


def consecutive(total: int, count: int, seed: int = 0) -> list[int]:
    """One run at a random place."""
    count = min(count, total)
    start = random.Random(seed).randint(0, total - count)
    return list(range(start, start + count))


def mixed(total: int, runs: int, run_length: int, singles: int, seed: int = 0) -> list[int]:
    """Some runs and some single positions."""
    r, out = random.Random(seed), set()
    for _ in range(runs):
        start = r.randint(0, max(0, total - run_length))
        out.update(range(start, min(total, start + run_length)))
    out.update(r.sample(range(total), min(singles, total)))
    return sorted(out)


def positions_frame(spark: SparkSession, positions: list[int]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in positions], "position long")
