"""The inverted index: (field, key) to the set of positions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import roaring
from eventloom.functions.hashing import content_hash_value
from eventloom.model import INDEXED_TOPICS, EmptyIndex, Field, HashMismatch, KeyNotFound
from eventloom.operators import sealed
from eventloom.operators.ordering import assign_positions

#: Positions in one row of the index; a frequent key has as many rows as it needs.
CHUNK = 1 << 16
BITMAP_BITS = 32768


def postings(events: DataFrame, contract: str = "contract_id", topics: str = "topics") -> DataFrame:
    """(field, key, position) of the contract, if any, and the first four topics; an empty topic is a key too."""
    own = F.struct(F.lit(int(Field.CONTRACT)).alias("field"), F.col(contract).alias("key"))
    of_topics = F.transform(F.slice(topics, 1, INDEXED_TOPICS), lambda t, i: F.struct((i + int(Field.TOPIC0)).cast("int").alias("field"), t.alias("key")))
    every = F.filter(F.concat(F.array(own), of_topics), lambda s: s["key"].isNotNull())
    return events.select("position", F.explode(every).alias("p")).select("p.field", "p.key", "position")


def build(posted: DataFrame) -> DataFrame:
    """(field, key, chunk, cardinality, positions): sorted, distinct, at most CHUNK positions a row, so no key outgrows a task."""
    chunk = F.expr(f"position DIV {CHUNK}").alias("chunk")
    got = posted.groupBy("field", "key", chunk).agg(F.array_sort(F.collect_set("position")).alias("positions"))
    return got.select("field", "key", "chunk", F.size("positions").cast("long").alias("cardinality"), "positions")


def entries(posted: DataFrame) -> DataFrame:
    """(field, key, cardinality, min_position, max_position, sum_position) without any list."""
    return posted.distinct().groupBy("field", "key").agg(
        F.count(F.lit(1)).alias("cardinality"), F.min("position").alias("min_position"), F.max("position").alias("max_position"), F.sum("position").alias("sum_position"))


class BitmapIndex:
    """An index on disk, partitioned by field and sorted by key; versions as those of a store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._at: str | None = None

    @classmethod
    def write(cls, posted: DataFrame, path: str, mode: str = "errorifexists") -> BitmapIndex:
        """An index without a key is an error. Its content hash is stored with it."""
        spark = posted.sparkSession
        if posted.isEmpty():
            raise EmptyIndex("no key to index")
        at = sealed.fresh(spark, path, mode)
        if at is None:
            return cls(spark, path)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        (build(posted).repartitionByRange(n, "field", "key", "chunk").sortWithinPartitions("field", "key", "chunk")
         .write.partitionBy("field").option("compression", "zstd").parquet(f"{at}/entries"))
        own = cls(spark, path)
        own._at = at
        sealed.commit(spark, at, {"version": 1, "rows": own.table().count(), "content_hash": own.content_hash()})
        return own

    @property
    def at(self) -> str:
        if self._at is None:
            self._at = sealed.current(self.spark, self.path)
            if self._at is None:
                raise FileNotFoundError(f"no index at {self.path}")
        return self._at

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/entries")

    def stored_hash(self) -> str:
        return sealed.meta(self.spark, self.at)["content_hash"]

    def verify(self) -> bool:
        """Whether the entries are those that were written; HashMismatch if not."""
        if (got := self.content_hash()) != (stored := self.stored_hash()):
            raise HashMismatch(f"{got} is not {stored}")
        return True

    def serialised(self) -> DataFrame:
        """(field, key, chunk, payload): each row's positions as a portable roaring bitmap, relative to its chunk's first."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                chunk = batch.column(2).to_numpy()
                payload = [roaring.serialize(p.values.to_numpy() - c * CHUNK) for p, c in zip(batch.column(3), chunk, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(payload, pa.binary())], names=["field", "key", "chunk", "payload"])

        kind = self.table().schema["key"].dataType.simpleString()
        return self.table().select(F.col("field").cast("int"), "key", "chunk", "positions").mapInArrow(run, f"field int, key {kind}, chunk long, payload binary")

    @staticmethod
    def deserialised(payloads: DataFrame) -> DataFrame:
        """(field, key, chunk, positions) from ``serialised``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                back = [roaring.deserialize(p.as_py()).astype("int64") + c * CHUNK for p, c in zip(batch.column(3), batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(back, pa.list_(pa.int64()))], names=["field", "key", "chunk", "positions"])

        kind = payloads.schema["key"].dataType.simpleString()
        return payloads.select("field", "key", "chunk", "payload").mapInArrow(run, f"field int, key {kind}, chunk long, positions array<long>")

    def rows(self, field: int, key) -> DataFrame:
        return self.table().where((F.col("field") == int(field)) & (F.col("key") == F.lit(key)))

    def lookup(self, field: int, key, strict: bool = True) -> DataFrame:
        """(position) of one key, ascending; an absent key is KeyNotFound unless ``strict`` is off."""
        got = self.rows(field, key)
        if strict and got.isEmpty():
            raise KeyNotFound((int(field), key))
        return got.select(F.explode("positions").alias("position")).orderBy("position")

    def lookup_keys(self, keys: DataFrame | Sequence[tuple[int, object]]) -> DataFrame:
        """(ord, field, key, chunk, positions): input order, duplicates each answered, null positions where absent."""
        return lookup_keys(self.table(), keys_frame(self.spark, keys, self.table()))

    def statistics(self) -> DataFrame:
        return self.table().groupBy("field").agg(F.count_distinct("key").alias("distinct_keys"), F.sum("cardinality").alias("postings"))

    def content_hash(self, n: int = 128) -> str:
        """Hash over the entries as they are now, in the order of (field, key, chunk)."""
        item = F.concat(F.unhex(F.lpad(F.hex("field"), 2, "0")), F.encode(F.hex("key"), "utf-8"), F.encode(F.array_join("positions", ","), "utf-8"))
        t = assign_positions(self.table().select("field", "key", "chunk", item.alias("item")), [F.col("field"), F.col("key"), F.col("chunk")])
        return content_hash_value(t.select("position", "item"), n)


def keys_frame(spark: SparkSession, keys: DataFrame | Sequence[tuple[int, object]], like: DataFrame) -> DataFrame:
    if isinstance(keys, DataFrame):
        return keys
    kind = like.schema["key"].dataType.simpleString()
    return spark.createDataFrame([(i, int(f), k) for i, (f, k) in enumerate(keys)], f"ord int, field int, key {kind}")


def lookup_keys(index: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(index, ["field", "key"], "left").orderBy("ord", "chunk")


def key_cardinalities(posted: DataFrame, keys: DataFrame) -> DataFrame:
    """(ord, field, key, cardinality), 0 for an absent key."""
    found = posted.join(keys.select("field", "key").distinct(), ["field", "key"], "left_semi").groupBy("field", "key").agg(F.count_distinct("position").alias("cardinality"))
    return keys.join(found, ["field", "key"], "left").select("ord", "field", "key", F.coalesce("cardinality", F.lit(0)).cast("long").alias("cardinality"))


def fetch(posted: DataFrame, field: int, key, events: DataFrame) -> DataFrame:
    """The events at a key's positions."""
    hit = posted.where((F.col("field") == int(field)) & (F.col("key") == F.lit(key))).select("position").distinct()
    return events.join(hit, "position", "left_semi").orderBy("position")


def _any_of(keys: Sequence[tuple[int, object]]):
    return reduce(lambda a, b: a | b, [(F.col("field") == int(f)) & (F.col("key") == F.lit(k)) for f, k in keys])


def all_keys(posted: DataFrame, keys: Sequence[tuple[int, object]]) -> DataFrame:
    """Positions that carry every key: one scan, one aggregation."""
    return posted.where(_any_of(keys)).groupBy("position").agg(F.count_distinct("field", "key").alias("n")).where(F.col("n") == len(set(keys))).select("position")


def any_key(posted: DataFrame, keys: Sequence[tuple[int, object]]) -> DataFrame:
    return posted.where(_any_of(keys)).select("position").distinct()


def without_key(posted: DataFrame, keep: Sequence[tuple[int, object]], drop: Sequence[tuple[int, object]]) -> DataFrame:
    """Positions of any of ``keep`` but none of ``drop``."""
    own, not_own = _any_of(keep), _any_of(drop)
    return posted.where(own | not_own).groupBy("position").agg(F.max(own.cast("int")).alias("a"), F.max(not_own.cast("int")).alias("b")).where("a = 1 and b = 0").select("position")


def to_bitmaps(posted: DataFrame) -> DataFrame:
    """(field, key, bucket, bitmap): 4,096 bytes a bucket, for keys with many positions. Positions are shifted by one."""
    p = F.col("position") + 1
    return posted.groupBy("field", "key", F.bitmap_bucket_number(p).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("bitmap"))


def bitmap_cardinality(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.groupBy("field", "key").agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


def bitmap_and(bitmaps: DataFrame, keys: Sequence[tuple[int, object]]) -> DataFrame:
    """(bucket, bitmap); a bucket that some key has no row in is empty."""
    got = bitmaps.where(_any_of(keys)).groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count_distinct("field", "key").alias("k"))
    return got.where(F.col("k") == len(set(keys))).drop("k")


def bitmap_or(bitmaps: DataFrame, keys: Sequence[tuple[int, object]]) -> DataFrame:
    return bitmaps.where(_any_of(keys)).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def dominant(posted: DataFrame, field: int) -> DataFrame:
    """(key, n): the key with most positions, the smallest on ties."""
    counts = posted.where(F.col("field") == int(field)).groupBy("key").agg(F.count_distinct("position").alias("n"))
    return counts.orderBy(F.desc("n"), "key").limit(1)


def sample_keys(posted: DataFrame, first_n: int = 50_000) -> DataFrame:
    """Distinct keys of the first events, with where each is first seen."""
    return posted.where(F.col("position") < first_n).groupBy("field", "key").agg(F.min("position").alias("first_position"))


def contains(posted: DataFrame, field: int, key, events: DataFrame) -> DataFrame:
    """(position, member) for every event."""
    hit = posted.where((F.col("field") == int(field)) & (F.col("key") == F.lit(key))).select("position", F.lit(True).alias("hit")).distinct()
    return events.select("position").join(hit, "position", "left").select("position", F.coalesce("hit", F.lit(False)).alias("member"))
