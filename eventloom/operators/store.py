"""A sealed store of rows by position, in Parquet sorted by position."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.hashing import content_hash_value
from eventloom.model import HashMismatch, PositionOutOfRange
from eventloom.operators import sealed

#: Up to this many positions a scan filter is used, beyond it a join.
IN_LIST = 1000


class EventStore:
    """Reads of a store. ``items`` names the column that the content hash covers (binary), if there is one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._at: str | None = None
        self._meta: dict | None = None

    # writing

    @classmethod
    def write(cls, df: DataFrame, path: str, mode: str = "errorifexists", items_per_record: int = 128, with_hash: bool = False, app_data: bytes = b"", item: str = "item", partitions: int | None = None) -> EventStore:
        """Seal ``df`` (with ``position``) as a new version. Nothing counts as written before its metadata, which comes last:
        an overwrite that breaks off leaves the store as it was. Modes: errorifexists, overwrite, ignore."""
        if items_per_record < 0:
            raise ValueError("items_per_record is negative")
        spark = df.sparkSession
        at = sealed.fresh(spark, path, mode)
        if at is None:
            return cls(spark, path)
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartitionByRange(n, "position").sortWithinPartitions("position").write.option("compression", "zstd").parquet(f"{at}/data")
        back = spark.read.parquet(f"{at}/data")
        meta = {"version": 1, "total_items": back.count(), "items_per_record": items_per_record or 128, "app_data": app_data.hex()}
        if with_hash:
            meta["content_hash"] = content_hash_value(back.select("position", F.col(item).alias("item")), meta["items_per_record"])
            meta["item"] = item
        sealed.commit(spark, at, meta)
        return cls(spark, path)

    @property
    def at(self) -> str:
        """The folder of the version that this store reads."""
        if self._at is None:
            self._at = sealed.current(self.spark, self.path)
            if self._at is None:
                raise FileNotFoundError(f"no store at {self.path}")
        return self._at

    @property
    def meta(self) -> dict:
        if self._meta is None:
            self._meta = sealed.meta(self.spark, self.at)
        return self._meta

    # reading

    def scan(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/data")

    def count(self) -> int:
        return self.meta["total_items"]

    def point(self, position: int) -> DataFrame:
        if not 0 <= position < self.count():
            raise PositionOutOfRange(f"position {position} of {self.count()}")
        return self.scan().where(F.col("position") == position)

    def range(self, start: int, count: int) -> DataFrame:
        if count == 0:
            return self.scan().where(F.lit(False))
        if count < 0 or start < 0 or start + count > self.count():
            raise PositionOutOfRange(f"{count} from {start} of {self.count()}")
        return self.scan().where((F.col("position") >= start) & (F.col("position") < start + count)).orderBy("position")

    def first_n(self, n: int) -> DataFrame:
        return self.scan().where(F.col("position") < n)

    def positions(self, wanted: Sequence[int] | DataFrame) -> DataFrame:
        """Rows at strictly ascending positions, in their order. A DataFrame of ``position`` may have any size and has no
        order: repeated positions count once. Positions outside the store are an error in both."""
        if isinstance(wanted, DataFrame):
            low, high = wanted.agg(F.min("position"), F.max("position")).first()
            if low is not None and (low < 0 or high >= self.count()):
                raise PositionOutOfRange(f"positions {low} to {high} of {self.count()}")
            return self.scan().join(wanted.select("position").distinct(), "position", "left_semi").orderBy("position")
        wanted = list(wanted)
        if any(b <= a for a, b in zip(wanted, wanted[1:], strict=False)):
            raise ValueError("positions must ascend strictly")
        if wanted and (wanted[0] < 0 or wanted[-1] >= self.count()):
            raise PositionOutOfRange(f"positions {wanted[0]} to {wanted[-1]} of {self.count()}")
        if len(wanted) <= IN_LIST:
            return self.scan().where(F.col("position").isin(wanted)).orderBy("position")
        few = self.spark.createDataFrame([(p,) for p in wanted], "position long")
        low, high = wanted[0], wanted[-1]
        return self.scan().where(F.col("position").between(low, high)).join(few, "position").orderBy("position")

    def for_each(self, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: DataFrame | None = None) -> DataFrame:
        """Apply a function to Arrow batches of rows."""

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                yield fn(batch)

        return (self.scan() if rows is None else rows).mapInArrow(run, schema)

    # integrity and metadata

    def content_hash(self) -> str | None:
        return self.meta.get("content_hash")

    def verify(self) -> bool:
        """True if nothing is stored to compare with, or it agrees; HashMismatch otherwise."""
        stored = self.content_hash()
        if stored is None:
            return True
        got = content_hash_value(self.scan().select("position", F.col(self.meta["item"]).alias("item")), self.meta["items_per_record"])
        if got != stored:
            raise HashMismatch(f"{got} is not {stored}")
        return True

    def app_data(self) -> bytes | None:
        return bytes.fromhex(self.meta["app_data"]) or None

    def trailer(self) -> DataFrame:
        m, n = self.meta, self.meta["items_per_record"]
        row = (m["version"], -(-m["total_items"] // n), m["total_items"], n, len(m["app_data"]) // 2, m.get("content_hash"), "content_hash" in m, "parquet")
        return self.spark.createDataFrame([row], "version long, record_count long, total_items long, items_per_record long, app_data_size long, content_hash string, has_content_hash boolean, format string")
