"""Files of raw events: count, total bytes, then each event behind its length (all uint32, little-endian)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from eventloom.model import Corrupt

from .files import resolve


def save(events: DataFrame, path: str) -> None:
    """Write (position, item) in order of position; the driver holds one partition at a time."""
    from pyspark.sql import functions as F

    n, total = events.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("item")), F.lit(0))).first()
    if n >> 32 or total >> 32:
        raise ValueError("the format's counts have 32 bits")
    fs, p = resolve(path)
    with fs.open_output_stream(p) as f:
        f.write(struct.pack("<II", n, total))
        for (item,) in events.orderBy("position").select("item").toLocalIterator():
            f.write(struct.pack("<I", len(item)) + bytes(item))


class Whole(InputPartition):
    def __init__(self, path: str):
        self.path = path


class EventCacheSource(DataSource):
    """Option: ``path``. The format has no index, so a file is one task; write several files to read in parallel."""

    @classmethod
    def name(cls) -> str:
        return "eventcache"

    def schema(self) -> str:
        return "position bigint, item binary"

    def reader(self, schema) -> DataSourceReader:
        return EventCacheReader(self.options)


class EventCacheReader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["path"].split(",")

    def partitions(self) -> list[Whole]:
        return [Whole(p) for p in self.paths]

    def read(self, partition: Whole) -> Iterator[pa.RecordBatch]:
        fs, p = resolve(partition.path)
        with fs.open_input_stream(p, buffer_size=1 << 20) as f:
            head = f.read(8)
            if len(head) < 8:
                raise Corrupt("event cache without a header")
            count, at = struct.unpack("<I", head[:4])[0], 0
            while at < count:
                items = []
                while at + len(items) < count and len(items) < 1000:
                    size = f.read(4)
                    item = f.read(n := struct.unpack("<I", size)[0]) if len(size) == 4 else b""
                    if len(size) < 4 or len(item) < n:
                        raise Corrupt(f"event cache ends at event {at + len(items)}")
                    items.append(item)
                yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(items)), pa.int64()), pa.array(items, pa.binary())], names=["position", "item"])
                at += len(items)
