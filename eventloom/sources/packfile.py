"""Packfiles: sealed files of items addressed by position, read and written byte for byte.

Records of N items (compressed | with CRC32C | raw) with a frame-of-reference group of item sizes, an index of record
sizes, application data and a 64-byte trailer. Reading is a data source with a task for each range of records; positions
outside the asked ones are not read. Writing builds records in tasks and appends them in order.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from eventloom.functions.checksum import crc32c
from eventloom.functions.intpack import decode_group, encode_group
from eventloom.model import ChecksumMismatch, Corrupt, HashMismatch, PositionOutOfRange
from eventloom.scratch import cut

from .files import read_at, resolve, size_of, spans

# Fixed values of the format.
MAGIC = 0x534C4348
VERSION = 1
TRAILER = 64
GROUP = 128
NO_COMPRESSION, CONTENT_HASH, NO_CRC = 1, 2, 4
FORMATS = ("compressed", "uncompressed", "raw")
_HEAD = struct.Struct("<IBBIIIII32sH")


def items_in(total: int, n: int, record: int) -> int:
    """Items of a record; the last may have fewer."""
    return max(0, min(n, total - record * n))


def encode_record(items: list[bytes], n: int, fmt: str = "compressed") -> bytes:
    payload = b"".join(items)
    if fmt == "compressed":
        body = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(payload) if payload else b""
    else:
        body = payload + (struct.pack("<I", crc32c(payload)) if fmt == "uncompressed" else b"")
    if n == 1:
        return body
    sizes = encode_group([len(x) for x in items])
    return body + sizes + struct.pack("<I", crc32c(sizes))


def decode_record(raw: bytes, count: int, n: int, fmt: str) -> list[bytes]:
    sizes = None
    if n > 1:
        if len(raw) < 9:
            raise Corrupt(f"record of {len(raw)} bytes")
        width = raw[-9]
        start = len(raw) - 9 - (width * count + 7) // 8
        if width > 32 or start < 0:
            raise Corrupt("size group does not fit its record")
        if crc32c(raw[start:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ChecksumMismatch("size group")
        sizes, raw = decode_group(raw[start:-4], count)[0].astype(np.int64), raw[:start]
    if fmt == "compressed":
        try:
            payload = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 31) if raw else b""
        except zstandard.ZstdError as e:
            raise Corrupt(str(e)) from e
    elif fmt == "uncompressed":
        if len(raw) < 4:
            raise Corrupt(f"payload of {len(raw)} bytes")
        payload = raw[:-4]
        if crc32c(payload) != struct.unpack("<I", raw[-4:])[0]:
            raise ChecksumMismatch("payload")
    else:
        payload = raw
    if sizes is None:
        return [payload]
    ends = np.cumsum(sizes)
    if int(ends[-1]) != len(payload):
        raise Corrupt(f"item sizes sum to {int(ends[-1])}, the payload has {len(payload)} bytes")
    return [payload[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]


def encode_index(sizes: list[int]) -> bytes:
    body = b"".join(encode_group(sizes[i : i + GROUP]) for i in range(0, len(sizes), GROUP))
    return body + struct.pack("<I", crc32c(body))


def decode_index(raw: bytes, records: int, end: int) -> np.ndarray:
    """Offsets of the records and, last, their end."""
    if len(raw) < 4 or records > (len(raw) - 4) // 6 * GROUP:
        raise Corrupt(f"{records} records in an index of {len(raw)} bytes")
    body = raw[:-4]
    if crc32c(body) != struct.unpack("<I", raw[-4:])[0]:
        raise ChecksumMismatch("index")
    groups, at = [], len(body)
    for g in range(-(-records // GROUP) - 1, -1, -1):
        values, used = decode_group(body[:at], min(GROUP, records - g * GROUP))
        groups.append(values)
        at -= used
    if at:
        raise Corrupt(f"{at} bytes of the index are left")
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(groups[::-1]).astype(np.int64))]) if groups else np.zeros(1, np.int64)
    if int(offsets[-1]) != end:
        raise Corrupt(f"records end at {int(offsets[-1])}, the index begins at {end}")
    return offsets


@dataclass
class Trailer:
    version: int
    record_count: int
    total_items: int
    items_per_record: int
    index_size: int
    app_data_size: int
    content_hash: bytes | None
    format: str
    checksum: int

    def pack(self) -> bytes:
        flags = {"compressed": 0, "uncompressed": NO_COMPRESSION, "raw": NO_COMPRESSION | NO_CRC}[self.format] | CONTENT_HASH * (self.content_hash is not None)
        head = _HEAD.pack(MAGIC, VERSION, flags, self.record_count, self.total_items, self.items_per_record, self.index_size, self.app_data_size, self.content_hash or bytes(32), GROUP)
        return head + struct.pack("<I", crc32c(head))


def open_packfile(path: str) -> tuple[Trailer, np.ndarray, bytes]:
    """Trailer, record offsets and application data; everything is validated."""
    size = size_of(path)
    if size < TRAILER:
        raise Corrupt(f"file of {size} bytes")
    tail = read_at(path, max(0, size - (256 << 10)), min(size, 256 << 10))
    raw = tail[-TRAILER:]
    magic, version, flags, records, total, n, index_size, app_size, digest, group = _HEAD.unpack(raw[:60])
    if magic != MAGIC:
        raise Corrupt("not a packfile")
    if version != VERSION:
        raise Corrupt(f"packfile version {version}")
    if group != GROUP or flags & ~7:
        raise Corrupt(f"unknown flags {flags:02x} or group size {group}")
    base = size - TRAILER - app_size - index_size
    if base < 0:
        raise Corrupt("sections are larger than the file")
    if crc32c(raw[:60]) != struct.unpack("<I", raw[60:])[0]:
        raise ChecksumMismatch("trailer")
    need = index_size + app_size
    body = tail[len(tail) - TRAILER - need : len(tail) - TRAILER] if need + TRAILER <= len(tail) else read_at(path, base, need)
    offsets = decode_index(body[:index_size], records, base)
    if records and n <= 0 or n > 0 and -(-total // n) != records:
        raise Corrupt(f"{total} items, {n} a record, in {records} records")
    fmt = "compressed" if not flags & NO_COMPRESSION else "raw" if flags & NO_CRC else "uncompressed"
    return Trailer(version, records, total, n, index_size, app_size, digest if flags & CONTENT_HASH else None, fmt, struct.unpack("<I", raw[60:])[0]), offsets, body[index_size:]


class Records(InputPartition):
    def __init__(self, path: str, records: list[int], offsets: list[int], lengths: list[int], wanted: list[int] | None, total: int, n: int, fmt: str):
        self.path, self.records, self.offsets, self.lengths = path, records, offsets, lengths
        self.wanted, self.total, self.n, self.fmt = wanted, total, n, fmt


class PackfileSource(DataSource):
    """Options: ``path``; ``start`` and ``count``, or ``positions`` (comma-separated, ascending); ``recordsPerPartition``."""

    @classmethod
    def name(cls) -> str:
        return "packfile"

    def schema(self) -> str:
        return "position bigint, item binary"

    def reader(self, schema) -> DataSourceReader:
        return PackfileReader(self.options)


class PackfileReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.per = options["path"], int(options.get("recordsPerPartition", 256))
        self.start, self.count = int(options.get("start", 0)), options.get("count")
        text = options.get("positions")
        self.wanted = None if text is None else [int(x) for x in text.split(",") if x]

    def partitions(self) -> list[Records]:
        t, offsets, _ = open_packfile(self.path)
        wanted = self.wanted
        if wanted is None and (self.count is not None or self.start):
            count = t.total_items - self.start if self.count is None else int(self.count)
            if count and (count < 0 or self.start < 0 or self.start + count > t.total_items):
                raise PositionOutOfRange(f"{count} from {self.start} of {t.total_items}")
            low, high = self.start, self.start + count
        elif wanted is None:
            low, high = 0, t.total_items
        else:
            if any(b <= a for a, b in zip(wanted, wanted[1:], strict=False)):
                raise ValueError("positions must ascend strictly")
            if wanted and (wanted[0] < 0 or wanted[-1] >= t.total_items):
                raise PositionOutOfRange(f"positions {wanted[0]} to {wanted[-1]} of {t.total_items}")
        n = max(1, t.items_per_record)
        if wanted is not None:
            records = sorted({p // n for p in wanted})
        else:
            records = list(range(low // n, -(-high // n))) if high > low else []
        out = []
        for i in range(0, len(records), self.per):
            own = records[i : i + self.per]
            if wanted is not None:
                asked = [p for p in wanted if own[0] * n <= p < (own[-1] + 1) * n]
            else:
                asked = None if low <= own[0] * n and high >= min(t.total_items, (own[-1] + 1) * n) else list(range(max(low, own[0] * n), min(high, (own[-1] + 1) * n)))
            out.append(Records(self.path, own, [int(offsets[r]) for r in own], [int(offsets[r + 1] - offsets[r]) for r in own], asked, t.total_items, n, t.format))
        return out

    def read(self, p: Records) -> Iterator[pa.RecordBatch]:
        asked = None if p.wanted is None else set(p.wanted)
        for record, raw in zip(p.records, spans(p.path, list(zip(p.offsets, p.lengths, strict=True))), strict=True):
            items = decode_record(raw, items_in(p.total, p.n, record), p.n, p.fmt)
            rows = [(record * p.n + i, x) for i, x in enumerate(items) if asked is None or record * p.n + i in asked]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["position", "item"])


def write_packfile(items: DataFrame, path: str, n: int = 128, fmt: str = "compressed", content_hash: bool = False, app_data: bytes = b"", overwrite: bool = False, partitions: int | None = None) -> Trailer:
    """Seal (position, item), positions dense from 0. Records are made in tasks; the driver appends them one by one."""
    n = 128 if n == 0 else n
    if n < 0 or fmt not in FORMATS:
        raise ValueError(f"{n} items a record, format {fmt}")
    fs, p = resolve(path)
    if not overwrite and fs.get_file_info(p).type != pafs.FileType.NotFound:
        raise FileExistsError(path)
    rec = F.expr(f"position DIV {n}")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[bytes] = []
        at = None

        def done() -> pa.RecordBatch:
            digest = hashlib.sha256(b"".join(struct.pack("<I", len(x)) + x for x in own)).digest()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([len(own)], pa.int64()), pa.array([encode_record(own, n, fmt)], pa.binary()), pa.array([digest], pa.binary())], names=["rec", "n_items", "block", "digest"])

        for batch in batches:
            for r, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if r != at and own:
                    yield done()
                    own = []
                at = r
                own.append(x)
        if own:
            yield done()

    dealt = items.select(rec.alias("rec"), "position", "item").repartitionByRange(partitions or int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rec")
    blocks = cut(dealt.sortWithinPartitions("position").select("rec", "item").mapInArrow(make, "rec long, n_items long, block binary, digest binary"), "blocks")
    sizes, total, h = [], 0, hashlib.sha256()
    try:
        with fs.open_output_stream(p) as f:
            for r in blocks.orderBy("rec").toLocalIterator():
                if r["rec"] != len(sizes) or total % n:
                    raise ValueError(f"positions are not dense at record {r['rec']}")
                f.write(bytes(r["block"]))
                sizes.append(len(r["block"]))
                total += r["n_items"]
                h.update(bytes(r["digest"]))
            if total >> 32:
                raise ValueError("a packfile has fewer than 2^32 items")
            index = encode_index(sizes)
            t = Trailer(VERSION, len(sizes), total, n, len(index), len(app_data), h.digest() if content_hash else None, fmt, 0)
            raw = t.pack()
            f.write(index + app_data + raw)
            t.checksum = struct.unpack("<I", raw[60:])[0]
    except BaseException:
        if fs.get_file_info(p).type == pafs.FileType.File:
            fs.delete_file(p)
        raise
    return t


def verify_packfile(spark, path: str) -> bool:
    """Recompute the content hash from the items, in parallel by chunk."""
    from eventloom.functions.hashing import content_hash_value

    t, _, _ = open_packfile(path)
    if t.content_hash is None:
        return True
    got = content_hash_value(spark.read.format("packfile").load(path), t.items_per_record)
    if got != t.content_hash.hex():
        raise HashMismatch(f"{got} is not {t.content_hash.hex()}")
    return True


def register(spark) -> None:
    from .chunks import ChunkSource
    from .eventcache import EventCacheSource

    for s in (PackfileSource, ChunkSource, EventCacheSource):
        spark.dataSource.register(s)
