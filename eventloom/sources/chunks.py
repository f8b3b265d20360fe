"""Ledger chunks: an index of offsets and a data file of zstd frames, one a ledger."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from eventloom.model import Corrupt

from .files import read_at, size_of, spans

_HEADER = 8


def read_offsets(index_path: str) -> np.ndarray:
    raw = read_at(index_path, 0, size_of(index_path))
    if len(raw) < _HEADER or raw[0] != 1:
        raise Corrupt(f"chunk index version {raw[0] if raw else None}")
    if raw[1] not in (4, 8):
        raise Corrupt(f"offset width {raw[1]}")
    body = raw[_HEADER : len(raw) - (len(raw) - _HEADER) % raw[1]]
    out = np.frombuffer(body, dtype=f"<u{raw[1]}")
    if len(out) and int(out.max()) >> 63:
        raise Corrupt("offset beyond 63 bits")
    return out.astype(np.int64)


def write_chunk(index_path: str, data_path: str, payloads: Sequence[bytes], width: int = 8) -> None:
    """A chunk of a few ledgers, for fixtures."""
    c = zstandard.ZstdCompressor(level=3)
    frames = [c.compress(p) for p in payloads]
    at = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype(f"<u{width}")
    with open(index_path, "wb") as f:
        f.write(bytes([1, width]) + bytes(6) + at.tobytes())
    with open(data_path, "wb") as f:
        f.write(b"".join(frames))


class Ledgers(InputPartition):
    def __init__(self, first: int, offsets: list[int]):
        self.first, self.offsets = first, offsets


class ChunkSource(DataSource):
    """Options: ``index``, ``data``, ``mode`` (FAILFAST or DROPMALFORMED), ``ledgersPerPartition``."""

    @classmethod
    def name(cls) -> str:
        return "ledgerchunk"

    def schema(self) -> str:
        return "ledger_ordinal bigint, payload binary"

    def reader(self, schema) -> DataSourceReader:
        return ChunkReader(self.options)


class ChunkReader(DataSourceReader):
    def __init__(self, options):
        self.index, self.data = options["index"], options["data"]
        self.drop = options.get("mode", "FAILFAST").upper() == "DROPMALFORMED"
        self.per = int(options.get("ledgersPerPartition", 1000))

    def partitions(self) -> list[Ledgers]:
        at = read_offsets(self.index).tolist()
        return [Ledgers(i, at[i : i + self.per + 1]) for i in range(0, max(0, len(at) - 1), self.per)]

    def read(self, partition: Ledgers) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        pieces = [(a, b - a) for a, b in zip(partition.offsets, partition.offsets[1:], strict=False)]
        for i, frame in enumerate(spans(self.data, pieces)):
            try:
                payload = d.decompress(frame, max_output_size=1 << 31) if frame else b""
            except zstandard.ZstdError as e:
                if self.drop:
                    continue
                raise Corrupt(f"ledger {partition.first + i}: {e}") from e
            yield pa.RecordBatch.from_arrays([pa.array([partition.first + i], pa.int64()), pa.array([payload], pa.binary())], names=["ledger_ordinal", "payload"])
