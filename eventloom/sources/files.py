"""Byte ranges of files on any file system pyarrow knows; plain paths are local."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs as pafs


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def size_of(path: str) -> int:
    fs, p = resolve(path)
    info = fs.get_file_info(p)
    if info.type != pafs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def read_at(path: str, offset: int, length: int) -> bytes:
    fs, p = resolve(path)
    with fs.open_input_file(p) as f:
        return f.read_at(length, offset)


def spans(path: str, pieces: list[tuple[int, int]], most: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of (offset, length) pieces in order; neighbours are read together up to ``most`` bytes."""
    fs, p = resolve(path)
    with fs.open_input_file(p) as f:
        i = 0
        while i < len(pieces):
            j, start = i + 1, pieces[i][0]
            end = start + pieces[i][1]
            while j < len(pieces) and pieces[j][0] == end and end + pieces[j][1] - start <= most:
                end += pieces[j][1]
                j += 1
            raw = f.read_at(end - start, start)
            for offset, length in pieces[i:j]:
                yield raw[offset - start : offset - start + length]
            i = j
