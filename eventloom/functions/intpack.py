"""Frame-of-reference groups of uint32: residuals above the minimum, bit-packed little-endian, then width and minimum."""

from __future__ import annotations

import numpy as np

from eventloom.model import Corrupt


def width_of(values: np.ndarray) -> int:
    return max(1, int(values.max() - values.min()).bit_length())


def encode_group(values) -> bytes:
    v = np.asarray(values, dtype=np.uint64)
    if not len(v):
        raise ValueError("a group has one value at least")
    if int(v.max()) >> 32:
        raise ValueError("a value has 32 bits at most")
    w = width_of(v)
    bits = (v - v.min())[:, None] >> np.arange(w, dtype=np.uint64)[None, :] & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes() + bytes([w]) + int(v.min()).to_bytes(4, "little")


def decode_group(buf: bytes, n: int) -> tuple[np.ndarray, int]:
    """n values from the tail of ``buf`` and the number of bytes they take."""
    if n <= 0:
        raise Corrupt(f"a group of {n} values")
    if len(buf) < 5:
        raise Corrupt(f"a group in {len(buf)} bytes")
    w, low = buf[-5], int.from_bytes(buf[-4:], "little")
    if w > 32:
        raise Corrupt(f"width {w}")
    size = (w * n + 7) // 8
    if len(buf) < size + 5:
        raise Corrupt("group shorter than its width says")
    if w == 0:
        return np.full(n, low, dtype=np.uint64), 5
    bits = np.unpackbits(np.frombuffer(buf[len(buf) - 5 - size : len(buf) - 5], dtype=np.uint8), bitorder="little")[: w * n].reshape(n, w)
    return (bits.astype(np.uint64) << np.arange(w, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) + np.uint64(low), size + 5
