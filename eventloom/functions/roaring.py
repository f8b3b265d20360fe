"""Sets of uint32 in the public portable roaring format: array, bitmap and run containers."""

from __future__ import annotations

import struct

import numpy as np

from eventloom.model import Corrupt

# Fixed values of the format.
_COOKIE_RUNS = 12347
_COOKIE = 12346
_ARRAY_MAX = 4096
_NO_OFFSETS = 4


def serialize(values) -> bytes:
    v = np.unique(np.asarray(values, dtype=np.uint32))
    highs, first = np.unique(v >> 16, return_index=True)
    bodies, runs = [], []
    for low in np.split((v & 0xFFFF).astype(np.uint16), first[1:]) if len(v) else []:
        starts = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-2) != 1)
        ends = np.append(starts[1:], len(low))
        plain = 2 * len(low) if len(low) <= _ARRAY_MAX else 8192
        runs.append(2 + 4 * len(starts) < plain)
        if runs[-1]:
            pairs = np.stack([low[starts], (ends - starts - 1).astype(np.uint16)], axis=1).astype("<u2")
            bodies.append((len(low), struct.pack("<H", len(starts)) + pairs.tobytes()))
        elif len(low) <= _ARRAY_MAX:
            bodies.append((len(low), low.astype("<u2").tobytes()))
        else:
            bits = np.zeros(65536, dtype=np.uint8)
            bits[low] = 1
            bodies.append((len(low), np.packbits(bits, bitorder="little").tobytes()))
    n = len(bodies)
    if any(runs):
        head = struct.pack("<I", _COOKIE_RUNS | (n - 1) << 16) + np.packbits(np.array(runs, dtype=np.uint8), bitorder="little").tobytes()
    else:
        head = struct.pack("<II", _COOKIE, n)
    head += b"".join(struct.pack("<HH", int(h), c - 1) for h, (c, _) in zip(highs, bodies, strict=True))
    if not any(runs) or n >= _NO_OFFSETS:
        at = len(head) + 4 * n
        for _, b in bodies:
            head += struct.pack("<I", at)
            at += len(b)
    return head + b"".join(b for _, b in bodies)


def deserialize(raw: bytes) -> np.ndarray:
    try:
        cookie = struct.unpack_from("<I", raw)[0]
        if cookie & 0xFFFF == _COOKIE_RUNS:
            n, at = (cookie >> 16) + 1, 4
            runs = np.unpackbits(np.frombuffer(raw, np.uint8, (n + 7) // 8, at), bitorder="little")[:n]
            at += (n + 7) // 8
        elif cookie == _COOKIE:
            n, at = struct.unpack_from("<I", raw, 4)[0], 8
            runs = np.zeros(n, dtype=np.uint8)
        else:
            raise Corrupt("not a roaring bitmap")
        keys = [struct.unpack_from("<HH", raw, at + 4 * i) for i in range(n)]
        at += 4 * n
        if cookie == _COOKIE or n >= _NO_OFFSETS:
            at += 4 * n
        out = []
        for (high, count), run in zip(keys, runs, strict=True):
            if run:
                m = struct.unpack_from("<H", raw, at)[0]
                pairs = np.frombuffer(raw, "<u2", 2 * m, at + 2).reshape(m, 2).astype(np.int64)
                low = np.concatenate([np.arange(s, s + k + 1) for s, k in pairs])
                at += 2 + 4 * m
            elif count + 1 <= _ARRAY_MAX:
                low = np.frombuffer(raw, "<u2", count + 1, at).astype(np.int64)
                at += 2 * (count + 1)
            else:
                low = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, 8192, at), bitorder="little"))
                at += 8192
            out.append(low + (high << 16))
    except (struct.error, ValueError) as e:
        raise Corrupt(str(e)) from e
    return np.concatenate(out).astype(np.uint32) if out else np.zeros(0, np.uint32)
