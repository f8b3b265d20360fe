import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.functions import intpack, roaring
from eventloom.functions.checksum import crc32c, crc32c_many
from eventloom.model import Corrupt
from eventloom.sources import packfile as P


def test_crc32c_known_values():
    assert crc32c(b"123456789") == 0xE3069283
    assert crc32c(b"") == 0
    assert crc32c(bytes(32)) == 0x8A9136AA


@given(st.lists(st.binary(max_size=70), max_size=30))
@settings(max_examples=50, deadline=None)
def test_crc32c_of_many(items):
    assert crc32c_many(items, long=40).tolist() == [crc32c(x) for x in items]


@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=128))
@settings(max_examples=60, deadline=None)
def test_group_round_trip(values):
    raw = intpack.encode_group(values)
    got, used = intpack.decode_group(b"before" + raw, len(values))
    assert got.tolist() == values and used == len(raw)


def test_group_shapes():
    assert intpack.encode_group([100, 200, 300])[-5:] == bytes([8]) + (100).to_bytes(4, "little")
    assert intpack.encode_group([100] * 4)[-5] == 1
    assert intpack.decode_group(bytes([0]) + (7).to_bytes(4, "little"), 3)[0].tolist() == [7, 7, 7]
    for bad, n in ((b"", 1), (b"1234", 1), (bytes([33, 0, 0, 0, 0]), 1), (bytes([8, 0, 0, 0, 0]), 5), (bytes(9), 0)):
        with pytest.raises(Corrupt):
            intpack.decode_group(bad, n)
    with pytest.raises(ValueError):
        intpack.encode_group([])


@given(st.sets(st.integers(0, 300_000), max_size=400))
@settings(max_examples=40, deadline=None)
def test_roaring_round_trip(values):
    assert roaring.deserialize(roaring.serialize(sorted(values))).tolist() == sorted(values)


def test_roaring_containers():
    dense, run = np.arange(0, 65536, 3), np.arange(70_000, 90_000)
    both = np.concatenate([dense, run, [4_000_000_000]])
    assert roaring.deserialize(roaring.serialize(both)).tolist() == both.tolist()
    assert len(roaring.serialize(run)) < 40
    with pytest.raises(Corrupt):
        roaring.deserialize(b"\x01\x02\x03\x04")


@pytest.mark.parametrize("fmt", P.FORMATS)
@pytest.mark.parametrize("n", [1, 3, 128])
def test_record_round_trip_and_corruption(fmt, n):
    items = [bytes([i]) * (i % 5) for i in range(min(n, 7))]
    raw = P.encode_record(items, n, fmt)
    assert P.decode_record(raw, len(items), n, fmt) == items
    if n > 1:
        with pytest.raises(Corrupt):
            P.decode_record(raw[:-1] + bytes([raw[-1] ^ 1]), len(items), n, fmt)
        with pytest.raises(Corrupt):
            P.decode_record(raw[:5], len(items), n, fmt)


def test_record_arithmetic():
    for total, n, r, want in ((300, 128, 2, 44), (256, 128, 1, 128), (50, 128, 0, 50), (0, 128, 0, 0), (10, 3, 3, 1)):
        assert P.items_in(total, n, r) == want


def test_index_of_offsets():
    sizes = list(range(10, 310))
    raw = P.encode_index(sizes)
    assert P.decode_index(raw, 300, sum(sizes)).tolist() == [0, *np.cumsum(sizes).tolist()]
    for bad in (raw[:-1] + b"\0", raw[:2]):
        with pytest.raises(Corrupt):
            P.decode_index(bad, 300, sum(sizes))
    with pytest.raises(Corrupt):
        P.decode_index(raw, 300, sum(sizes) + 1)
    assert struct.unpack("<I", P.encode_index([]))[0] == 0
