import hashlib
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventloom.functions.codec import decode_event, encode_event
from eventloom.functions.hashing import content_hash, content_hash_value
from eventloom.model import LEDGER_DDL, Corrupt, EmptyIndex, HashMismatch, KeyNotFound, PositionOutOfRange
from eventloom.operators import index, layout, sealed
from eventloom.operators.extract import flatten_events
from eventloom.operators.ordering import assign_positions, order_key
from eventloom.operators.store import EventStore
from eventloom.sources import chunks, eventcache
from eventloom.sources import packfile as P


def frame(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "position long, item binary")


def brute_hash(items, n):
    digests = b"".join(hashlib.sha256(b"".join(struct.pack("<I", len(x)) + x for x in items[i : i + n])).digest() for i in range(0, len(items), n))
    return hashlib.sha256(digests).hexdigest()


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    items = [f"event-{i:04d}".encode() * (1 + i % 3) for i in range(300)]
    path = str(tmp_path_factory.mktemp("store") / "s")
    return EventStore.write(frame(spark, items), path, with_hash=True, app_data=b"app"), items


def rows(df):
    return [(r["position"], bytes(r["item"])) for r in df.collect()]


def test_store_reads(store):
    s, items = store
    assert s.count() == 300
    for p in (0, 1, 127, 128, 299):
        assert rows(s.point(p)) == [(p, items[p])]
    assert rows(s.range(120, 80)) == [(i, items[i]) for i in range(120, 200)]
    assert rows(s.range(-5, 0)) == []
    wanted = [0, 1, 127, 128, 200, 299]
    assert rows(s.positions(wanted)) == [(i, items[i]) for i in wanted]
    assert rows(s.positions([])) == []
    assert s.app_data() == b"app" and s.trailer().first()["record_count"] == 3


@pytest.mark.parametrize("call", [lambda s: s.point(-1), lambda s: s.point(300), lambda s: s.range(-1, 1), lambda s: s.range(0, -1), lambda s: s.range(290, 20), lambda s: s.positions([5, 300])])
def test_out_of_range(store, call):
    with pytest.raises(PositionOutOfRange):
        call(store[0])


def test_positions_of_a_table(spark, store):
    s, items = store
    table = lambda ps: spark.createDataFrame([(p,) for p in ps], "position long")
    assert rows(s.positions(table([299, 7, 7, 0]))) == [(i, items[i]) for i in (0, 7, 299)]
    assert rows(s.positions(table([]))) == []
    for bad in ([0, 300], [-1]):
        with pytest.raises(PositionOutOfRange):
            s.positions(table(bad))


def test_for_each(spark, store):
    s, items = store

    def sizes(batch):
        return pa.RecordBatch.from_arrays([batch.column("position"), pa.array([len(x.as_py()) for x in batch.column("item")], pa.int64())], names=["position", "size"])

    assert {r.position: r.size for r in s.for_each(sizes, "position long, size long").collect()} == {i: len(x) for i, x in enumerate(items)}
    assert s.for_each(sizes, "position long, size long", s.range(5, 3)).count() == 3


def test_overwrite_is_whole_or_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    EventStore.write(frame(spark, [b"a", b"b"]), path, with_hash=True)

    def stop(*_):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(sealed, "commit", stop)
    with pytest.raises(RuntimeError):
        EventStore.write(frame(spark, [b"c"]), path, mode="overwrite", with_hash=True)
    monkeypatch.undo()
    old = EventStore(spark, path)
    assert old.count() == 2 and old.verify() and rows(old.scan().orderBy("position")) == [(0, b"a"), (1, b"b")]
    assert EventStore.write(frame(spark, [b"x"]), path, mode="ignore").count() == 2
    EventStore.write(frame(spark, [b"c"]), path, mode="overwrite")
    assert EventStore(spark, path).count() == 1 and len(list((tmp_path / "s").iterdir())) == 1
    with pytest.raises(FileNotFoundError):
        EventStore(spark, str(tmp_path / "none")).count()
    with pytest.raises(ValueError, match="whole"):
        EventStore.write(frame(spark, [b"c"]), path, mode="append")


def test_index_verify(spark, posted, tmp_path):
    path = str(tmp_path / "ix")
    ix = index.BitmapIndex.write(posted, path)
    assert index.BitmapIndex(spark, path).verify() and index.BitmapIndex.write(posted.repartition(7), str(tmp_path / "other")).stored_hash() == ix.stored_hash()
    back = index.BitmapIndex.deserialised(ix.serialised())
    assert sorted(map(str, back.collect())) == sorted(map(str, ix.table().select(F.col("field").cast("int"), "key", "chunk", "positions").collect()))
    for f in (tmp_path / "ix").glob("v=*/entries/field=3/*.parquet"):
        f.unlink()  # an entry is lost
    with pytest.raises(HashMismatch):
        index.BitmapIndex(spark, path).verify()
    with pytest.raises(FileExistsError):
        index.BitmapIndex.write(posted, path)


def test_roaring_payloads_of_later_chunks(spark, tmp_path):
    p = spark.range(0, 200_000, 3).select(F.lit(1).alias("field"), F.lit(b"k").alias("key"), F.col("id").alias("position"))
    back = index.BitmapIndex.deserialised(index.BitmapIndex.write(p, str(tmp_path / "big")).serialised())
    assert sorted(x for r in back.collect() for x in r.positions) == list(range(0, 200_000, 3))


def test_positions_ascend(store):
    for bad in ([10, 5, 20], [5, 5, 10]):
        with pytest.raises(ValueError, match="ascend"):
            store[0].positions(bad)


def test_hash_and_verify(spark, store, tmp_path):
    s, items = store
    assert s.content_hash() == brute_hash(items, 128) and s.verify()
    for n in (1, 2, 64, 500):
        assert content_hash(frame(spark, items).repartition(5), n).first()[0] == brute_hash(items, n) == content_hash_value(frame(spark, items), n)
    assert content_hash_value(frame(spark, []), 128) == hashlib.sha256(b"").hexdigest() == content_hash(frame(spark, []), 128).first()[0]
    s._meta = s.meta | {"content_hash": "00"}
    with pytest.raises(HashMismatch):
        s.verify()
    s._meta = None
    with pytest.raises(Exception, match="(?i)exist"):
        EventStore.write(frame(spark, items), s.path)
    assert EventStore.write(frame(spark, []), str(tmp_path / "empty")).count() == 0


def test_positions_equal_row_number(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 50).alias("ledger_sequence"), (F.col("id") % 7).alias("transaction_index"), F.when(F.col("id") % 5 == 0, 65535).otherwise(F.col("id") % 3).alias("operation_index"), F.col("id").alias("event_index"))
    got = [tuple(r) for r in assign_positions(df, order_key()).orderBy("position").collect()]
    assert [r[4] for r in got] == list(range(5000))
    key = lambda r: (r[0], r[1], -1 if r[2] == 65535 else r[2], r[3])
    assert [key(r) for r in got] == sorted(map(key, got))


def test_flatten(spark):
    ev = lambda kind, v=0: (b"c" * 32, kind, v, [b"t"], b"d")
    tx = [(1, b"h" * 32, True, [ev(1), ev(2), ev(0)], [([ev(2), ev(1, 1)],)]), (2, None, False, None, [([ev(1)],), (None,)])]
    got = flatten_events(spark.createDataFrame([(9, None, tx)], LEDGER_DDL)).orderBy("transaction_index", "operation_index", "event_index").collect()
    assert [(r.transaction_index, r.operation_index, r.event_index) for r in got] == [(1, 0, 1), (1, 65535, 0), (1, 65535, 2), (2, 0, 0)]
    assert got[0].topics == [] and bytes(got[0].data_bytes) == b"" and bytes(got[3].tx_hash) == bytes(32) and not got[3].successful


def test_codec(spark):
    rows_ = [(b"a" * 32, [b"x", b"", b"y" * 100], b"\xcc" * 32, 1, b"data", 1_700_000_000, True), (b"short", [], None, 0, b"", -5, False), (b"b" * 40, [b"q"] * 6, b"z", 2, b"d", 0, True)]
    df = spark.createDataFrame(rows_, "contract_id binary, topics array<binary>, tx_hash binary, event_type int, data_bytes binary, s long, successful boolean").withColumn("ledger_closed_at", F.timestamp_seconds("s"))
    enc = df.select(encode_event().alias("item"))
    raws = [bytes(r[0]) for r in enc.collect()]
    assert raws[0] == bytes([2, 1, 3, 3]) + b"a" * 32 + b"\xcc" * 32 + struct.pack(">qI", 1_700_000_000, 4) + b"\0\1x\0\0\0\x64" + b"y" * 100 + b"data"
    got = [r[0] for r in enc.select(decode_event("item").alias("e")).collect()]
    assert bytes(got[0].contract_id) == b"a" * 32 and [bytes(t) for t in got[0].topics] == rows_[0][1] and got[1].contract_id is None and bytes(got[1].tx_hash) == bytes(32) and bytes(got[2].contract_id) == b"b" * 32
    bad = spark.createDataFrame([(raws[0][:79],), (b"\x09" + raws[0][1:],), (raws[0][:-1],), (raws[0][:81],), (raws[0] + b"more",)], "item binary")
    errors = [r[0]["error"] for r in bad.select(decode_event("item", "PERMISSIVE")).collect()]
    assert errors == ["too short", "unsupported version", "truncated data", "truncated topic 0", None]
    with pytest.raises(Exception, match="event: (too short|truncated|unsupported)"):
        bad.select(decode_event("item")).collect()
    with pytest.raises(Exception, match="255 topics"):
        df.limit(1).withColumn("topics", F.array_repeat(F.lit(b"x"), 256)).select(encode_event()).collect()


@pytest.fixture(scope="module")
def posted(spark):
    data = [(0, b"A", [b"transfer"]), (1, b"A", [b"transfer"]), (2, b"B", [b"mint"]), (3, b"A", [b"approve", b"A", b"A", b"", b"fifth"]), (4, None, [])]
    return index.postings(spark.createDataFrame(data, "position long, contract_id binary, topics array<binary>"))


def test_index(spark, posted, tmp_path):
    ix = index.BitmapIndex.write(posted, str(tmp_path / "ix"))
    look = lambda f, k: [r[0] for r in ix.lookup(f, k).collect()]
    assert look(1, b"A") == [0, 1, 3] and look(1, b"B") == [2] and look(2, b"transfer") == [0, 1] and look(3, b"A") == [3] and look(5, b"") == [3]
    with pytest.raises(KeyNotFound):
        ix.lookup(2, b"fifth")
    assert ix.lookup(2, b"fifth", strict=False).collect() == []
    got = ix.lookup_keys([(1, b"B"), (1, b"none"), (2, b"transfer"), (1, b"B")]).collect()
    assert [(r["ord"], r["positions"]) for r in got] == [(0, [2]), (1, None), (2, [0, 1]), (3, [2])]
    assert ix.content_hash() == ix.content_hash()
    with pytest.raises(EmptyIndex):
        index.BitmapIndex.write(posted.limit(0), str(tmp_path / "no"))


def test_boolean_and_bitmaps(posted):
    vals = lambda df: sorted(r[0] for r in df.collect())
    a, t = (1, b"A"), (2, b"transfer")
    assert vals(index.all_keys(posted, [a, t])) == [0, 1] and vals(index.any_key(posted, [t, (1, b"B")])) == [0, 1, 2] and vals(index.without_key(posted, [a], [t])) == [3]
    maps = index.to_bitmaps(posted)
    assert {(r.field, bytes(r.key)): r.n for r in index.bitmap_cardinality(maps).collect()}[a] == 3
    assert index.bitmap_and(maps, [a, t]).agg(F.sum(F.bitmap_count("bitmap"))).first()[0] == 2


def test_posting_chunks(spark):
    p = spark.range(0, 150_000).select(F.lit(1).alias("field"), F.lit(b"k").alias("key"), F.col("id").alias("position"))
    got = index.build(p).orderBy("chunk").collect()
    assert [r.cardinality for r in got] == [65536, 65536, 150_000 - 131072] and got[1].positions[0] == 65536


def test_generators():
    assert layout.scattered(1000, 50, 3) == layout.scattered(1000, 50, 3) and len(set(layout.scattered(1000, 50))) == 50
    c = layout.consecutive(1000, 20)
    assert c == list(range(c[0], c[0] + 20)) and layout.mixed(500, 2, 10, 5) == sorted(layout.mixed(500, 2, 10, 5))


@pytest.mark.parametrize("fmt", P.FORMATS)
@pytest.mark.parametrize("n", [1, 128])
@pytest.mark.parametrize("hashed", [True, False])
@pytest.mark.parametrize("parts", [1, 4])
def test_packfile_matrix(spark, tmp_path, fmt, n, hashed, parts):
    P.register(spark)
    items = [b"" if i == 17 else f"item-{i}".encode() * (i % 4 + 1) for i in range(300)]
    path = str(tmp_path / "f.pack")
    t = P.write_packfile(frame(spark, items), path, n=n, fmt=fmt, content_hash=hashed, app_data=b"x", partitions=parts)
    back, _, app = P.open_packfile(path)
    assert back == t and app == b"x" and back.total_items == 300
    if hashed:
        assert t.content_hash.hex() == brute_hash(items, n)
    load = lambda **o: rows(spark.read.format("packfile").options(**o).load(path).orderBy("position"))
    assert load() == list(enumerate(items))
    assert load(start=120, count=80) == [(i, items[i]) for i in range(120, 200)]
    assert load(positions="0,127,128,299") == [(i, items[i]) for i in (0, 127, 128, 299)]


def test_packfile_guards(spark, tmp_path):
    P.register(spark)
    path = str(tmp_path / "g.pack")
    P.write_packfile(frame(spark, [b"a", b"b"]), path, content_hash=True)
    assert P.verify_packfile(spark, path)
    with pytest.raises(FileExistsError):
        P.write_packfile(frame(spark, [b"a"]), path)
    raw = open(path, "rb").read()
    for at in (len(raw) - 64, len(raw) - 59, len(raw) - 1, len(raw) - 68):
        broken = bytearray(raw)
        broken[at] ^= 0xFF
        (tmp_path / "bad").write_bytes(bytes(broken))
        with pytest.raises(Corrupt):
            P.open_packfile(str(tmp_path / "bad"))
    P.write_packfile(frame(spark, []), str(tmp_path / "empty"), content_hash=True)
    assert P.open_packfile(str(tmp_path / "empty"))[0].content_hash == hashlib.sha256(b"").digest()
    with pytest.raises(ValueError):
        P.write_packfile(frame(spark, [b"a"]), str(tmp_path / "neg"), n=-1)


def test_chunk_and_cache_sources(spark, tmp_path):
    P.register(spark)
    i, d = str(tmp_path / "c.index"), str(tmp_path / "c.data")
    for width in (4, 8):
        chunks.write_chunk(i, d, [b"one", b"two" * 50, b""], width)
        got = spark.read.format("ledgerchunk").option("index", i).option("data", d).option("ledgersPerPartition", 2).load().orderBy("ledger_ordinal").collect()
        assert [bytes(r.payload) for r in got] == [b"one", b"two" * 50, b""]
    raw = bytearray(open(d, "rb").read())
    raw[1] ^= 0xFF
    open(d, "wb").write(bytes(raw))
    load = lambda mode: spark.read.format("ledgerchunk").option("index", i).option("data", d).option("mode", mode).load()
    assert load("DROPMALFORMED").count() == 2
    with pytest.raises(Exception, match="ledger 0"):
        load("FAILFAST").collect()
    path = str(tmp_path / "events.bin")
    eventcache.save(frame(spark, [b"a", b"", b"ccc"]), path)
    assert rows(spark.read.format("eventcache").load(path).orderBy("position")) == [(0, b"a"), (1, b""), (2, b"ccc")]
