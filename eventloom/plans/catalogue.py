"""Registered queries over the adapter and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.checksum import crc32c_of
from eventloom.functions.codec import decode_error, decode_event, encode_event
from eventloom.functions.hashing import chunk_digests, content_hash_value
from eventloom.operators import index, layout
from eventloom.operators.extract import flatten_events
from eventloom.operators.ordering import order_key
from eventloom.operators.store import EventStore
from eventloom.scratch import new_path
from eventloom.streaming.seal import in_time, seal_stream, sealed, windowed_counts

from .adapter import CTE, index_of, ledgers_of, postings_of, raw_events, raw_of, store_of, stored_events, typed_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SHOWN = "position, event_id, ledger_seq, tx_index, op_index, type_code, contract_hex, data, successful"
_SHOWN = SHOWN.split(", ")
SCATTERED = (0, 1, 127, 128, 200, 299, 500)
KEYS = [(2, "click"), (2, "absent"), (2, "view"), (3, "5"), (2, "click"), (1, "absent"), (5, "3")]
PURCHASE, FIVE, THREE = (2, "purchase"), (3, "5"), (4, "3")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"{CTE} {sql}"
        return f

    return add


def _items(spark: SparkSession, d: str) -> DataFrame:
    return typed_events(spark, d).select("position", encode_event().alias("item"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("position", F.octet_length("item").alias("size"))


@query("SELECT event_id, ledger_seq, tx_index, op_index, event_index, type_code, successful FROM st")
def flatten_filter(spark, d):
    e = raw_events(spark, d).where(F.col("type_code") != 2)
    return e.select("event_id", "ledger_seq", "tx_index", "op_index", "event_index", "type_code", "successful")


@query("SELECT position, event_id, ledger_seq FROM st")
def assign_positions(spark, d):
    return stored_events(spark, d).select("position", "event_id", "ledger_seq")


@query("SELECT position, hx AS hex FROM enc")
def event_encode(spark, d):
    return _items(spark, d).select("position", F.hex("item").alias("hex"))


@query("SELECT position, upper(contract_hex) AS contract_hex, array_to_string(topics, '|') AS topics, type_code AS event_type, data, sec, successful FROM st")
def event_decode(spark, d):
    e = _items(spark, d).select("position", decode_event("item").alias("e"))
    return e.select("position", F.hex("e.contract_id").alias("contract_hex"), F.array_join(F.transform("e.topics", lambda t: F.decode(t, "utf-8")), "|").alias("topics"), F.col("e.event_type").alias("event_type"), F.decode("e.data_bytes", "utf-8").alias("data"), F.unix_seconds("e.ledger_closed_at").alias("sec"), F.col("e.successful").alias("successful"))


@query("SELECT CASE position % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'too short' WHEN 2 THEN 'unsupported version' ELSE 'truncated data' END AS verdict, count(*) AS n FROM st GROUP BY 1")
def decode_validation(spark, d):
    x, k = F.col("item"), F.pmod("position", F.lit(4))
    broken = F.when(k == 1, F.substring(x, 1, 79)).when(k == 2, F.unhex(F.concat(F.lit("09"), F.substring(F.hex(x), F.lit(3), F.length(F.hex(x)))))).when(k == 3, F.substring(x, F.lit(1), F.octet_length(x) - 1)).otherwise(x)
    return _items(spark, d).select(F.coalesce(decode_error(broken), F.lit("ok")).alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM st")
def store_count(spark, d):
    return spark.createDataFrame([(store_of(spark, d).count(),)], "n long")


@query(f"SELECT {SHOWN} FROM st WHERE position = 200")
def point_read(spark, d):
    return store_of(spark, d).point(200).select(_SHOWN)


@query(f"SELECT {SHOWN} FROM st WHERE position >= 120 AND position < 200")
def range_read(spark, d):
    return store_of(spark, d).range(120, 80).select(_SHOWN)


@query(f"SELECT {SHOWN} FROM st WHERE position IN {SCATTERED}")
def scattered_read(spark, d):
    return store_of(spark, d).positions(SCATTERED).select(_SHOWN)


@query(f"SELECT {SHOWN} FROM st WHERE position % 97 = 0")
def scattered_join(spark, d):
    store = store_of(spark, d)
    return store.positions(spark.range(0, store.count(), 97).select(F.col("id").alias("position"))).select(_SHOWN)


@query(f"SELECT {SHOWN} FROM st")
def full_scan(spark, d):
    return store_of(spark, d).scan().select(_SHOWN)


@query(f"SELECT {SHOWN} FROM st WHERE position < 1000")
def first_n(spark, d):
    return store_of(spark, d).first_n(1000).select(_SHOWN)


@query(f"SELECT {SHOWN} FROM st")
def store_write(spark, d):
    return EventStore.write(stored_events(spark, d), new_path(spark, "store")).scan().select(_SHOWN)


@query("SELECT field, key, position FROM po")
def postings(spark, d):
    return postings_of(spark, d)


@query("SELECT field, key, count(DISTINCT position) AS cardinality, min(position) AS min_position, max(position) AS max_position, CAST(sum(position) AS BIGINT) AS sum_position FROM (SELECT DISTINCT * FROM po) GROUP BY field, key")
def index_build(spark, d):
    built = index.build(postings_of(spark, d)).groupBy("field", "key").agg(F.sum("cardinality").alias("cardinality"), F.min(F.array_min("positions")).alias("min_position"), F.max(F.array_max("positions")).alias("max_position"), F.sum(F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x)).alias("sum_position"))
    return built


@query("SELECT position FROM po WHERE field = 3 AND key = '5'")
def lookup_single(spark, d):
    return index_of(spark, d).lookup(3, "5")


@query("SELECT CAST(k.ord AS INTEGER) AS ord, CAST(k.field AS INTEGER) AS field, k.key, count(DISTINCT po.position) AS cardinality FROM (VALUES " + ", ".join(f"({i}, {f}, '{k}')" for i, (f, k) in enumerate(KEYS)) + ") AS k(ord, field, key) LEFT JOIN po ON po.field = k.field AND po.key = k.key GROUP BY k.ord, k.field, k.key")
def lookup_keys(spark, d):
    found = index_of(spark, d).lookup_keys(KEYS)
    return found.groupBy("ord", "field", "key").agg(F.coalesce(F.sum("cardinality"), F.lit(0)).alias("cardinality"))


@query(f"SELECT {SHOWN} FROM st WHERE position IN (SELECT position FROM po WHERE field = 2 AND key = 'purchase')")
def lookup_fetch(spark, d):
    return store_of(spark, d).positions(index_of(spark, d).lookup(*PURCHASE)).select(_SHOWN)


@query("SELECT field, key, count(DISTINCT position) AS n FROM po GROUP BY field, key")
def posting_cardinality(spark, d):
    return index.entries(postings_of(spark, d)).select("field", "key", F.col("cardinality").alias("n"))


@query("SELECT position, position IN (SELECT position FROM po WHERE field = 2 AND key = 'purchase') AS member FROM st")
def membership(spark, d):
    return index.contains(postings_of(spark, d), *PURCHASE, stored_events(spark, d))


@query("SELECT field, count(DISTINCT key) AS distinct_keys FROM po GROUP BY field")
def key_stats(spark, d):
    return index_of(spark, d).statistics().select("field", "distinct_keys")


@query("SELECT key, count(DISTINCT position) AS n FROM po WHERE field = 1 GROUP BY key ORDER BY n DESC, key LIMIT 1")
def dominant_contract(spark, d):
    return index.dominant(postings_of(spark, d), 1)


@query("SELECT field, key, min(position) AS first_position FROM po WHERE position < 50000 GROUP BY field, key")
def sample_keys(spark, d):
    return index.sample_keys(postings_of(spark, d))


@query("SELECT position FROM po WHERE (field = 2 AND key = 'purchase') OR (field = 4 AND key = '3') GROUP BY position HAVING count(DISTINCT field) = 2")
def keys_and(spark, d):
    return index.all_keys(postings_of(spark, d), [PURCHASE, THREE])


@query("SELECT DISTINCT position FROM po WHERE (field = 2 AND key = 'purchase') OR (field = 4 AND key = '3')")
def keys_or(spark, d):
    return index.any_key(postings_of(spark, d), [PURCHASE, THREE])


@query("SELECT DISTINCT position FROM po WHERE field = 2 AND key = 'purchase' AND position NOT IN (SELECT position FROM po WHERE field = 4 AND key = '3')")
def keys_andnot(spark, d):
    return index.without_key(postings_of(spark, d), [PURCHASE], [THREE])


@query("SELECT field, key, count(DISTINCT position) AS n FROM po GROUP BY field, key HAVING count(DISTINCT position) >= 512")
def bitmap_cardinality(spark, d):
    p = postings_of(spark, d)
    frequent = index.entries(p).where("cardinality >= 512").select("field", "key")
    return index.bitmap_cardinality(index.to_bitmaps(p.join(frequent, ["field", "key"], "left_semi")))


@query("SELECT count(*) AS n FROM (SELECT position FROM po WHERE (field = 2 AND key = 'purchase') OR (field = 4 AND key = '3') GROUP BY position HAVING count(DISTINCT field) = 2)")
def bitmap_and(spark, d):
    b = index.to_bitmaps(postings_of(spark, d).where("field in (2, 4)"))
    return index.bitmap_and(b, [PURCHASE, THREE]).agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("n"))


@query("SELECT count(DISTINCT position) AS n FROM po WHERE (field = 2 AND key = 'purchase') OR (field = 4 AND key = '3')")
def bitmap_or(spark, d):
    b = index.to_bitmaps(postings_of(spark, d).where("field in (2, 4)"))
    return index.bitmap_or(b, [PURCHASE, THREE]).agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("n"))


@query("SELECT count(*) AS n, CAST(sum(size) AS BIGINT) AS total_bytes, CAST(sum(size) // count(*) AS BIGINT) AS avg_bytes FROM siz")
def total_raw_bytes(spark, d):
    return layout.totals(_sizes(spark, d))


_RECORDS = ", rec AS (SELECT position // 128 AS rec, count(*) AS n_items, min(size) AS min_size, max(size) AS max_size, CAST(sum(size) AS BIGINT) AS bytes FROM siz GROUP BY 1)"


@query(f"{_RECORDS} SELECT *, CAST(coalesce(sum(bytes) OVER (ORDER BY rec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM rec")
def record_layout(spark, d):
    return layout.offsets(layout.records(_sizes(spark, d)))


@query(f"{_RECORDS} SELECT rec, CAST(greatest(1, length(bin(max_size - min_size))) AS BIGINT) AS width, CAST((greatest(1, length(bin(max_size - min_size))) * n_items + 7) // 8 + 5 AS BIGINT) AS packed_bytes FROM rec")
def for_width(spark, d):
    return layout.for_width(layout.records(_sizes(spark, d)))


_LE = "substr(l, 7, 2) || substr(l, 5, 2) || substr(l, 3, 2) || substr(l, 1, 2)"
_DIGESTS = f", pre AS (SELECT position, lpad(to_hex(size), 8, '0') AS l, hx FROM siz), dig AS (SELECT position // 128 AS chunk, sha256(unhex(string_agg({_LE} || hx, '' ORDER BY position))) AS digest FROM pre GROUP BY 1)"


@query(f"{_DIGESTS} SELECT chunk, digest FROM dig")
def hash_chunks(spark, d):
    return chunk_digests(_items(spark, d))


@query(f"{_DIGESTS} SELECT sha256(unhex(string_agg(digest, '' ORDER BY chunk))) AS hash FROM dig")
def store_hash(spark, d):
    return spark.createDataFrame([(content_hash_value(_items(spark, d)),)], "hash string")


@query("SELECT true AS ok, count(*) AS total_items, (count(*) + 127) // 128 AS record_count FROM st")
def verify_ok(spark, d):
    store = EventStore.write(_items(spark, d), new_path(spark, "hashed"), with_hash=True)
    ok = store.verify()
    return store.trailer().select(F.lit(ok).alias("ok"), "total_items", "record_count")


@query("SELECT successful, type_code, count(*) AS n FROM st GROUP BY 1, 2")
def type_success_counts(spark, d):
    return stored_events(spark, d).groupBy("successful", "type_code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT position FROM st WHERE sec >= epoch(TIMESTAMP '2024-01-05 00:00:00') AND sec < epoch(TIMESTAMP '2024-01-08 00:00:00')")
def time_range(spark, d):
    e = stored_events(spark, d).withColumn("ledger_closed_at", F.timestamp_seconds("sec"))
    return in_time(e, "2024-01-05 00:00:00Z", "2024-01-08 00:00:00Z").select("position")


@query("SELECT sec // 3600 AS hour, type_code AS event_type, count(*) AS n FROM st GROUP BY 1, 2")
def hourly_counts(spark, d):
    e = stored_events(spark, d).select(F.timestamp_seconds("sec").alias("ledger_closed_at"), F.col("type_code").alias("event_type"))
    return windowed_counts(e).select(F.expr("unix_seconds(window.start) DIV 3600").alias("hour"), "event_type", "n")


# CRC32C by a table made from its polynomial
_CRC = """, tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 2197175160 ELSE 0 END))) AS t),
item AS (SELECT position, list_prepend(4294967295, list_transform(range(0, length(hx) // 2), lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT))) AS b FROM enc)"""


@query(f"{_CRC} SELECT position, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc32c FROM item, tab")
def item_checksums(spark, d):
    return _items(spark, d).select("position", crc32c_of("item").alias("crc32c"))


@query()
def compression_ratio(spark, d):
    items, out = _items(spark, d), None
    for n in (32, 64, 128, 256, 512):
        one = layout.compression(items, n)
        out = one if out is None else out.unionByName(one)
    return out


@query(" UNION ALL ".join(f"SELECT {n} AS items_per_record, CAST((count(*) + {n - 1}) // {n} AS BIGINT) AS records, CAST(sum(size) AS BIGINT) AS raw_bytes, true AS smaller FROM siz" for n in (32, 128, 512)))
def compression_totals(spark, d):
    got = [layout.compression(_items(spark, d), n) for n in (32, 128, 512)]
    every = got[0].unionByName(got[1]).unionByName(got[2])
    return every.select("items_per_record", "records", "raw_bytes", (F.col("ratio") > 1).alias("smaller"))


@query("SELECT position, hx AS hex FROM enc")
def packfile_roundtrip(spark, d):
    from eventloom.sources.packfile import register, write_packfile

    path = new_path(spark, "packfile")
    write_packfile(_items(spark, d), path, content_hash=True)
    register(spark)
    return spark.read.format("packfile").load(path).select("position", F.hex("item").alias("hex"))


@query("SELECT position, count(*) AS n_keys FROM po GROUP BY position")
def keys_per_event(spark, d):
    return postings_of(spark, d).groupBy("position").agg(F.count(F.lit(1)).alias("n_keys"))


@query("SELECT CAST(k.ord AS INTEGER) AS ord, CAST(k.field AS INTEGER) AS field, k.key, po.position FROM (VALUES " + ", ".join(f"({i}, {f}, '{k}')" for i, (f, k) in enumerate(KEYS)) + ") AS k(ord, field, key) LEFT JOIN (SELECT DISTINCT * FROM po) AS po ON po.field = k.field AND po.key = k.key")
def lookup_positions(spark, d):
    """Look-up of many keys: every position, null where a key is absent."""
    found = index_of(spark, d).lookup_keys(KEYS)
    return found.select("ord", "field", "key", F.explode_outer("positions").alias("position"))


@query("SELECT true AS ok, count(*) AS rows FROM (SELECT DISTINCT field, key, position // 65536 FROM po)")
def index_verify(spark, d):
    ix = index_of(spark, d)
    return ix.table().agg(F.lit(ix.verify()).alias("ok"), F.count(F.lit(1)).alias("rows"))


@query("SELECT field, key, position FROM po GROUP BY ALL")
def roaring_roundtrip(spark, d):
    back = index.BitmapIndex.deserialised(index_of(spark, d).serialised())
    return back.select("field", "key", F.explode("positions").alias("position"))


@query("""
, ix AS (
  SELECT *, row_number() OVER (PARTITION BY ledger_seq, tx_index, op_index ORDER BY event_id) - 1 AS i, event_id % 13 = 0 AS v0 FROM raw
)
SELECT ledger_seq AS ledger_sequence, tx_index AS transaction_index, op_index AS operation_index, CAST(i AS INTEGER) AS event_index,
  upper(contract_hex) AS contract_hex, CASE WHEN v0 THEN array_to_string(topics, '|') ELSE '' END AS topics, type_code AS event_type,
  CASE WHEN v0 THEN data ELSE '' END AS data, tx_index % 4 <> 0 AS successful, upper(sha256(CAST(tx_index AS VARCHAR))) AS tx_hash
FROM ix WHERE type_code <> 2
""")
def flatten_ledgers(spark, d):
    """Nested ledgers to flat events: diagnostics go but keep their index, bodies of another version are empty."""
    e = flatten_events(ledgers_of(spark, d))
    return e.select(
        "ledger_sequence", "transaction_index", "operation_index", "event_index", F.hex("contract_id").alias("contract_hex"), F.array_join(F.transform("topics", lambda t: F.decode(t, "utf-8")), "|").alias("topics"),
        F.col("event_type").cast("int").alias("event_type"), F.decode("data_bytes", "utf-8").alias("data"), "successful", F.hex("tx_hash").alias("tx_hash"))


@query("SELECT ledger_seq - min(ledger_seq) OVER () AS ledger_ordinal, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS payload FROM raw WHERE ledger_seq < (SELECT min(ledger_seq) + 48 FROM raw) GROUP BY ledger_seq")
def chunk_scan(spark, d):
    """A ledger chunk file of two days' ledgers, read by the source."""
    from eventloom.sources.chunks import write_chunk
    from eventloom.sources.packfile import register

    e = raw_events(spark, d)
    first = e.agg(F.min("ledger_seq")).first()[0]
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
    by = {r.at: r.p for r in e.where(F.col("ledger_seq") < first + 48).groupBy((F.col("ledger_seq") - first).alias("at")).agg(listed.alias("p")).collect()}
    path = new_path(spark, "chunk")
    write_chunk(f"{path}.index", f"{path}.data", [by.get(i, "").encode() for i in range(48)])
    register(spark)
    got = spark.read.format("ledgerchunk").option("index", f"{path}.index").option("data", f"{path}.data").option("ledgersPerPartition", 10).load()
    return got.select("ledger_ordinal", F.decode("payload", "utf-8").alias("payload")).where("payload <> ''")


@query("SELECT position, hx AS hex FROM enc")
def event_cache(spark, d):
    from eventloom.sources import eventcache
    from eventloom.sources.packfile import register

    path = new_path(spark, "eventcache")
    eventcache.save(_items(spark, d), path)
    register(spark)
    return spark.read.format("eventcache").load(path).select("position", F.hex("item").alias("hex"))


@query("SELECT position, hx AS hex FROM enc WHERE position >= 120 AND position < 200")
def packfile_range(spark, d):
    return _packed(spark, d, start=120, count=80)


@query(f"SELECT position, hx AS hex FROM enc WHERE position IN {SCATTERED}")
def packfile_positions(spark, d):
    return _packed(spark, d, positions=",".join(map(str, SCATTERED)))


def _packed(spark: SparkSession, d: str, **options) -> DataFrame:
    from eventloom.sources.packfile import register, write_packfile

    path = new_path(spark, "packfile")
    write_packfile(_items(spark, d), path, content_hash=True)
    register(spark)
    return spark.read.format("packfile").options(**options).load(path).select("position", F.hex("item").alias("hex"))


@query("SELECT position, length(data) AS data_length FROM st")
def for_each(spark, d):
    """A function applied to batches of stored rows."""
    import pyarrow.compute as pc

    def lengths(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("position"), pc.cast(pc.utf8_length(batch.column("data")), pa.int64())], names=["position", "data_length"])

    store = store_of(spark, d)
    return store.for_each(lengths, "position long, data_length long")


GENERATED = sorted({*layout.scattered(500, 20, 3), *layout.consecutive(500, 30, 5), *layout.mixed(500, 2, 10, 5, 7)})


@query(f"SELECT {SHOWN} FROM st WHERE position IN {tuple(GENERATED)}")
def generated_positions(spark, d):
    return store_of(spark, d).positions(GENERATED).select(_SHOWN)


@query("SELECT position, event_id, ledger_seq FROM st")
def streaming_seal(spark, d):
    """The same positions from a stream sealed by micro-batches (one, as the table is one delivery)."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = raw_of(spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")).where("type_code <> 2")
    path = new_path(spark, "sealed")
    seal_stream(stream, f"{path}/out", f"{path}/checkpoint", order_key("ledger_seq", "tx_index", "op_index", "event_index")).awaitTermination()
    return sealed(spark, f"{path}/out").select("position", "event_id", "ledger_seq")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Keys to positions to events: order, index, look up, fetch."""
    return lookup_fetch(spark, d)


__all__ = ["ORACLES", "QUERIES", "flagship"]
