"""The driver's ``events`` table seen as a log of contract events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.model import TX_LEVEL, EventType
from eventloom.operators import index
from eventloom.operators.ordering import assign_positions, order_key
from eventloom.operators.store import EventStore
from eventloom.scratch import cut, new_path

_KEPT: dict[tuple, object] = {}


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events with text keys, diagnostics included."""
    return raw_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def raw_of(events: DataFrame) -> DataFrame:
    """The same of a batch or a stream of rows of the ``events`` table."""
    e = events.withColumn("sec", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))
    topics = F.slice(F.array("event_type", F.get_json_object("props", "$.k"), F.pmod("user_id", F.lit(7)).cast("string"), F.pmod("event_id", F.lit(11)).cast("string"), F.lit("x"), F.lit("y")), F.lit(1), F.pmod("event_id", F.lit(7)).cast("int"))
    return e.select(
        "event_id", F.expr("sec DIV 3600").alias("ledger_seq"), F.col("user_id").alias("tx_index"),
        F.when(F.pmod("event_id", F.lit(5)) == 0, F.lit(TX_LEVEL)).otherwise(F.pmod("event_id", F.lit(3))).cast("int").alias("op_index"),
        F.col("event_id").alias("event_index"),
        F.when(F.col("event_type") == "signup", F.lit(0)).when(F.col("event_type") == "error", F.lit(2)).otherwise(F.lit(1)).alias("type_code"),
        F.when(F.pmod("user_id", F.lit(10)) != 0, F.sha2(F.col("user_id").cast("string"), 256)).alias("contract_hex"),
        topics.alias("topics"), F.col("props").alias("data"), (F.pmod("event_id", F.lit(4)) != 0).alias("successful"), "sec")


def _once(spark: SparkSession, sf_dir: str, name: str, make):
    """Tables that many queries read are written once a session, and again when the input's files have changed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    seen = tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))
    key = (spark.sparkContext.applicationId, seen, name)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without diagnostics, with dense positions, sorted by position."""

    def make() -> DataFrame:
        kept = raw_events(spark, sf_dir).where(F.col("type_code") != int(EventType.DIAGNOSTIC))
        return cut(assign_positions(kept, order_key("ledger_seq", "tx_index", "op_index", "event_index")), "stored")

    return _once(spark, sf_dir, "stored", make)


def store_of(spark: SparkSession, sf_dir: str) -> EventStore:
    """The stored events as a sealed store."""
    return _once(spark, sf_dir, "store", lambda: EventStore.write(stored_events(spark, sf_dir), new_path(spark, "store")))


def index_of(spark: SparkSession, sf_dir: str) -> index.BitmapIndex:
    """Their index on disk."""
    return _once(spark, sf_dir, "index", lambda: index.BitmapIndex.write(postings_of(spark, sf_dir), new_path(spark, "index")))


def ledgers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw events nested: a ledger for each hour, a transaction for each user, three operations in each.

    Transactions succeed or fail as a whole here: those of users divisible by four fail.
    """
    e = raw_events(spark, sf_dir).select(
        F.col("ledger_seq").alias("ledger_sequence"), "tx_index", "op_index", "event_id",
        F.struct(F.unhex("contract_hex").alias("contract_id"), F.col("type_code").cast("tinyint").alias("type"), F.pmod("event_id", F.lit(13)).cast("int").alias("body_version"),
                 F.transform("topics", lambda t: F.encode(t, "utf-8")).alias("topics"), F.encode("data", "utf-8").alias("data")).alias("e"))
    # one group is one transaction, then one ledger, as in the files that these stand for
    listed = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("event_id", "e")))), lambda s: s["e"])
    tx = e.groupBy("ledger_sequence", "tx_index").agg(
        listed(F.col("op_index") == TX_LEVEL).alias("events"), *[listed(F.col("op_index") == i).alias(f"op{i}") for i in range(3)])
    one = F.struct(F.col("tx_index"), F.unhex(F.sha2(F.col("tx_index").cast("string"), 256)).alias("hash"), (F.pmod("tx_index", F.lit(4)) != 0).alias("successful"),
                   F.col("events"), F.array(*[F.struct(F.col(f"op{i}").alias("events")) for i in range(3)]).alias("operations"))
    return tx.groupBy("ledger_sequence").agg(F.array_sort(F.collect_list(one), lambda a, b: (a["tx_index"] - b["tx_index"]).cast("int")).alias("transactions")).select(
        "ledger_sequence", F.timestamp_seconds(F.col("ledger_sequence") * 3600).alias("closed_at"), "transactions")


def postings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(stored_events(spark, sf_dir), "contract_hex", "topics")


def typed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as STORED_EVENT columns, for the codec."""
    return stored_events(spark, sf_dir).select(
        "position", F.unhex("contract_hex").alias("contract_id"), F.transform("topics", lambda t: F.encode(t, "utf-8")).alias("topics"),
        F.unhex(F.sha2(F.col("event_id").cast("string"), 256)).alias("tx_hash"), F.col("type_code").alias("event_type"),
        F.encode("data", "utf-8").alias("data_bytes"), F.timestamp_seconds("sec").alias("ledger_closed_at"), "successful")


# The same in SQL.
CTE = f"""
WITH raw AS (
  SELECT event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS sec, CAST(epoch_us(ts) // 1000000 // 3600 AS BIGINT) AS ledger_seq, user_id AS tx_index,
    CAST(CASE WHEN event_id % 5 = 0 THEN {TX_LEVEL} ELSE event_id % 3 END AS INTEGER) AS op_index, event_id AS event_index,
    CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN 2 ELSE 1 END AS type_code,
    CASE WHEN user_id % 10 <> 0 THEN sha256(CAST(user_id AS VARCHAR)) END AS contract_hex,
    ([event_type, json_extract_string(props, '$.k'), CAST(user_id % 7 AS VARCHAR), CAST(event_id % 11 AS VARCHAR), 'x', 'y'])[1 : event_id % 7] AS topics,
    props AS data, event_id % 4 <> 0 AS successful
  FROM events
),
st AS (
  SELECT *, row_number() OVER (ORDER BY ledger_seq, tx_index, CASE WHEN op_index = {TX_LEVEL} THEN -1 ELSE op_index END, event_index) - 1 AS position
  FROM raw WHERE type_code <> 2
),
po AS (
  SELECT 1 AS field, contract_hex AS key, position FROM st WHERE contract_hex IS NOT NULL
  UNION ALL
  SELECT CAST(i + 1 AS INTEGER) AS field, topics[i] AS key, position FROM (SELECT topics, position, unnest(range(1, least(len(topics), 4) + 1)) AS i FROM st)
),
enc AS (
  SELECT position, concat('02', upper(lpad(to_hex(type_code), 2, '0')), upper(lpad(to_hex(CAST(contract_hex IS NOT NULL AS INTEGER) + 2 * CAST(successful AS INTEGER)), 2, '0')),
    upper(lpad(to_hex(len(topics)), 2, '0')), upper(coalesce(contract_hex, repeat('0', 64))), upper(sha256(CAST(event_id AS VARCHAR))),
    upper(lpad(to_hex(sec), 16, '0')), upper(lpad(to_hex(octet_length(encode(data))), 8, '0')),
    array_to_string(list_transform(topics, lambda t: concat(upper(lpad(to_hex(octet_length(encode(t))), 4, '0')), hex(t))), ''), hex(data)) AS hx
  FROM st
),
siz AS (SELECT position, CAST(length(hx) // 2 AS BIGINT) AS size, hx FROM enc)
"""
