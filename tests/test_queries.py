"""Every registered base query against its SQL, and two micro-batches against one batch."""

import glob
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from eventloom.operators.ordering import order_key
from eventloom.plans import adapter, catalogue
from eventloom.streaming.seal import seal_stream, sealed

ROOT = str(Path(__file__).resolve().parent.parent)
DATA = "/root/testdata/sf0.001"


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(v, 6) if isinstance(v := r[i], float) else v for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = plain(df.collect(), df.columns)
    assert got or name == "bitmap_cardinality"  # no key is that frequent in the smallest data
    if name in catalogue.ORACLES:
        cur = duck.execute(catalogue.ORACLES[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert got == plain(cur.fetchall(), names)


def test_entry_without_corpus_operators(tmp_path):
    """With an llm package that fails to import, the base queries stay."""
    code = "import sys; sys.modules['eventloom.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    got = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert got.stdout.split() == [str(len(catalogue.QUERIES)), str(len(catalogue.ORACLES))]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_changed_input_is_read_again(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.limit(50).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    few = catalogue.QUERIES["store_count"](spark, str(tmp_path)).first()[0]
    events.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
    assert few < catalogue.QUERIES["store_count"](spark, str(tmp_path)).first()[0] == catalogue.QUERIES["store_count"](spark, DATA).first()[0]


def test_stream_seals_like_a_batch(spark, tmp_path):
    key = order_key("ledger_seq", "tx_index", "op_index", "event_index")
    raw = adapter.raw_events(spark, DATA).where("type_code <> 2")
    cutoff = raw.agg(F.percentile("ledger_seq", 0.5)).first()[0]
    source = str(tmp_path / "in")
    for i, part in enumerate((raw.where(F.col("ledger_seq") <= cutoff), raw.where(F.col("ledger_seq") > cutoff))):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(raw.schema).parquet(source)
        seal_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), key).awaitTermination(120)
        assert (tmp_path / "out" / f"batch={i:012d}").exists()
    got = [tuple(r) for r in sealed(spark, str(tmp_path / "out")).orderBy("position").select("position", "event_id").collect()]
    want = [tuple(r) for r in catalogue.QUERIES["assign_positions"](spark, DATA).orderBy("position").select("position", "event_id").collect()]
    assert got == want
