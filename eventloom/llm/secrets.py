"""Secret scans over an incremental blob ledger.

Every version of a file is content-addressed (SHA-256 of its text). The ledger, a folder of Parquet files, has one row for
each (blob, rule version) that was scanned, with the findings. The rule version is a digest of the rules themselves, so a
changed rule scans everything anew. A delivery of versions scans only pairs that the ledger lacks, once for each blob
however many paths and versions hold it, appends what it found, and joins findings back to every path. The registered
query takes the table as two deliveries through one ledger, by the id's parity: blobs of the first are not scanned in the
second.

Spans are in code points of the whole text, end exclusive. Defined cases: a null text counts as empty and has no finding;
an empty delivery adds nothing; repeated rows each get their row back; a null key is a key like any other; findings that
begin at one place are listed by kind; columns other than key and text, whatever their names, are ignored. A delivery that
is repeated, or whose ledger append failed halfway, changes no result: rows of one blob and rule version are equal.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_slices, new_path, table

# Kinds in the order in which equal starts are listed, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs are maximal, so asking for 16 at once finds what dropping shorter runs leaves.
_HEX = re.compile(r"[0-9a-f]{16,}")

LEAST = (12, 18, 16)
#: What was scanned for: a change of any rule changes it.
RULE_VERSION = hashlib.sha256(repr((KINDS, _ASSIGN.pattern, _ASSIGN.flags, _ACCESS.pattern, _HEX.pattern, LEAST)).encode()).hexdigest()[:16]

LEDGER_SCHEMA = "blob binary, rule_version string, n_assign long, n_access long, n_hex long, spans string"


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules in a whole text, ordered by start, then kind."""
    if not text:
        return []
    got = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST[0]]
    got += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST[1]]
    got += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(got)


def _scan(cols: dict[str, list]) -> dict[str, list]:
    found = [find_spans(t) for t in cols["text"]]
    out: dict[str, list] = {"blob": cols["blob"], "rule_version": [RULE_VERSION] * len(found)}
    for k, kind in enumerate(KINDS):
        out[f"n_{kind}"] = [sum(s[1] == k for s in x) for x in found]
    out["spans"] = [",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in x) for x in found]
    return out


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings of every row of ``versions``, new ledger rows). Append the latter to the ledger after the run."""
    body = F.coalesce(F.col(text), F.lit(""))
    named = versions.select(F.col(key).alias("key"), body.alias("text")).withColumn("blob", F.unhex(F.sha2(F.col("text"), 256)))
    addressed = cut(named.select("key", "blob"), "blobs")
    todo = addressed.groupBy("blob").agg(F.min("key").alias("key"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == RULE_VERSION)
        todo = todo.join(seen.select("blob"), "blob", "left_anti")
    # One row holds a blob for all; its text moves once, under a key that no hot blob shares.
    rep = todo.withColumnRenamed("blob", "b").withColumnRenamed("key", "k")
    holder = named.join(rep, named["key"].eqNullSafe(rep["k"]) & (named["blob"] == rep["b"]), "left_semi")
    fresh = cut(map_slices(holder.select("blob", "text"), _scan, LEDGER_SCHEMA).dropDuplicates(["blob"]), "findings")
    known = fresh if ledger is None else fresh.unionByName(seen.select(*fresh.columns))
    # Blobs without a finding need not travel to the paths.
    hits = known.where("spans <> ''").drop("rule_version").withColumnRenamed("blob", "b")
    out = addressed.join(hits, F.col("blob") == F.col("b"), "left").select(
        F.col("key").alias(key), "blob", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.coalesce("spans", F.lit("")).alias("spans"))
    return out, fresh


class Ledger:
    """A ledger on disk; ``path`` is a folder that Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(self.path).dropDuplicates(["blob", "rule_version"])

    def deliver(self, versions: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Findings of every row of ``versions``; what was scanned for them is in the ledger afterwards."""
        out, fresh = scan_versions(versions, self.rows(), key, text)
        fresh.write.mode("append").parquet(self.path)
        return out


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = table(spark, sf_dir, "documents").select("doc_id", "text"), Ledger(spark, new_path(spark, "ledger"))
    even = F.coalesce(F.pmod("doc_id", F.lit(2)) == 0, F.lit(True))
    out = ledger.deliver(docs.where(even)).unionByName(ledger.deliver(docs.where(~even)))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("spans", 256).alias("base_sha256"), "spans", F.lower(F.hex("blob")).alias("blob"))
