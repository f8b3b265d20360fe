"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's documents.

Stages take (spark, docs, sf_dir). All but the last return the columns of ``documents``, with n_chars brought up to date.
A document whose every line line dedup removed goes with them; an empty or null text stays until near-dedup, where texts
without a word are one group.

Defined cases: every stage takes and gives empty tables, and passes other columns whatever their names. Null and repeated
ids are rows like any other: the classifier and decontamination decide each row by its text alone, line dedup lets rows
equal in id and text decide alike, near-dedup keeps one row of each group of texts, so that different texts under one id
stay apart. Ties fall to the smaller id, then to the text's hash. Very long texts are taken whole. The last stage returns
doc_id, ids, n_pieces and round_trip for each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import decontaminate, line_dedup, pieces, quality_pu, simhash
from eventloom.llm.common import named, table
from eventloom.scratch import new_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_pu.keep_good(docs, quality_pu.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(docs, pairs=True)
    out = out.where(~F.coalesce((F.col("n_removed") > 0) & (F.length(F.trim(F.regexp_replace("text", r"\s", " "))) == 0), F.lit(False)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*map(named, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, size=5, min_similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding", sentencepiece_encoding),
]
#: The classifier and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    docs, at = table(spark, sf_dir, "documents"), new_path(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
    return docs
