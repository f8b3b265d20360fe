"""What the corpus operators share: batched maps over texts, word splitting and hashing, bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventloom.scratch import cut, discard, new_path, root

__all__ = ["BASE", "SLICE", "bounded", "codes", "cut", "discard", "distinct", "drop", "excerpt", "fold", "free_name", "has_letter", "keep_where", "labelled_sample", "lower_ascii", "map_slices", "maybe_among", "mix64", "named", "new_path", "root", "table", "word_hashes", "words_of"]

#: Rows that a Python map holds as Python objects at a time.
SLICE = 256
#: Bytes of a batch on its way to a Python worker. Spark's own 64 MB stand in the JVM, twice while a buffer grows, and in the
#: worker, for every core.
BATCH_BYTES = 8 << 20
#: Multiplier of the polynomial hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its plain name, with dots, blanks or quotes in it or not."""
    return F.col("`" + column.replace("`", "``") + "`")


def free_name(wanted: str, *taken: list[str]) -> str:
    """``wanted``, or with underscores behind it, such that no column is called so (Spark ignores case)."""
    used = {c.lower() for names in taken for c in names}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once everything that reads them is written too."""
    for df in tables:
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            discard(df.sparkSession, path)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session sends batches of BATCH_BYTES at most to Python unless its settings name another size."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def map_slices(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list] | None], schema: str | StructType, setup: Callable[[], object] | None = None) -> DataFrame:
    """Apply ``fn`` to column lists of at most SLICE rows; it returns column lists in the order of ``schema``.

    ``setup`` runs once in each task, its result is passed as the second argument.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    out = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                cols = {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}
                got = fn(cols, state) if setup else fn(cols)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return bounded(df).mapInArrow(run, kind)


def keep_where(df: DataFrame, column: str, good: Callable[[list], list[bool]]) -> DataFrame:
    """The rows of ``df`` whose value of ``column`` is ``good``. Other columns, whatever their names and types, pass as they are."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                kept = part.filter(pa.array(good(part.column(at).to_pylist()), pa.bool_()))
                yield pa.RecordBatch.from_arrays(kept.columns, names=names)

    names = df.columns
    # numbered meanwhile: a name with a dot can't be asked for
    return bounded(df).toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, df.schema)


#: Bits of ``maybe_among``, whatever the data's size.
FILTER_BITS = 1 << 24
#: Longs in one row of the filter. Wide rows keep the broadcast small: 16,384 rows of 16 longs, some 3 MB, at most.
FILTER_LONGS = 16


def maybe_among(df: DataFrame, key: Column, keys: DataFrame, flag: str) -> DataFrame:
    """``df`` with a boolean column ``flag``: false where ``key`` (a hash, long) is certainly none of the one column of
    ``keys``. Rows that are none needn't be shuffled to a join with them. With more keys than bits it says true to all,
    which costs the shuffle that it saves otherwise and changes no result."""
    width = (64 * FILTER_LONGS).bit_length() - 1
    row, here = (free_name(c, df.columns) for c in ("row", "at"))
    longs = [free_name(f"bits{i}", df.columns) for i in range(FILTER_LONGS)]
    nth = lambda at: F.shiftright(at, 6).bitwiseAND(F.lit(FILTER_LONGS - 1)).cast("int")
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    spots = keys.select(F.pmod(F.col(keys.columns[0]), F.lit(FILTER_BITS)).alias("at"))
    rows = spots.groupBy(F.shiftright("at", width).alias(row)).agg(*(F.bit_or(F.when(nth("at") == i, bit).otherwise(F.expr("0L"))).alias(c) for i, c in enumerate(longs)))
    rows = cut(rows, "filter")
    got = df.withColumn(here, F.pmod(key, F.lit(FILTER_BITS)))
    got = got.join(F.broadcast(rows), F.shiftright(here, width) == F.col(row), "left")
    hit = F.getbit(F.get(F.array(*map(F.col, longs)), nth(here)), F.col(here).bitwiseAND(F.lit(63)).cast("int")) == 1
    return got.select(*(named(c) for c in df.columns), F.coalesce(hit, F.lit(False)).alias(flag))


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than space and \\t to \\r, as UTF-8. bytes.split() splits at exactly these."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_ascii(raw: bytes) -> bytes:
    """A-Z to a-z, nothing else."""
    return raw.translate(_LOWER)


def codes(text: str) -> np.ndarray:
    """Code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values, ascending."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


_GAP = np.zeros(256, dtype=bool)
_GAP[[32, *range(9, 14)]] = True


def word_hashes(raw: bytes, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word of ``raw`` (as ``raw.split()`` has them): a polynomial of its bytes, mixed.

    Blocks end between words, so memory follows ``block`` and the longest word, not the text.
    """
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + block)
        while end < len(raw) and not _GAP[raw[end]]:  # on to the end of the word
            end += 1
        c = np.frombuffer(raw, dtype=np.uint8, count=end - at, offset=at)
        at = end
        inside = ~_GAP[c]
        step = np.diff(inside.view(np.int8), prepend=0, append=0)
        first, size = np.flatnonzero(step == 1), 0
        size = np.flatnonzero(step == -1) - first
        if not len(first):
            continue
        power = np.multiply.accumulate(np.full(int(size.max()), BASE, dtype=np.uint64))
        starts = np.cumsum(size) - size
        within = np.arange(int(size.sum())) - np.repeat(starts, size)
        terms = (c[inside].astype(np.uint64) + np.uint64(1)) * power[within]
        out.append(mix64(np.add.reduceat(terms, starts) + size.astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def fold(key: str, mod: int) -> Column:
    """crc32(doc_id as text) mod ``mod``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % mod, F.lit(0))


def excerpt(text: str, most: int, pieces: int = 8) -> Column:
    """The text, or if it has over ``most`` characters, ``pieces`` parts of it at equal distances, ``most`` characters together."""
    each = most // pieces
    step = (F.char_length(text) - each) / (pieces - 1)
    parts = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(F.col(text), (i * step).cast("int") + 1, F.lit(each)))
    return F.when(F.char_length(text) > most, F.array_join(parts, " ")).otherwise(F.col(text))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int, max_chars: int) -> list[tuple[str, int]]:
    """At most ``rows`` labelled texts for training, in the order of a hash of the id; of texts longer than ``max_chars``
    characters an ``excerpt``.

    ``keep`` is a condition on doc_id. Only ids are ordered and limited first; their texts come by a broadcast of these
    ``rows`` ids, and since ids may repeat the rows are limited once more.
    """
    own = free_name("label", docs.columns)
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & keep)
        .groupBy("doc_id").agg(F.max(label).cast("int").alias(own))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
    got = found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(rows).select("doc_id", excerpt("text", max_chars), own)
    return [(r[1], r[2]) for r in got.collect()]


def has_letter(text: str | None) -> bool:
    """Whether a character of ``text`` is a letter (Unicode category L): not a digit, a fraction or a Roman numeral sign."""
    return bool(text) and any(map(str.isalpha, text))
