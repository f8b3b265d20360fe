"""Line dedup: repeated windows of three consecutive lines are found over the whole corpus and later copies removed.

A text is cut at ``\\n``. Every window of three consecutive lines is hashed to 128 bits, as is every single line of more
than ``long_line_words`` words (a passage on one line has no window of its own). Windows are grouped over the corpus; the
occurrence with the smallest (doc_id, position) is the first. Each later one covers its positions, except those that the
first occurrence of the same window covers itself; covered positions are merged and their lines removed.

A text of one or two lines has one window, all its lines, if these have ``min_words`` words or more. Windows without a
letter or digit are not compared (blank lines). With ``pairs``, every two consecutive lines that hold more than
``long_line_words`` words together are hashed too, and cover their lines like a long line. The registered query leaves
them out, as its SQL does; the pipeline's stage has them.

Defined cases: an empty table gives an empty one; a null text stays null with 0 lines; an empty text is one blank line and
stays; ties (equal doc_id in repeated rows) are broken by the row's content hash, and rows equal in both get the same
decision, that of the first: what it keeps they all keep. A null doc_id counts as smaller than any other. Other columns
pass through unchanged, whatever their names; columns called n_lines, n_removed or removed are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, named, table

WINDOW = 3


_GAP, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once. Named in a lambda directly it would be once for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _has_words(x: Column, n: int) -> Column:
    """Whether x has n words or more; reads no further than these."""
    return x.rlike(f"^{_GAP}*+(?:{_WORD}++{_GAP}++){{{n - 1}}}{_WORD}")


def _windows(lines: Column, long_line_words: int, min_words: int, pairs: bool) -> Column:
    """array<struct<p, n, h1, h2>> of the windows of an array of lines."""
    n = F.size(lines)
    size = F.least(n, F.lit(WINDOW))

    def hashed(at: Column, length: Column, body: Column) -> Column:
        return F.struct(at.alias("p"), length.alias("n"), F.xxhash64(body, length).alias("h1"), F.xxhash64(F.lit(7), length, body).alias("h2"))

    def three(i: Column) -> Column:
        def keep(body: Column) -> Column:
            good = body.rlike(r"[\p{L}\p{N}]") & ((n >= WINDOW) | _has_words(body, min_words))
            return F.when(good, hashed(i, size, body))

        return _let(F.array_join(F.slice(lines, i + 1, size), "\n"), keep)

    threes = F.transform(F.sequence(F.lit(0), n - size), three)
    enough = 2 * (long_line_words + 1) - 1  # characters of so many words
    longs = F.transform(lines, lambda x, i: F.when((n > 1) & (F.length(x) >= enough) & _has_words(x, long_line_words + 1), hashed(i, F.lit(1), x)))
    # a text of one line has that one window
    kinds = [threes, longs]
    if pairs:

        def two(i: Column) -> Column:
            keep = lambda body: F.when((F.length(body) >= enough) & _has_words(body, long_line_words + 1), hashed(i, F.lit(2), body))
            return _let(F.array_join(F.slice(lines, i + 1, 2), "\n"), keep)

        # a text of two lines has that one window
        kinds.append(F.when(n > 2, F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), two)).otherwise(F.array()))
    return F.filter(F.concat(*kinds), lambda w: w.isNotNull())


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", long_line_words: int = 50, min_words: int = 13, pairs: bool = False) -> DataFrame:
    """``docs`` with ``text`` cleaned, and the columns n_lines, n_removed (long) and removed (array of line positions)."""
    body, own = named(text), named(key)
    lines = F.split(body, "\n", -1)
    # A row is told apart by its key and the hash of its text: equal rows decide alike.
    rid = F.xxhash64(body)
    occ = (
        docs.where(body.isNotNull())
        .select(own.alias("k"), rid.alias("r"), F.explode(_let(lines, lambda x: _windows(x, long_line_words, min_words, pairs))).alias("w"))
        .select("k", "r", F.col("w.p").alias("p"), F.col("w.n").alias("n"), F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"))
    )
    first = (
        occ.groupBy("h1", "h2", "n")
        .agg(F.min(F.struct("k", "r", "p")).alias("first"), F.count(F.lit(1)).alias("c"))
        .where("c > 1").select("h1", "h2", "n", "first")
    )
    same = F.col("k").eqNullSafe(F.col("first.k")) & (F.col("r") == F.col("first.r"))
    start = F.when(same, F.greatest(F.col("p"), F.col("first.p") + F.col("n"))).otherwise(F.col("p"))
    k, r, gone, mine = (free_name(x, docs.columns) for x in ("k", "r", "gone", "row"))
    # a set: equal rows bring equal spans, which collapse before the shuffle
    covered = (
        occ.join(first, ["h1", "h2", "n"])
        .withColumn("s", start).withColumn("e", F.col("p") + F.col("n")).where("s < e")
        .groupBy(F.col("k").alias(k), F.col("r").alias(r)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("s"), F.col("e") - 1))))).alias(gone))
    )
    out = docs.withColumn(mine, rid)
    out = out.join(covered, own.eqNullSafe(F.col(k)) & (F.col(mine) == F.col(r)), "left")
    kept = _let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone)), lambda i: F.get(x, i)), "\n"))
    cleaned = F.when(F.col(gone).isNull(), body).otherwise(kept)
    fresh = {
        "n_lines": F.when(body.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"),
        "n_removed": F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long"),
        "removed": F.coalesce(F.col(gone), F.array().cast("array<int>")),
    }
    rest = [named(c) for c in docs.columns if c not in (*fresh, text)]
    return out.select(*rest, cleaned.alias(text), *[c.alias(n) for n, c in fresh.items()])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed_lines"), "text")


ORACLE_OP1 = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, p, least(len(l), 3) AS n, array_to_string(l[p + 1 : p + least(len(l), 3)], chr(10)) AS b, len(l) AS nl
  FROM (SELECT doc_id, l, unnest(range(0, len(l) - least(len(l), 3) + 1)) AS p FROM d)
),
o AS (
  SELECT doc_id, p, n, b FROM w WHERE regexp_matches(b, '[\p{L}\p{N}]')
    AND (nl >= 3 OR len(regexp_extract_all(b, '[^\x20\x09-\x0D]+')) >= 13)
  UNION
  SELECT doc_id, p, 1 AS n, l[p + 1] AS b FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS p FROM d)
  WHERE len(regexp_extract_all(l[p + 1], '[^\x20\x09-\x0D]+')) > 50
),
f AS (
  SELECT *, count(*) OVER (PARTITION BY n, b) AS c,
    first_value(doc_id) OVER (PARTITION BY n, b ORDER BY doc_id, p) AS fd,
    first_value(p) OVER (PARTITION BY n, b ORDER BY doc_id, p) AS fp
  FROM o
),
cov AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = fd THEN greatest(p, fp + n) ELSE p END, p + n)) AS pos
  FROM f WHERE c > 1
),
ln AS (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS x FROM d),
r AS (
  SELECT ln.doc_id, count(*) AS n_lines, count(cov.pos) AS n_removed,
    coalesce(string_agg(CAST(cov.pos AS VARCHAR), ',' ORDER BY cov.pos), '') AS removed_lines,
    coalesce(string_agg(x, chr(10) ORDER BY ln.pos) FILTER (WHERE cov.pos IS NULL), '') AS text
  FROM ln LEFT JOIN cov ON cov.doc_id = ln.doc_id AND cov.pos = ln.pos GROUP BY ln.doc_id
)
SELECT d.doc_id, CAST(coalesce(r.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(r.removed_lines, '') AS removed_lines, CASE WHEN d.text IS NULL THEN NULL ELSE r.text END AS text
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""
