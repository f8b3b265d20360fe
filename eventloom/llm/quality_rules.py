"""Quality rules: repetition coverage of whole texts, with rolling hashes of word n-grams in numpy.

A word is a maximal run of characters other than space and \\t to \\r; a line ends at \\n. For each length n of NGRAMS
the words inside windows equal to an earlier window of the text are marked once, and the share of word characters they
hold is compared with a limit (the limits of the published MassiveText rules). Lines equal to an earlier line count by
number and by characters.

Defined cases: a null or empty text has no word, fails the base rule and is not kept. Rows are decided alone, so ties and
repeated rows need nothing; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_slices, mix64, table

# N-gram lengths and the largest share of characters in repeated ones.
NGRAMS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
TOP_NGRAMS = {2: 0.20, 3: 0.18, 4: 0.16}
MAX_DUP_LINES = 0.30
MAX_DUP_LINE_CHARS = 0.20
SYMBOLS = "#*$%&|<>"
_BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_ngram_chars double, dup_line_chars double, top_ngram_chars double"


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every n consecutive words."""
    out = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
    for i in range(n):
        out = out * _BASE + h[i : i + len(out)]
    return mix64(out)


def cover(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Positions in any window of n that begins at ``starts`` (a mask)."""
    step = np.zeros(size + 1, dtype=np.int64)
    at = np.flatnonzero(starts)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:size]) > 0


def repeated(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masks: in a group of two or more; not the first of its group. And each one's group size."""
    order = np.argsort(w, kind="stable")
    s = w[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    group = np.cumsum(new) - 1
    count = np.bincount(group)
    many, later, size = np.empty(len(w), bool), np.empty(len(w), bool), np.empty(len(w), np.int64)
    size[order] = count[group]
    many[order] = count[group] > 1
    later[order] = ~new
    return many, later, size


def measure(text: str | None) -> dict:
    t = text or ""
    raw = t.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(t) - sum(map(t.count, " \t\n\v\f\r"))
    seen: set[str] = set()
    dup_lines = dup_line_chars = lines = 0
    for line in t.split("\n"):
        if line in seen:
            dup_lines += 1
            dup_line_chars += len(line)
        elif line.strip(" \t\n\v\f\r"):
            seen.add(line)
            lines += 1
    h = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    repeat = 0
    share, top = dict.fromkeys(NGRAMS, 0.0), dict.fromkeys(TOP_NGRAMS, 0.0)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    whole = max(1, int(sizes.sum()))

    def most(k: int) -> float:
        _, _, size = repeated(w := windows(h, k))
        i = int(size.argmax())
        return float(sizes[cover(w == w[i], k, n)].sum()) / whole if size[i] > 1 else 0.0

    if n >= 2:
        top[2] = most(2)  # two words can repeat where no three do
    if n >= 3:
        many, _, _ = repeated(windows(h, 3))
        if many.any():
            repeat = int(cover(many, 3, n).sum())
            for k in NGRAMS:
                if n >= k:
                    _, later, _ = repeated(windows(h, k))
                    if not later.any():
                        break  # longer n-grams don't repeat either
                    share[k] = float(sizes[cover(later, k, n)].sum()) / whole
            for k in TOP_NGRAMS:
                if 2 < k <= n:
                    top[k] = most(k)
    failed = n < 50 or 100 * repeat > 50 * n
    line_share = dup_line_chars / max(1, len(t))
    ok = all(share[k] <= m for k, m in NGRAMS.items()) and all(top[k] <= m for k, m in TOP_NGRAMS.items()) and dup_lines <= MAX_DUP_LINES * (lines + dup_lines) and line_share <= MAX_DUP_LINE_CHARS
    return {"n_words": n, "word_chars": chars, "n_symbols": sum(map(t.count, SYMBOLS)), "n_dup_lines": dup_lines, "n_repeat_words": repeat, "base_failed": failed, "kept": ok and not failed, "dup_ngram_chars": max(share.values()), "dup_line_chars": line_share, "top_ngram_chars": max(top.values())}


def _batch(cols: dict[str, list]) -> dict[str, list]:
    got = [measure(t) for t in cols["text"]]
    return {"doc_id": cols["doc_id"]} | {k: [g[k] for g in got] for k in got[0]}


def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to the measures and verdicts of SCHEMA."""
    return map_slices(docs.select("doc_id", "text"), _batch, SCHEMA)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
