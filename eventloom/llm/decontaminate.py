"""Benchmark decontamination by the q-gram lemma, verified by banded alignment.

Texts are lower-cased and runs of white space become one space. A benchmark item is cut into overlapping segments of
SEGMENT characters, half a segment apart (the last one ends with the item; a shorter item is one segment). A segment of m
characters matches a region of a text within k = RATE * m edits. Such a region shares at least m + 1 - q - k q of the
segment's q-grams with it, on diagonals at most k apart, so hits are counted in bands of 2 (k + 1) diagonals that overlap
by half: one of them holds all. Bands that reach the bound are verified by an alignment within their diagonals.

Short items: under MIN_CHARS characters that bound, or the item's weight as evidence, runs out. Items of Q characters or
more are then found without an edit and between characters that are no letters or digits; items of fewer characters
only where they are a whole text (a bare "yes" or "42" would else flag most of a corpus).

Bounded memory: a text is taken in slices that overlap by more than a segment, and counted hits are held to HITS at a time
by halving first the slice, then the set of segments. Segments of equal text are one. The benchmark is a stated query
set: it is read in blocks of at most ``block_bytes``, each broadcast in a pass of its own over all texts.

Defined cases: null and empty texts and items match nothing; equal items and repeated rows are found each; an empty table
of texts or items gives no row (``keep_clean``: every row); other columns, whatever their names, pass through
(``keep_clean``) or are ignored (``find_leaks``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, codes, keep_where, map_slices, mix64, table

Q = 8
SEGMENT = 80
RATE = 0.08
MIN_CHARS = 24
BLOCK_BYTES = 4 << 20
#: Characters of a text that are looked at together, and the fewest.
SLICE_CHARS = 1 << 16
LEAST_CHARS = 1 << 10
#: What neighbouring slices share: a region that matches a segment, with the bands around it.
OVERLAP = 3 * SEGMENT
#: (text position, segment position) pairs of equal q-grams held at a time.
HITS = 1 << 20


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def grams(c: np.ndarray) -> np.ndarray:
    n = max(0, len(c) - Q + 1)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(Q):
        h = h * BASE + c[i : i + n]
    return mix64(h)


def banded(seg: str, region: str, k: int) -> int | None:
    """Fewest edits that turn ``seg`` into some substring of ``region``, if at most k. Rows stay within the cells of cost k."""
    if seg in region:
        return 0
    inf = k + 1
    row = [0] * (len(region) + 1)  # the match may begin anywhere
    lo, hi = 0, len(region)
    for i, x in enumerate(seg, 1):
        new = [inf] * (len(region) + 1)
        first = last = None
        for j in range(lo, len(region) + 1):
            best = row[j] + 1
            if j:
                best = min(best, new[j - 1] + 1, row[j - 1] + (x != region[j - 1]))
            if best <= k:
                new[j] = best
                first, last = (j if first is None else first), j
            elif j > hi:
                break
        if first is None:
            return None
        row, lo, hi = new, first, last
    best = min(row[lo : hi + 1])
    return best if best <= k else None


def _apart(text: str, at: int, end: int) -> bool:
    """No letter or digit goes on over either end."""
    return not (at and text[at - 1].isalnum() and text[at].isalnum()) and not (end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


class Segments:
    """The q-gram table of distinct segments: ``items`` has the items of each."""

    def __init__(self, text: list[str], items: list[list[int | None]], whole: dict[str, list[int | None]]):
        self.text, self.items, self.whole = text, items, whole
        size = np.array(list(map(len, text)), dtype=np.int64)
        self.k = np.where(size < MIN_CHARS, 0, (RATE * size).astype(np.int64))
        self.need = np.maximum(1, size + 1 - Q - self.k * Q)
        g = [grams(codes(s)) for s in text]
        h = np.concatenate(g) if g else np.zeros(0, np.uint64)
        seg = np.repeat(np.arange(len(g), dtype=np.int32), [len(x) for x in g]) if g else np.zeros(0, np.int32)
        pos = np.concatenate([np.arange(len(x), dtype=np.int32) for x in g]) if g else np.zeros(0, np.int32)
        order = np.argsort(h, kind="stable")
        self.seg, self.pos = seg[order], pos[order]
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.verified: dict[tuple[int, str], int | None] = {}
        self._halves: list[tuple[Segments, int]] | None = None

    @classmethod
    def of(cls, items: list[tuple[int | None, str | None]]) -> Segments:
        where: dict[str, list] = {}
        whole: dict[str, list] = {}
        for item, raw in items:
            t = normal(raw)
            if len(t) < Q:
                if t:
                    whole.setdefault(t, []).append(item)
                continue
            for e in [*range(SEGMENT, len(t), SEGMENT // 2), len(t)]:
                where.setdefault(t[max(0, e - SEGMENT) : e], []).append(item)
        return cls(list(where), list(where.values()), whole)

    def halves(self) -> list[tuple[Segments, int]]:
        if self._halves is None:
            n = len(self.text) // 2
            self._halves = [(Segments(self.text[:n], self.items[:n], {}), 0), (Segments(self.text[n:], self.items[n:], {}), n)]
        return self._halves

    def match(self, text: str | None) -> dict[int | None, tuple[int, int]]:
        """item -> (matched segments, fewest edits)."""
        t = normal(text)
        if t in self.whole:
            return {i: (1, 0) for i in self.whole[t]}
        edits: dict[int, int] = {}
        if len(self.keys):
            for lo in range(0, max(1, len(t) - OVERLAP), SLICE_CHARS):
                self._slice(t, lo, min(len(t), lo + SLICE_CHARS + OVERLAP), edits, 0)
        found: dict[int | None, list[int]] = {}
        for s, e in edits.items():
            for i in set(self.items[s]):
                found.setdefault(i, []).append(e)
        return {i: (len(x), min(x)) for i, x in found.items()}

    def _slice(self, t: str, lo: int, hi: int, edits: dict[int, int], shift: int) -> None:
        """The fewest edits of each segment (its number and ``shift``) that lies within t[lo:hi]."""
        if hi - lo < Q or not len(self.keys):
            return
        h = grams(codes(t[lo:hi]))
        good = self.seen[(h >> np.uint64(44)).astype(np.int64)]
        some = h[:: 2 * OVERLAP]
        if (some[1:] == some[:-1]).any():  # else no run is as long as that
            edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            run = np.diff(edge, append=len(h))
            for a, n in zip(edge[run > 4 * OVERLAP].tolist(), run[run > 4 * OVERLAP].tolist(), strict=True):
                good[a + 2 * OVERLAP : a + n - 2 * OVERLAP] = False  # inside a run of one character nothing new can match
        at = np.flatnonzero(good)
        slot = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[slot] == h[at]
        at, slot = at[hit], slot[hit]
        n = self.count[slot]
        if not len(at) or len(at) < self.need.min():
            return
        if n.sum() > HITS and hi - lo > LEAST_CHARS:
            mid = (lo + hi) // 2
            self._slice(t, lo, mid + OVERLAP // 2, edits, shift)
            self._slice(t, mid - OVERLAP // 2, hi, edits, shift)
            return
        if n.sum() > HITS and len(self.text) > 1:
            for half, more in self.halves():
                half._slice(t, lo, hi, edits, shift + more)
            return
        # every (text position, segment, segment position) of an equal q-gram
        from_ = np.repeat(self.first[slot] - np.cumsum(n) + n, n) + np.arange(n.sum())
        seg = self.seg[from_].astype(np.int64)
        diag = np.repeat(at, n) - self.pos[from_] + SEGMENT + Q  # never negative
        band = diag // (self.k[seg] + 1)
        stride = int(band.max()) + 2
        key = np.concatenate([seg * stride + band, seg * stride + np.maximum(band - 1, 0)])
        key.sort()
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        b, c = key[begin], np.diff(begin, append=len(key))
        enough = c >= self.need[b // stride]
        for s, d in zip((b[enough] // stride).tolist(), (b[enough] % stride).tolist(), strict=True):
            if edits.get(s + shift) == 0:
                continue
            w = int(self.k[s]) + 1
            from_text = lo + d * w - SEGMENT - Q
            region = t[max(0, from_text - w) : max(0, from_text + 2 * w + len(self.text[s]) + w)]
            if len(self.text[s]) < MIN_CHARS:
                e = self._short(self.text[s], t, max(0, from_text - w), max(0, from_text + 2 * w + len(self.text[s]) + w))
            else:
                mark = (s, region)
                if mark not in self.verified:
                    if len(self.verified) > 50_000:
                        self.verified.clear()
                    self.verified[mark] = banded(self.text[s], region, int(self.k[s]))
                e = self.verified[mark]
            if e is not None:
                edits[s + shift] = min(e, edits.get(s + shift, e))

    @staticmethod
    def _short(seg: str, t: str, lo: int, hi: int) -> int | None:
        at = t.find(seg, lo, hi)
        while at >= 0:
            if _apart(t, at, at + len(seg)):
                return 0
            at = t.find(seg, at + 1, hi)
        return None


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of about ``block_bytes``; each block alone is brought to the driver when it is used."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // block_bytes))
    items = benchmark.select("item_id", "text")
    if n == 1:
        yield [tuple(r) for r in items.collect()]
        return
    for i in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_segments, edits) of every text that holds a segment of an item."""
    out = None
    for block in blocks(benchmark, block_bytes):

        def batch(cols: dict[str, list], segments: Segments) -> dict[str, list]:
            rows = [(d, i, *m) for d, t in zip(cols["doc_id"], cols["text"], strict=True) for i, m in sorted(segments.match(t).items(), key=str)]
            return dict(zip(("doc_id", "item_id", "n_segments", "edits"), map(list, zip(*rows, strict=True)), strict=True)) if rows else {}

        got = map_slices(docs.select("doc_id", "text"), batch, "doc_id long, item_id long, n_segments long, edits long", lambda block=block: Segments.of(block))
        out = got if out is None else out.unionByName(got)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that ``find_leaks`` would report."""
    for block in blocks(benchmark, block_bytes):
        memory: list[Segments] = []

        def good(texts: list, block=block, memory=memory) -> list[bool]:
            if not memory:  # once in a task
                memory.append(Segments.of(block))
            return [not memory[0].match(t) for t in texts]

        docs = keep_where(docs, "text", good)
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
