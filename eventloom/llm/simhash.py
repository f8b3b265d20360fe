"""SimHash near-duplicates: fingerprints, pigeonring candidates, components.

Pigeonring: cut a fingerprint into SEGMENTS segments on a ring. If two fingerprints differ in at most r bits, there is a
segment from which every chain of l consecutive segments (l = 1 .. SEGMENTS) differs in at most l * r / SEGMENTS bits. The
chains whose budget is below one bit must be equal, so they are the key of an equi-join; the longer chains are a filter,
ahead of the full Hamming check.

A key that more than ``hot_bucket`` fingerprints share is not paired. Its fingerprints are linked exactly by their
variants instead: two fingerprints differ in at most 2 bits if and only if they share one of the 65 words that each is
within one bit of, and a variant is held by 65 fingerprints at most, all of them linked with each other. That needs
radius <= 2; every fingerprint with the key takes part, none is left out.

Copies collapse first: texts with one fingerprint are one class, represented by its smallest id. Components are found by
alternating large-star and small-star steps on class representatives, with a written table after each round.

``similar_groups`` and ``keep_one``, for the pipeline, take the same fingerprints and links, and go on to the texts whose
sets of shingles are similar though their fingerprints are not.

Defined cases: an empty table gives an empty one; a null text has no word, so its fingerprint is zero, linked like any
other; repeated rows and ids give a row each; rows with a null id get their fingerprint and the component of their class
(null if all of a component's ids are null). Other columns, whatever their names, are ignored or (``keep_one``) pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, bounded, cut, distinct, drop, free_name, lower_ascii, map_slices, maybe_among, mix64, named, table, word_hashes, words_of

SEGMENTS = 8
BITS = 64
#: Longs of the sketch of a set of shingles; a power of two.
SKETCH = 8
_SKETCH = [f"s{i}" for i in range(SKETCH)]
_SPREAD = np.array([[(b >> i) & 1 for i in range(8)] for b in range(256)], dtype=np.uint8)


def shingles(text: str | None, size: int) -> list[bytes]:
    w = words_of(text)
    w = lower_ascii(b" ".join(w)).split(b" ") if w else []
    if not w:
        return []
    if len(w) < size:
        return [b" ".join(w)]
    return list(map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False)))


def hashes(text: str | None, size: int) -> np.ndarray:
    s = shingles(text, size)
    return np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in s), dtype=np.uint64, count=len(s))


def majority(h: np.ndarray) -> int:
    """Bit i of the result is set if it is set in over half of ``h``."""
    ones = np.zeros((8, 8), dtype=np.int64)
    for lo in range(0, len(h), 65536):  # bounded memory for very long texts
        b = h[lo : lo + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(b, axis=1, bitorder="little").sum(axis=0, dtype=np.int64).reshape(8, 8)
    return int.from_bytes(np.packbits(ones.ravel() * 2 > len(h), bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(text: str | None, size: int = 3) -> int:
    """The fingerprint as a long; zero if there is no word."""
    return signed(majority(h)) if len(h := hashes(text, size)) else 0


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp long) of whole texts."""

    def batch(cols: dict[str, list]) -> dict[str, list]:
        return {"doc_id": cols["doc_id"], "fp": [simhash(t, size) for t in cols["text"]]}

    return map_slices(docs.select("doc_id", "text"), batch, "doc_id long, fp long")


def set_words(text: str | None) -> np.ndarray:
    """The hashes of a text's words, A-Z in lower case."""
    return word_hashes(lower_ascii(text.encode("utf-8", "surrogatepass"))) if text else np.zeros(0, np.uint64)


def _windows(w: np.ndarray, size: int) -> np.ndarray:
    """The 64-bit hash of every shingle of words ``w``: a polynomial of their hashes. Fewer words are one shingle."""
    if not len(w):
        return w
    size = min(size, len(w))
    h = np.zeros(len(w) - size + 1, dtype=np.uint64)
    for i in range(size):
        h = h * BASE + w[i : i + len(h)]
    return mix64(h + np.uint64(size))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The different hashes of a text's shingles, ascending."""
    return distinct(_windows(set_words(text), size))


def sketch(u: np.ndarray) -> np.ndarray:
    """SKETCH longs in which bit x mod 64 * SKETCH is toggled for every x of a set: two sets differ in at least as many
    elements as their longs differ in bits."""
    odd = np.bincount((u & np.uint64(BITS * SKETCH - 1)).astype(np.int64), minlength=BITS * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def ring(radius: int) -> tuple[int, list[int]]:
    """Segments of the chain that must be equal; for each longer chain, its budget in bits."""
    budgets = [(n * radius) // SEGMENTS for n in range(1, SEGMENTS + 1)]
    return sum(b == 0 for b in budgets), budgets


def _rotated(fp: Column, start: int) -> Column:
    """The fingerprint rotated so that segment ``start`` is lowest."""
    k = start * (BITS // SEGMENTS)
    return fp if k == 0 else F.shiftrightunsigned(fp, k).bitwiseOR(F.shiftleft(fp, BITS - k))


def _mask(segments: int) -> int:
    return signed((1 << segments * (BITS // SEGMENTS)) - 1)


def links(prints: DataFrame, radius: int = 2, hot_bucket: int = 64) -> DataFrame:
    """Links (a, b), a < b, between representatives of distinct fingerprints of one table.

    ``prints``: (t int, fp long, v long), one row for each table and fingerprint, v its representative. With variants in
    hot buckets the links span the same components as all pairs within ``radius`` bits.
    """
    if not 0 <= radius <= 2:
        raise ValueError("the radius must be 0, 1 or 2")
    exact, budgets = ring(radius)
    # the narrowest rows are shuffled: table and start in one number, the key left in the rotated fingerprint
    starts = F.array(*[F.struct((F.col("t") * SEGMENTS + i).alias("ts"), _rotated(F.col("fp"), i).alias("x")) for i in range(SEGMENTS)])
    keyed = prints.select("v", F.explode(starts).alias("e")).select("v", F.col("e.ts").alias("ts"), F.col("e.x").alias("x"))
    key = F.col("x").bitwiseAND(F.lit(_mask(exact)))
    sizes = keyed.groupBy(F.col("ts").alias("own"), key.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    live = keyed.join(sizes, (F.col("ts") == F.col("own")) & (key == F.col("k")))
    live = cut(live.select((F.col("ts") / SEGMENTS).cast("int").alias("t"), (F.col("ts") % SEGMENTS).alias("s"), "k", "v", "x", "n"), "buckets")
    mild = live.where(F.col("n") <= hot_bucket).drop("n")
    a = mild.select("t", "s", "k", F.col("v").alias("a"), F.col("x").alias("xa"))
    b = mild.select("t", "s", "k", F.col("v").alias("b"), F.col("x").alias("xb"))
    diff = F.col("xa").bitwiseXOR(F.col("xb"))
    chain = F.lit(True)
    for n in range(exact + 1, SEGMENTS + 1):  # the last chain is the whole ring: the Hamming check
        part = diff if n == SEGMENTS else diff.bitwiseAND(F.lit(_mask(n)))
        chain = chain & (F.bit_count(part) <= budgets[n - 1])
    pairs = a.join(b, ["t", "s", "k"]).where(F.col("a") < F.col("b")).where(chain).select("a", "b")
    hot = live.where(F.col("n") > hot_bucket).select("t", "v", F.when(F.col("s") == 0, F.col("x")).otherwise(_unrotate()).alias("fp")).distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(BITS)])
    if radius < 2:
        hot = hot.where(F.lit(radius >= 1))
    near = hot.select("t", "v", "fp", F.explode(flips).alias("w"))
    if radius == 1:
        # within one bit: link the word itself, where it is a fingerprint, with those that reach it
        own = hot.select("t", F.col("fp").alias("w"), F.col("v").alias("b"))
        star = near.select("t", "w", F.col("v").alias("a")).join(own, ["t", "w"]).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    else:
        got = near.groupBy("t", "w").agg(F.collect_list("v").alias("vs")).where(F.size("vs") > 1)  # 65 at most
        star = got.select(F.array_min("vs").alias("a"), F.explode("vs").alias("b")).where("a < b")
    return pairs.unionByName(star).distinct()


def _unrotate() -> Column:
    out = F.col("x")
    for i in range(1, SEGMENTS):
        k = i * (BITS // SEGMENTS)
        out = F.when(F.col("s") == i, F.shiftleft(F.col("x"), k).bitwiseOR(F.shiftrightunsigned(F.col("x"), BITS - k))).otherwise(out)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(v, c): c the smallest vertex that v reaches, for every vertex of ``edges`` (a, b) but the smallest of each component."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = cut(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("v"), F.col("v").alias("c"))
        before = now


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, hot_bucket: int = 64) -> DataFrame:
    """(doc_id, fp, component_id) for every row of (doc_id, text)."""
    prints = cut(fingerprints(docs, size), "prints")
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("v")).where("v is not null"), "classes")
    comp = components(links(classes.select(F.lit(0).alias("t"), "fp", "v"), radius, hot_bucket))
    # written, so that nothing but the two exchanges stands below the join and AQE can split a hot fingerprint
    named = cut(classes.join(comp, "v", "left").select("fp", F.coalesce("c", "v").alias("component_id")), "named")
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_groups(docs: DataFrame, size: int = 5, min_similarity: float = 0.8) -> DataFrame:
    """(d, h, id, first, rows, leader): every different pair of an id (``d``, as text) and a content (``h``, SHA-256), with
    the content's number, its first (smallest) id, how many rows the pair has, and the number of the content that leads
    its group. A content may lead itself.

    Two texts are linked if their SimHashes link as in ``near_duplicates`` (2 or fewer differing bits), or if the sets of
    their ``size``-word shingles have a Jaccard similarity of ``min_similarity`` or more (texts without a word are linked
    with each other); the content with the smallest first id of a component of such links leads it, nulls last, then the
    smallest hash. Ids play no other part: they may be null or repeated.

    Links by SimHash come from ``links``. The others are found exactly, by a prefix filter: with the shingles of all sets
    in one order, two sets so similar share one of the first n - ceil(min_similarity * n) + 1 of each, and behind the first
    that they share both have elements enough to be so similar. The order puts shingles that many texts hold last; it
    decides how many candidates there are, never which links are found. Each prefix shingle links its texts to one of
    them; these are compared first. Then, SimHash's links counted in, all pairs that share a prefix shingle and are still
    in two components: pairs within one can't change it.
    """
    keyed = _keyed(docs)
    pairs = cut(keyed.groupBy("d", "h").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows")), "contents")
    copies = pairs.groupBy("h").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "d")).alias("x")).select("h", F.col("x.doc_id").alias("first"), F.col("x.d").alias("d"))
    # numbers are given once and written; they follow no order that matters
    copies = cut(copies.withColumn("id", F.monotonically_increasing_id()), "copies")
    texts = _Texts(keyed, copies)
    # prints of all rows move, not texts; those of copies are dropped on arrival
    every = set_prints(keyed, size, min_similarity, frequent_shingles(docs, size))
    holders = copies.select(F.col("d").alias("cd"), F.col("h").alias("ch"), "id")
    rest_of = [c for c in every.columns if c not in ("d", "h")]
    prints = every.join(holders, (F.col("d") == F.col("cd")) & (F.col("h") == F.col("ch")))
    prints = cut(prints.groupBy("d", "h", "id").agg(*(F.first(c).alias(c) for c in rest_of)).drop("d", "h"), "prints")
    each = prints.select("id", "n", F.posexplode("prefix").alias("at", "x")).select("x", "id", "n", (F.col("n") - F.col("at")).alias("left"))
    # narrow rows: most prefix shingles are seen once and end here
    counted = cut(each.groupBy(F.col("x").alias("y")).agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "counted")
    live = maybe_among(each, F.col("x"), counted.select("y"), "maybe").where("maybe")
    live = cut(live.join(counted, F.col("x") == F.col("y")).select("x", "id", "n", "left", "c"), "held")
    # a centre for each shingle, another for the next: in a group of near copies they link it, whichever is an outsider
    centres = live.groupBy(F.col("x").alias("y")).agg(F.min(F.struct(F.xxhash64("x", "id"), "id", "n", "left")).alias("m"))
    centres = cut(centres.select("y", F.col("m.id").alias("m"), F.col("m.n").alias("mn"), F.col("m.left").alias("mleft")), "centres")
    live = cut(live.join(centres, F.col("x") == F.col("y")).drop("y"), "live")
    stars = live.where((F.col("id") != F.col("m")) & _room("n", "left", "mn", "mleft", min_similarity))
    stars = stars.select(F.least("m", "id").alias("a"), F.greatest("m", "id").alias("b")).distinct()
    lead = _joined(texts, _reachable(stars, prints, min_similarity), _alike(prints), live, size, min_similarity)
    placed = live.where("c > 2").join(lead.withColumnsRenamed({"v": "id", "c": "own"}), "id", "left")
    placed = cut(placed.select("x", "id", "n", "left", "m", F.coalesce("own", "id").alias("g")), "placed")
    split = placed.groupBy("x").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("x")
    open_ = cut(placed.join(split, "x", "left_semi").join(prints.select("id", *_SKETCH), "id"), "open")
    a, b = (open_.select("x", *(F.col(k).alias(e + k) for k in ("id", "n", "left", "m", "g", *_SKETCH))) for e in "ab")
    rest = a.join(b, "x").where((F.col("aid") < F.col("bid")) & (F.col("ag") != F.col("bg")) & (F.col("aid") != F.col("am")) & (F.col("bid") != F.col("am")) & _room("an", "aleft", "bn", "bleft", min_similarity) & _may_reach(min_similarity))
    rest = rest.select(F.col("aid").alias("a"), F.col("bid").alias("b")).distinct()
    lead = _joined(texts, rest, lead.select(F.col("c").alias("a"), F.col("v").alias("b")), live, size, min_similarity)
    lead = lead.withColumnsRenamed({"v": "id", "c": "g"})
    # a component's smallest number is not always its smallest id
    member = copies.join(lead, "id", "left").select("id", "h", "first", F.coalesce("g", "id").alias("g"))
    best = member.groupBy("g").agg(F.min(F.struct(F.col("first").isNull(), "first", "h", "id")).alias("x")).select("g", F.col("x.id").alias("leader"))
    member = cut(member.join(best, "g").select("id", F.col("h").alias("own"), "first", "leader"), "members")
    return pairs.join(member, F.col("h") == F.col("own")).select("d", "h", "doc_id", "id", "first", "rows", "leader")


def keep_one(docs: DataFrame, size: int = 5, min_similarity: float = 0.8) -> DataFrame:
    """One row of each group of ``similar_groups``: a row of the leading content with its first id. Of rows equal in id and
    text one stays, whichever their other columns; columns and their names are those of ``docs``."""
    groups = similar_groups(docs, size, min_similarity)
    stays = (F.col("id") == F.col("leader")) & F.col("doc_id").eqNullSafe(F.col("first"))
    d, h = free_name("d", docs.columns), free_name("h", docs.columns)
    rows = docs.withColumns({d: _id_key(docs), h: _content(docs)})
    odd = cut(groups.where(~(stays & (F.col("rows") == 1))).select(F.col("d").alias("gd"), F.col("h").alias("gh"), stays.alias("one")), "odd")
    flag = free_name("maybe", rows.columns)
    rows = maybe_among(rows, F.xxhash64(F.col(d), F.col(h)), odd.select(F.xxhash64("gd", "gh").alias("k")), flag)
    plain, some = rows.where(~F.col(flag)), rows.where(flag)  # most rows stay where they are
    alone = some.join(odd, (F.col(d) == F.col("gd")) & (F.col(h) == F.col("gh")), "left_anti")
    one = some.join(odd.where("one"), (F.col(d) == F.col("gd")) & (F.col(h) == F.col("gh")), "left_semi").dropDuplicates([d, h])
    return plain.unionByName(alone).unionByName(one).select(*(named(c) for c in docs.columns))


def _id_key(docs: DataFrame) -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))


def _content(docs: DataFrame) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), _id_key(docs).alias("d"), _content(docs).alias("h"))


class _Texts:
    """The text of contents by number, fetched from one row each: a copy shared by a third of all rows moves once."""

    def __init__(self, keyed: DataFrame, copies: DataFrame):
        self.keyed, self.copies = keyed.select("d", "h", "text"), copies

    def of(self, ids: DataFrame) -> DataFrame:
        """(id, text) of different ``ids``."""
        holder = cut(self.copies.join(ids, "id", "left_semi").select(F.col("d").alias("cd"), F.col("h").alias("ch"), "id"), "holders")
        some = maybe_among(self.keyed, F.xxhash64("d", "h"), holder.select(F.xxhash64("cd", "ch").alias("k")), "maybe").where("maybe").drop("maybe")
        got = some.join(holder, (F.col("d") == F.col("cd")) & (F.col("h") == F.col("ch")))
        # equal rows: the exchange of the join serves the grouping too
        return got.groupBy("d", "h", "id").agg(F.first("text").alias("text")).select("id", "text")


def _alike(prints: DataFrame) -> DataFrame:
    """Links (a, b) of numbers by SimHash: all of one fingerprint with its smallest, and these within the radius."""
    classes = cut(prints.groupBy("fp").agg(F.min("id").alias("v")), "classes")
    same = prints.select(F.col("fp").alias("own"), F.col("id").alias("b")).join(classes, F.col("own") == F.col("fp")).where("b <> v")
    return same.select(F.col("v").alias("a"), "b").unionByName(links(classes.select(F.lit(0).alias("t"), "fp", "v")))


def _joined(texts: _Texts, edges: DataFrame, more: DataFrame, live: DataFrame, size: int, least: float) -> DataFrame:
    """``components`` of the links ``more`` and of the edges (a, b) whose texts are similar enough; what was written on the
    way is deleted."""
    near = cut(edges, "near")
    candidates = cut(_sharing(near, live, least), "candidates")
    sets = _sets(texts, candidates, size)
    out = components(_compared(candidates, sets, least).unionByName(more))
    drop(near, candidates, sets)
    return out


def _sharing(edges: DataFrame, live: DataFrame, least: float) -> DataFrame:
    """The edges (a, b) but those that share too few prefix shingles for certain; ``live`` has a row (x, id, n) for each
    prefix shingle of two texts or more.

    Behind the set whose prefix ends first in the common order, two sets share at most what that one has left; up to there
    every shingle that they share is in both prefixes.
    """
    # a row for an edge, not for each shingle that one of its ends holds
    held = live.groupBy("id").agg(F.collect_list("x").alias("x"), F.first("n").alias("n"))
    a, b = (held.select(F.col("id").alias(e), F.col("x").alias(e + "x"), F.col("n").alias(e + "n")) for e in "ab")
    both = edges.join(a, "a").join(b, "b").withColumn("k", F.size(F.array_intersect("ax", "bx")))
    behind = F.ceil(least * F.greatest("an", "bn") - 1e-6) - 1
    return both.where(F.col("k") + behind + 1e-6 >= least / (1 + least) * (F.col("an") + F.col("bn"))).select("a", "b")


def _room(n: str, left: str, other_n: str, other_left: str, least: float) -> Column:
    """Whether two sets can be similar whose first common element has ``left`` elements from itself on in either."""
    return F.least(F.col(left), F.col(other_left)) + 1e-6 >= least / (1 + least) * (F.col(n) + F.col(other_n))


def frequent_shingles(docs: DataFrame, size: int, most: int = 1 << 17, run: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, 16 * log2 of the count) of the most frequent shingles, ``most`` at most: whole levels of that
    logarithm, from the top, as long as there is room.

    All texts are counted, in runs of ``run`` shingles, a text's different ones once; of a run those move that two of its
    texts hold. What two or more in a run don't hold counts as rare, as what is beyond ``most``: they only order the shingles.
    """

    def held_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, n = [], 0

        def counted() -> pa.RecordBatch:
            x, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(x[c > 1].view(np.int64)), pa.array(c[c > 1].astype(np.int64))], names=["x", "c"])

        for batch in batches:
            for text in batch.column(0):
                sets.append(shingle_set(text.as_py(), size))
                n += len(sets[-1])
                if n >= run:
                    yield counted()
                    sets, n = [], 0
        yield counted()

    counts = bounded(docs.select("text")).mapInArrow(held_twice, "x long, c long").groupBy("x").agg(F.sum("c").alias("n"))
    counts = cut(counts.select("x", F.round(16 * F.log2("n")).cast("long").alias("c")), "counts")
    room, least = most, None
    # a row for each level, 1,024 at most; a limit would send that many of every partition to the driver
    for c, n in sorted(counts.groupBy("c").count().collect(), reverse=True):
        if (room := room - n) < 0:
            break
        least = c
    got = counts.where(F.lit(False) if least is None else F.col("c") >= least).toArrow()
    drop(counts)
    x, c = (got.column(i).to_numpy() for i in range(2))
    order = np.argsort(x.view(np.uint64))
    return x.view(np.uint64)[order], c[order]


def ordered_set(text: str | None, size: int, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of a text's different shingles, ascending; the same in the common order: rare ones first)."""
    u, (known, logs) = shingle_set(text, size), frequent
    if not len(u) or not len(known):
        return u, u
    i = np.minimum(np.searchsorted(known, u), len(known) - 1)
    return u, u[np.argsort(np.where(known[i] == u, logs[i], 0), kind="stable")]


def set_prints(texts: DataFrame, size: int, least: float, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(d, h, fp long, prefix array<long>, n long, s0 .. long) of rows (d, h, text): the text's SimHash; prefix in the common
    order (a zero for the empty set), elements and sketch of its set of shingles."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def batch(cols: dict[str, list]) -> dict[str, list]:
        sets = [ordered_set(t, size, shared.value) for t in cols["text"]]
        bits = [sketch(u).tolist() for u, _ in sets]
        first = [o[: len(o) - int(np.ceil(least * len(o) - 1e-6)) + 1].view(np.int64) if len(o) else np.zeros(1, np.int64) for _, o in sets]
        return {"d": cols["d"], "h": cols["h"], "fp": list(map(simhash, cols["text"])), "prefix": first, "n": [len(u) for u, _ in sets]} | {f"s{i}": [b[i] for b in bits] for i in range(SKETCH)}

    longs = ", ".join(f"s{i} long" for i in range(SKETCH))
    return map_slices(texts.select("d", "h", "text"), batch, f"d string, h binary, fp long, prefix array<long>, n long, {longs}")


def _may_reach(least: float) -> Column:
    """Whether sets a and b can be similar, by their sizes and sketches: of p and q elements, with sketches that differ in d
    bits, they share (p + q - d) / 2 elements at most, and min(p, q)."""
    total = F.col("an") + F.col("bn")
    apart = sum((F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in _SKETCH), F.lit(0))
    most = F.least((total - apart) / 2.0, F.col("an").cast("double"), F.col("bn").cast("double"))
    return most * (1 + least) + 1e-6 >= total * least


def _reachable(edges: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """The edges (a, b) but those whose sets of shingles are too unlike for certain."""
    a, b = (prints.select(F.col("id").alias(x), *(F.col(c).alias(x + c) for c in ("n", *_SKETCH))) for x in "ab")
    return edges.join(a, "a").join(b, "b").where(_may_reach(least)).select("a", "b")


def _verified(texts: _Texts, edges: DataFrame, size: int, least: float) -> DataFrame:
    """The edges (a, b) whose texts are similar enough, by their sets of shingle hashes."""
    return _compared(edges, _sets(texts, edges, size), least)


def _sets(texts: _Texts, edges: DataFrame, size: int) -> DataFrame:
    """(v, hs): the set of shingle hashes of every end of ``edges``, written."""

    def batch(cols: dict[str, list]) -> dict[str, list]:
        return {"v": cols["id"], "hs": [shingle_set(t, size).tobytes() for t in cols["text"]]}

    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return cut(map_slices(texts.of(ends), batch, "v long, hs binary"), "shingles")


def _compared(edges: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The edges whose ends' ``sets`` are similar enough.

    Both ends' sets travel with a link. Their sizes are within ``least`` of each other by then, so what moves is bounded by
    the links' own texts; AQE splits the join where one end has many links.
    """

    def compare(cols: dict[str, list]) -> dict[str, list]:
        rows = []
        for v, w, x, y in zip(*(cols[k] for k in ("a", "b", "ha", "hb")), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.sort(np.concatenate([p, q]))
            n = int((both[1:] == both[:-1]).sum())
            if n >= least * (len(p) + len(q) - n):
                rows.append((v, w))
        return {"a": [r[0] for r in rows], "b": [r[1] for r in rows]} if rows else {}

    pairs = edges.join(sets.withColumnsRenamed({"v": "a", "hs": "ha"}), "a").join(sets.withColumnsRenamed({"v": "b", "hs": "hb"}), "b")
    return map_slices(pairs.select("a", "b", "ha", "hb"), compare, "a long, b long")
