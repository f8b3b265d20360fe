"""SentencePiece encoding and decoding over a relational lattice.

A text is escaped (a leading space, spaces as U+2581) and cut into units that no piece crosses: a run of U+2581 with the
word that follows, or a line break. Units are counted over the whole corpus. For the most frequent ones (``head`` units of
at most HEAD_CHARS characters, a stated bound) the lattice is relational: every substring of at most the longest piece's
length is exploded, an equi-join with the piece table leaves the edges, edges are grouped by unit, and a fold with Spark's
higher-order ``aggregate`` picks the path. The resulting table is small by that bound and is sent to the workers, which
map whole texts through it: a slice's bytes are cut into units by numpy, Arrow numbers its distinct units, and each of
these is looked up once. Units outside the table (rare ones, each a small part of the corpus) get the same fold in the
worker that meets them, with a bounded memory of what it has seen.

Two folds: ``viterbi`` is the best path by the sum of piece scores, right for unigram models. In a BPE model scores are
merge ranks; their sum means nothing, and its Viterbi path differs from the model's own ids on about half of all words.
There the fold merges, in each step, the adjacent pair whose concatenation is the best edge, leftmost first, which gives
the model's own ids. The kind is read from the model file. Characters without a piece become byte pieces.

Defined cases: a null text has null ids, an empty one none, and both round-trip; an empty table gives an empty one. Texts
that contain U+2581 itself decode to a space there, as with the model's own decoder. Rows are encoded alone, so repeated
rows and ids need nothing; equal scores fall to the leftmost pair (merging) or the earlier start (Viterbi). Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, map_slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
HEAD = 50_000
HEAD_CHARS = 24
#: The rank of what is no pair.
NEVER = (1 << 31) - 1
_SPREAD = 0x9E3779B97F4A7C15
#: Bytes of text that are cut into units at once; a longer text is one slice.
TEXT_BYTES = 3 << 20
_UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class Model:
    """The piece table of a model file."""

    def __init__(self, path: str = MODEL):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            raw = f.read()
        spec = pb.ModelProto()
        spec.ParseFromString(raw)
        self.bpe = spec.trainer_spec.model_type == 2
        sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unk = sp.unk_id()
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.piece = {self.text[i]: (sp.get_score(i), i) for i in range(n) if not special[i]}
        self.rank = {p: -s for p, (s, _) in self.piece.items()}
        self.never = float("inf")
        self.longest = max(map(len, self.piece))
        self.floor = min(s for s, _ in self.piece.values()) - 10
        value = {i: b for b, i in self.byte.items()}
        self.out = ["" if special[i] and i not in value else chr(value[i]) if i in value and value[i] < 128 else None if i in value else self.text[i].replace(SPACE, " ") for i in range(n)]
        self.value = value

    def spell(self, symbol: str) -> list[int]:
        """Ids of one symbol."""
        if symbol in self.piece:
            return [self.piece[symbol][1]]
        if self.byte:
            return [self.byte[b] for b in symbol.encode("utf-8", "surrogatepass")]
        return [self.unk]

    def merge(self, unit: str) -> list[int]:
        """The BPE fold of one unit."""
        s = list(unit)
        if len(s) > 256:
            return self._merge_long(s)
        get, never = self.rank.get, self.never
        rank = [get(a + b, never) for a, b in zip(s, s[1:], strict=False)]
        while rank:
            best = min(rank)
            if best == never:
                break
            j = rank.index(best)
            s[j] += s.pop(j + 1)
            rank.pop(j)
            if j < len(rank):
                rank[j] = get(s[j] + s[j + 1], never)
            if j:
                rank[j - 1] = get(s[j - 1] + s[j], never)
        piece = self.piece
        if all(map(piece.__contains__, s)):
            return [piece[x][1] for x in s]
        return list(chain.from_iterable(map(self.spell, s)))

    def _merge_long(self, s: list[str]) -> list[int]:
        """The same with a heap over linked symbols, for units of any length."""
        import heapq

        n, piece = len(s), self.piece
        after, before = list(range(1, n)) + [-1], [-1, *range(n - 1)]
        heap = [(-piece[p][0], i, p) for i in range(n - 1) if (p := s[i] + s[i + 1]) in piece]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i]
            if not s[i] or j < 0 or s[i] + s[j] != p:
                continue
            s[i], s[j] = p, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (q := s[a] + s[after[a]]) in piece:
                    heapq.heappush(heap, (-piece[q][0], a, q))
        return list(chain.from_iterable(self.spell(x) for x in s if x))

    def viterbi(self, unit: str) -> list[int]:
        """The unigram fold of one unit: the best sum of scores, the earlier start on ties."""
        best: list[tuple[float, int]] = [(0.0, 0)]
        for e in range(1, len(unit) + 1):
            got = [(best[s][0] + self.piece[unit[s:e]][0], -s) for s in range(max(0, e - self.longest), e) if unit[s:e] in self.piece]
            if unit[e - 1] not in self.piece:
                got.append((best[e - 1][0] + self.floor, 1 - e))
            best.append(max(got))
        cuts, e = [], len(unit)
        while e:
            s = -best[e][1]
            cuts.append(unit[s:e])
            e = s
        return list(chain.from_iterable(map(self.spell, reversed(cuts))))

    def fold(self, unit: str) -> list[int]:
        return self.merge(unit) if self.bpe else self.viterbi(unit)

    def decode(self, ids: list[int]) -> str:
        parts = list(map(self.out.__getitem__, ids))
        if None in parts:  # bytes of characters without a piece
            raw = b"".join(bytes([self.value[i]]) if p is None else p.encode("utf-8", "surrogatepass") for i, p in zip(ids, parts, strict=True))
            text = raw.decode("utf-8", "replace")
        else:
            text = "".join(parts)
        return text.removeprefix(" ")


class Folds:
    """The folds of many units at once, over arrays; what a worker needs of a model."""

    #: Units of more characters are folded one by one, with a heap.
    LONG = 48

    def __init__(self, model: Model):
        self.model, n = model, len(model.text)
        special = {i for i in range(n) if model.out[i] == ""}
        raw = [bytes([model.value[i]]) if i in model.value else b"" if i in special else model.text[i].replace(SPACE, " ").encode("utf-8") for i in range(n)]
        self.bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.size = np.array(list(map(len, raw)), dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.single = np.full(0x110000, -1, dtype=np.int32)
        for p, (_, i) in model.piece.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        self.single[32] = self.single[ord(SPACE)]
        # characters that are part of a piece, but no piece themselves
        self.odd = sorted({ord(c) for p in model.piece for c in p if self.single[ord(c)] < 0})
        order = {x: k for k, x in enumerate(sorted({s for s, _ in model.piece.values()}, reverse=True))}
        pairs = [(model.piece[p[:k]][1] * n + model.piece[p[k:]][1], order[s], i) for p, (s, i) in model.piece.items() for k in range(1, len(p)) if p[:k] in model.piece and p[k:] in model.piece]
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.key = np.full((1 << self.bits) + 1, -1, dtype=np.int64)
        self.rank, self.to = np.full(len(self.key), NEVER, dtype=np.int32), np.full(len(self.key), -1, dtype=np.int32)
        for code, rank, i in pairs:
            j = code * _SPREAD % (1 << 64) >> (64 - self.bits)
            while self.key[j] >= 0:
                j = (j + 1) % (1 << self.bits)
            self.key[j], self.rank[j], self.to[j] = code, rank, i

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the table has the pairs of symbols; its last row is that of none."""
        code = a.astype(np.int64) * len(self.model.text) + b
        slot = ((code.view(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.flatnonzero((self.key[slot] != code) & (self.key[slot] >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) % (1 << self.bits)
            todo = todo[(self.key[slot[todo]] != code[todo]) & (self.key[slot[todo]] >= 0)]
        return np.where((self.key[slot] == code) & (a >= 0) & (b >= 0), slot, len(self.key) - 1).astype(np.int32)

    def fold(self, units: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each unit, all ids) of units with spaces for U+2581."""
        if not len(units):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        chars = pc.utf8_length(units).to_numpy().astype(np.int64)
        code = np.frombuffer("".join(units.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
        sym = self.single[code]
        starts = np.cumsum(chars) - chars
        alone = (chars > self.LONG) | (np.minimum.reduceat(sym, starts) < 0) | (not self.model.bpe)
        if self.odd:
            alone |= np.logical_or.reduceat(np.isin(code, self.odd), starts)
        ids: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        for i in np.flatnonzero(alone).tolist():
            got = self.model.fold(units[i].as_py().replace(" ", SPACE))
            ids.append(np.array(got, dtype=np.int32))
            owner.append(np.full(len(got), i))
        own = np.repeat(np.arange(len(units), dtype=np.int32), chars)
        if alone.any():
            sym, own = sym[~alone[own]], own[~alone[own]]
        slot = np.full(len(sym), len(self.key) - 1, dtype=np.int32)
        slot[:-1] = np.where(own[1:] == own[:-1], self.pairs(sym[:-1], sym[1:]), len(self.key) - 1)
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            rank = self.rank[slot]
            least = np.minimum.reduceat(rank, first)
            count = np.diff(first, append=len(sym))
            ended = least == NEVER
            if ended.all():
                ids.append(sym)
                owner.append(own)
                break
            if ended.sum() * 4 > len(ended):  # take the finished units out
                out = np.repeat(ended, count)
                gone, left = np.flatnonzero(out), np.flatnonzero(~out)
                ids.append(sym.take(gone))
                owner.append(own.take(gone))
                sym, own, slot, rank = sym.take(left), own.take(left), slot.take(left), rank.take(left)
                least, count = least[~ended], count[~ended]
            hit = np.flatnonzero((rank == np.repeat(least, count)) & (rank != NEVER))
            hit = hit[np.concatenate([[True], own[hit[1:]] != own[hit[:-1]]])]  # the leftmost of each unit
            sym[hit] = self.to[slot[hit]]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            hit = hit - np.arange(len(hit))  # where it is without those before it
            left = np.flatnonzero(keep)
            sym, own, slot = sym.take(left), own.take(left), slot.take(left)
            for near in (hit, hit[hit > 0] - 1):
                after = np.minimum(near + 1, len(sym) - 1)
                slot[near] = np.where((own[near] == own[after]) & (after > near), self.pairs(sym[near], sym[after]), len(self.key) - 1)
        every = np.concatenate(owner)
        order = np.argsort(every, kind="stable")
        return np.bincount(every, minlength=len(units)), np.concatenate(ids)[order]

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for."""
        n = self.size[ids]
        return self.bytes[np.repeat(self.at[ids] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]

    def exact(self, units: pa.StringArray, n: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether the ids of each unit stand for its bytes."""
        if not len(units):
            return np.zeros(0, dtype=bool)
        ends = np.frombuffer(units.buffers()[1], dtype=np.int32)[units.offset : units.offset + len(units) + 1].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(self.size[ids])])[np.concatenate([[0], np.cumsum(n)])]
        good = np.diff(total) == np.diff(ends)
        if good.all():  # then the bytes lie side by side
            same = self.spell(ids) == np.frombuffer(units.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
            return np.logical_and.reduceat(same, ends[:-1] - ends[0])
        first = np.cumsum(n) - n
        return np.array([self.spell(ids[a : a + k]).tobytes() == u.encode("utf-8") for a, k, u in zip(first.tolist(), n.tolist(), units.to_pylist(), strict=True)])


@lru_cache(maxsize=4)
def model_at(path: str) -> Model:
    return Model(path)


@lru_cache(maxsize=4)
def folds_at(path: str) -> Folds:
    return Folds(model_at(path))


def units(text: str) -> list[str]:
    return _UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """(piece, score, id): as many rows as the model file has pieces."""
    return spark.createDataFrame([(p, float(s), i) for p, (s, i) in model.piece.items()], "piece string, score double, id int")


def _spelled(symbol: Column, known: Column, model: Model) -> Column:
    """Ids of a symbol, by bytes where it has no piece."""
    if not model.byte:
        return F.coalesce(F.array(known), F.array(F.lit(model.unk)))
    code = F.create_map(*[F.lit(x) for b, i in sorted(model.byte.items()) for x in (f"{b:02X}", i)])
    digits = F.hex(F.encode(symbol, "utf-8"))
    as_bytes = F.transform(F.sequence(F.lit(0), F.octet_length(symbol) - 1), lambda i: F.try_element_at(code, F.substring(digits, i * 2 + 1, F.lit(2))))
    return F.when(known.isNotNull(), F.array(known)).otherwise(as_bytes)


def _span(start: Column, length: Column, longest: int) -> Column:
    """One number for a span of up to two pieces' length."""
    return start * (2 * longest + 1) + length


def lattice(unit_table: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(unit, edges): the pieces among the substrings of each unit, score and id by ``_span``."""
    n = F.char_length("unit")
    spans = unit_table.select("unit", F.explode(F.sequence(F.lit(0), n - 1)).alias("at")).select("unit", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.char_length("unit") - F.col("at")))).alias("len"))
    parts = spans.select("unit", _span(F.col("at"), F.col("len"), longest).alias("span"), F.substring(F.col("unit"), F.col("at") + 1, F.col("len")).alias("piece"))
    # The piece table's size is the model file's. A unit without any edge keeps an empty lattice.
    edges = parts.join(F.broadcast(pieces), "piece", "left")
    edge = F.when(F.col("id").isNotNull(), F.struct("span", F.struct("score", "id").alias("e")))
    return edges.groupBy("unit").agg(F.map_from_entries(F.collect_list(edge)).alias("edges"))


def merge_fold(unit: Column, edges: Column, model: Model) -> Column:
    """The state is the array of borders between symbols; each step drops the border inside the best edge over two of them."""
    n = F.char_length(unit)

    def edge(a: Column, b: Column) -> Column:
        return F.try_element_at(edges, _span(a, b - a, model.longest))

    def step(s: Column, _: Column) -> Column:
        pairs = F.transform(F.slice(s, F.lit(1), F.size(s) - 2), lambda a, j: F.struct(edge(a, F.get(s, j + 2))["score"].alias("s"), (-j).alias("j")))
        best = F.array_max(F.filter(pairs, lambda p: p["s"].isNotNull()))["j"]
        # the inner lambda evaluates the best pair once
        without = F.transform(F.array(best), lambda j: F.filter(s, lambda _, i: j.isNull() | (i != 1 - j)))
        return F.when(F.size(s) < 3, s).otherwise(F.get(without, F.lit(0)))

    steps = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    borders = F.aggregate(steps, F.sequence(F.lit(0), n), step)
    return _ids_between(unit, edges, borders, model)


def _ids_between(unit: Column, edges: Column, borders: Column, model: Model) -> Column:
    def ids(a: Column, b: Column) -> Column:
        return _spelled(F.substring(unit, a + 1, b - a), F.try_element_at(edges, _span(a, b - a, model.longest))["id"], model)

    return F.flatten(F.zip_with(F.slice(borders, F.lit(1), F.size(borders) - 1), F.slice(borders, F.lit(2), F.size(borders) - 1), ids))


def viterbi_fold(unit: Column, edges: Column, model: Model) -> Column:
    """best: array of (score, -start) by end; then the borders of the best path, from the end."""
    zero = F.array(F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("b")))

    def step(best: Column, e: Column) -> Column:
        starts = F.sequence(F.greatest(F.lit(0), e - model.longest), e - 1)
        options = F.transform(starts, lambda b: F.struct(
            (F.get(best, b)["s"] + F.coalesce(F.try_element_at(edges, _span(b, e - b, model.longest))["score"], F.when(b == e - 1, F.lit(float(model.floor))))).alias("s"), (-b).alias("b")))
        return F.concat(best, F.array(F.array_max(F.filter(options, lambda o: o["s"].isNotNull()))))

    every = F.sequence(F.lit(1), F.char_length(unit))
    best = F.aggregate(every, zero, step)
    back = F.aggregate(every, F.array(F.char_length(unit)), lambda acc, _: F.when(F.get(acc, F.lit(0)) == 0, acc).otherwise(F.concat(F.array(-F.get(best, F.get(acc, F.lit(0)))["b"]), acc)))
    return _ids_between(unit, edges, back, model)


def encode_units(unit_table: DataFrame, model: Model, pieces: DataFrame | None = None) -> DataFrame:
    """(unit, ids) of distinct, non-empty units."""
    pieces = piece_table(unit_table.sparkSession, model) if pieces is None else pieces
    chosen = merge_fold if model.bpe else viterbi_fold
    # Few rows, much work each: dealt out by number, not by size.
    spread = unit_table.repartition(32, "unit")
    return lattice(spread, pieces, model.longest).select("unit", chosen(F.col("unit"), F.col("edges"), model).alias("ids"))


def _escaped(text: Column) -> Column:
    """A leading space, and spaces for U+2581: the bytes that units are cut from. Null and empty texts stay so."""
    return F.when(text == "", text).otherwise(F.concat(F.lit(" "), F.replace(text, F.lit(SPACE), F.lit(" "))))


def unit_slices(texts: pa.StringArray) -> Iterator[tuple[int, int, pa.StringArray, np.ndarray]]:
    """(first row, last row + 1, units of these rows, where each row's units begin) of escaped texts.

    The rules of ``units``, by bytes: a unit begins with a text, at a line break, behind one, and where a run of spaces does.
    """
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + TEXT_BYTES, side="right")) - 1)
        own = ends[lo : hi + 1] - ends[lo]
        c = data[ends[lo] : ends[hi]]
        begins = np.zeros(len(c) + 1, dtype=bool)
        space, line = c == 32, c == 10
        begins[:-1] = space | line
        begins[1:-1] &= ~(space[:-1] & space[1:])
        begins[1:] |= line
        begins[own] = True  # texts' ends too
        at = np.flatnonzero(begins)
        found = pa.StringArray.from_buffers(max(0, len(at) - 1), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(c)))
        yield lo, hi, found, np.searchsorted(at, own)
        lo = hi


def count_units(docs: DataFrame) -> DataFrame:
    """(unit, n) over all texts, units of at most HEAD_CHARS characters with spaces for U+2581; counted by slices first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, found, _ in unit_slices(batch.column(0)):
                got = found.value_counts()
                few = pc.less_equal(pc.utf8_length(got.field(0)), HEAD_CHARS)
                yield pa.RecordBatch.from_arrays([got.field(0), got.field(1)], names=["unit", "n"]).filter(few)

    return bounded(docs).select(_escaped(F.col("text"))).mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def head_units(docs: DataFrame, head: int) -> DataFrame:
    """At most ``head`` units: those above a count, which is read off a histogram of counts (eight steps an octave).

    No task or driver sees more than the histogram and the units themselves.
    """
    short = cut(count_units(docs).where(F.col("n") > 1), "units")
    step = F.floor(F.log2("n") * 8).cast("int")
    least, total = None, 0
    for at, n in short.groupBy(step.alias("at")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("at")).collect():
        if total + n > head:
            break
        least, total = at, total + n
    return short.where(F.lit(False) if least is None else step >= least).select(F.replace("unit", F.lit(" "), F.lit(SPACE)).alias("unit"))


def encode_documents(docs: DataFrame, path: str = MODEL, head: int = HEAD) -> DataFrame:
    """(doc_id, ids array<int>, n_pieces long, round_trip boolean): whether decoding gives the text back."""
    folds = folds_at(path)
    known = encode_units(head_units(docs, head), folds.model).collect()  # ``head`` rows at most
    table = (
        pa.array([r[0].replace(SPACE, " ") for r in known], pa.string()), np.array([len(r[1]) for r in known], dtype=np.int64),
        np.fromiter(chain.from_iterable(r[1] for r in known), dtype=np.int32),
    )
    shared = docs.sparkSession.sparkContext.broadcast((folds, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds, (units, sizes, flat) = shared.value
        begins = np.cumsum(sizes) - sizes
        for batch in batches:
            for lo, hi, found, rows in unit_slices(batch.column(1)):
                coded = found.dictionary_encode()
                own = coded.dictionary
                # head units from the table, the others by the worker's fold: both behind one another
                at = pc.index_in(own, value_set=units).fill_null(-1).to_numpy()
                rest = at < 0
                n_rest, more = folds.fold(own.filter(pa.array(rest)))
                size, start = sizes[at] if len(sizes) else np.zeros(len(at), np.int64), begins[at] if len(sizes) else np.zeros(len(at), np.int64)
                size[rest], start[rest] = n_rest, np.cumsum(n_rest) - n_rest + len(flat)
                both = np.concatenate([flat, more])
                ids = both[np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
                good = folds.exact(own, size, ids)
                which = coded.indices.to_numpy()
                n = size[which]
                ends = np.concatenate([[0], np.cumsum(n)])
                values = both[np.repeat(start[which] - ends[:-1], n) + np.arange(ends[-1])]
                bad = np.diff(np.concatenate([[0], np.cumsum(~good[which])])[rows])
                none = batch.column(1).slice(lo, hi - lo).is_null()
                lists = pa.ListArray.from_arrays(pa.array(ends[rows], pa.int32()), pa.array(values, pa.int32()), mask=none)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), lists, pa.array(np.diff(ends[rows]), pa.int64()), pa.array(bad == 0)], names=["doc_id", "ids", "n_pieces", "round_trip"])

    return bounded(docs).select("doc_id", _escaped(F.col("text"))).mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    model = model_at(path)

    def batch(cols: dict[str, list]) -> dict[str, list]:
        return {"doc_id": cols["doc_id"], "text": [None if x is None else model.decode(x) for x in cols["ids"]]}

    return map_slices(encoded.select("doc_id", "ids"), batch, "doc_id long, text string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
