"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts is the number of character n-grams (1 to 4) that both have, over the
geometric mean of the numbers that each has. n-grams are hashed into DIM bits. Texts are mapped by Nystroem landmarks: a
text's kernel values with the landmarks, times the inverse square root of the landmarks' own kernel matrix; one-versus-rest
kernel ridge regression on these has one weight vector for each language. Kernel, root and weights are linear in a text's
presence vector, so scoring a batch is one product: the batch's (sparse) presence matrix times the matrix of DIM rows that
the landmarks' presence, their norms and the weights multiply to.

Trained on a bounded sample (``rows`` labelled texts in hash order; of those over ``max_chars`` characters an excerpt from
all parts of the text; ``landmarks`` of them landmarks); whole texts of all documents are scored. A language absent from
that sample is not learned.
Defined cases: a null text or one without a letter (Unicode category L) is ``und`` with score 0, and so is every text if
nothing was learned; an empty table gives an empty one; equal scores fall to the language first by name; repeated rows and
ids are scored each by its own text; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, codes, excerpt, fold, has_letter, map_slices, mix64, table

BITS = 18
DIM = 1 << BITS
SIZES = (1, 2, 3, 4)
#: Characters of a text whose n-grams are hashed at a time.
CHUNK = 1 << 20


def present(text: str, mask: np.ndarray | None = None) -> np.ndarray:
    """The hashed n-grams of the whole lower-cased text, white space as one separator: numbers below DIM, ascending.

    ``mask`` (DIM booleans, all false) is scratch space and comes back as it was.
    """
    mask = np.zeros(DIM, dtype=bool) if mask is None else mask
    whole = " " + " ".join(text.lower().split()) + " "
    for at in range(0, len(whole), CHUNK):
        c = codes(whole[at : at + CHUNK + SIZES[-1] - 1]).astype(np.uint64)
        h = np.zeros(len(c), dtype=np.uint64)
        for n in SIZES:
            m = len(c) - n + 1
            if m <= 0:
                break
            h = h[:m] * BASE + c[n - 1 : n - 1 + m]
            mask[(mix64(h + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)] = True
    got = np.flatnonzero(mask)
    mask[got] = False
    return got


class Classifier:
    """``matrix``: DIM rows, a column for each language."""

    def __init__(self, langs: list[str], matrix: np.ndarray):
        self.langs, self.matrix = langs, matrix

    @classmethod
    def train(cls, sample: list[tuple[str, str]], landmarks: int = 192, ridge: float = 0.1) -> Classifier | None:
        sample = [(t, y) for t, y in sample if has_letter(t)]
        if not sample:
            return None
        langs = sorted({y for _, y in sample})
        scratch = np.zeros(DIM, dtype=bool)
        own = [present(t, scratch) for t, _ in sample]
        # landmarks in turn from each language, so a rare one has some
        by = [[i for i, (_, y) in enumerate(sample) if y == lang] for lang in langs]
        marks = [i for turn in range(landmarks) for g in by for i in g[turn : turn + 1]][:landmarks]
        has = np.zeros((DIM, len(marks)), dtype=np.uint8)
        for j, i in enumerate(marks):
            has[own[i], j] = 1
        norm = np.sqrt([max(1, len(x)) for x in own])
        kernel = np.array([has[x].sum(axis=0, dtype=np.int64) for x in own]) / norm[:, None] / norm[marks][None, :]
        values, vectors = np.linalg.eigh(kernel[marks])
        root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
        phi = kernel @ root
        y = np.array([[1.0 if lang == own_lang else -1.0 for lang in langs] for _, own_lang in sample])
        # each language weighs alike
        counts = {lang: len(g) for lang, g in zip(langs, by, strict=True)}
        share = np.array([1 / counts[y] for _, y in sample])
        share *= len(sample) / share.sum()
        beta = np.linalg.solve(phi.T @ (phi * share[:, None]) + ridge * np.eye(len(marks)), phi.T @ (y * share[:, None]))
        weights = (root @ beta) / norm[marks][:, None]
        matrix = np.zeros((DIM, len(langs)), dtype=np.float32)
        for j, i in enumerate(marks):
            matrix[own[i]] += weights[j].astype(np.float32)
        return cls(langs, matrix)

    def predict(self, texts: list[str], scratch: np.ndarray | None = None) -> list[tuple[str, float]]:
        if not texts:
            return []
        scratch = np.zeros(DIM, dtype=bool) if scratch is None else scratch
        own = [present(t, scratch) for t in texts]
        n = np.array(list(map(len, own)))
        f = np.add.reduceat(self.matrix[np.concatenate(own)], np.cumsum(n) - n, axis=0) / np.sqrt(n)[:, None]
        best = f.argmax(axis=1)
        return [(self.langs[b], float(min(1.0, max(0.0, (x[b] + 1) / 2)))) for b, x in zip(best, f, strict=True)]


def fit(docs: DataFrame, rows: int = 3000, max_chars: int = 20_000) -> Classifier | None:
    """From text and lang of documents whose crc32(doc_id) mod 4 is not 2."""
    good = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 4) != 2)).select("doc_id", "text", "lang")
    # ids alone are ordered and limited, then their texts come, at most ``rows`` again: ids may repeat
    ids = good.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).distinct()
    got = good.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(rows)
    return Classifier.train([(r[0], r[1]) for r in got.select(excerpt("text", max_chars), "lang").collect()])


def identify(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """(doc_id, lang_pred, score) of whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batch(cols: dict[str, list], scratch: np.ndarray) -> dict[str, list]:
        texts, model = cols["text"], shared.value
        known = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        for i, (a, b) in zip(known, model.predict([texts[i] for i in known], scratch) if known else [], strict=True):
            lang[i], score[i] = a, b
        return {"doc_id": cols["doc_id"], "lang_pred": lang, "score": score}

    return map_slices(docs.select("doc_id", "text"), batch, "doc_id long, lang_pred string, score double", lambda: np.zeros(DIM, dtype=bool))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
