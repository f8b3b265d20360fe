"""Toxicity: subword bags averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams (3 to 6, with word boundaries, and the word itself),
hashed into BUCKETS rows, so a misspelling or an ending that was never seen shares most of its bag with known words. A
passage is SPAN consecutive words (a shorter text is one passage); its vector is the mean of its words' vectors, and a
softmax over (clean, toxic) scores it. Vectors and softmax are trained together by Adagrad on the text's label, a text
being clean if all its passages are (the product of their probabilities). Then a text counts as toxic as its most toxic
passage, so one insult in a long text is not averaged away, and joining clean texts adds no evidence: scores do not add up
with length. A logistic curve, fitted on the training texts, turns that passage's log-odds into the text's probability.

Only a bounded sample of labelled texts is trained on (``rows`` texts in hash order, of those over ``max_chars``
characters an excerpt from all parts); whole texts of all documents are scored. Defined cases: null and empty texts and
those without a word score 0; an empty table gives an empty one; repeated rows and ids score alike; without a labelled row
every score is 0; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, labelled_sample, map_slices, table

BUCKETS = 1 << 16
DIM = 8
SIZES = (3, 4, 5, 6)
#: Words of a passage.
SPAN = 2
_WORD = re.compile(r"[^\W_]+")
#: Words of a clean text that a training step looks at.
PART = 96
#: Words that a worker remembers the score of, and the longest of them.
CACHE, CACHE_CHARS = 400_000, 64
#: A small sample is gone through more often.
MIN_STEPS = 400


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def bag(word: str) -> list[int]:
    w = f"<{word}>"
    n = len(w)
    parts = {w[i : i + k] for k in SIZES for i in range(n - k + 1)}
    parts.add(w)
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for p in parts]


def passages(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, text) of every passage of texts of ``n`` words each (one at least), in order."""
    count = np.maximum(n - SPAN + 1, 1)
    text = np.repeat(np.arange(len(n)), count)
    begin = np.cumsum(n) - n
    first = begin[text] + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return first, np.minimum(n, SPAN)[text], text


class Model:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vectors = (rng.normal(size=(BUCKETS, DIM)) * 0.05).astype(np.float32)
        self.out = (rng.normal(size=(DIM, 2)) * 0.3).astype(np.float32)
        self.bias = np.array([3.0, -3.0], dtype=np.float32)
        #: Of the curve from a passage's log-odds to a text's.
        self.slope, self.shift = 1.0, 0.0

    def forward(self, texts: list[np.ndarray], flat: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
        """Log-odds of every passage of texts given as word numbers, and what the way back needs.

        flat: the bags of all words; begin: where each one's begins, and the end.
        """
        uniq, inv = np.unique(np.concatenate(texts), return_inverse=True)
        size = begin[uniq + 1] - begin[uniq]
        grams = flat[np.repeat(begin[uniq] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
        mean = np.add.reduceat(self.vectors[grams], np.cumsum(size) - size, axis=0) / size[:, None]
        z = mean @ self.out
        total = np.concatenate([[0.0], np.cumsum((z[:, 1] - z[:, 0])[inv], dtype=np.float64)])
        first, long, text = passages(np.array(list(map(len, texts))))
        odds = (total[first + long] - total[first]) / long + float(self.bias[1] - self.bias[0])
        return {"inv": inv, "grams": grams, "size": size, "mean": mean, "first": first, "long": long, "text": text, "odds": odds}

    def train(self, sample: list[tuple[str, int]], epochs: int = 16, batch: int = 48, rate: float = 0.5) -> Model:
        index: dict[str, int] = {}
        every = [(np.array([index.setdefault(w, len(index)) for w in ws], dtype=np.int64), int(v)) for t, v in sample if (ws := words(t))]
        if not every:
            return self
        rng = np.random.default_rng(11)
        epochs = max(epochs, -(-MIN_STEPS // max(1, len(every) // batch)))
        bags = [bag(w) for w in index]
        begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, bags), dtype=np.int64, count=len(bags)))])
        flat = np.fromiter(chain.from_iterable(bags), dtype=np.int64, count=int(begin[-1]))
        y = np.array([v for _, v in every])
        pos = max(1, int(y.sum()))
        weight = np.where(y == 1, min(4.0, max(1.0, (len(y) - pos) / pos)), 1.0)
        g_vec, g_out, g_bias = np.full(BUCKETS, 1e-3, np.float32), np.full((DIM, 2), 1e-3, np.float32), np.full(2, 1e-3, np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(every))
            for lo in range(0, len(order), batch):
                ids = order[lo : lo + batch]
                # a third of a toxic text's words are left out at random, so that no insult hides behind another; each
                # passage of a clean text is clean, so another part of it each time will do
                seen = []
                for i in ids:
                    t = every[i][0]
                    if y[i]:
                        left = rng.random(len(t)) < 0.67
                        seen.append(t[left] if left.any() else t)
                    else:
                        at = int(rng.integers(max(1, len(t) - PART + 1)))
                        seen.append(t[at : at + PART])
                f = self.forward(seen, flat, begin)
                odds, text = f["odds"], f["text"]
                edge = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
                p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
                clean = np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-7)), edge))
                # of the log loss by each passage's log-odds
                slope = np.where(y[ids] == 1, -clean / np.maximum(1 - clean, 1e-6), 1.0) * weight[ids] / len(ids)
                d_odds = slope[text] * p
                step = np.zeros(len(f["inv"]) + 1)
                np.add.at(step, f["first"], d_odds / f["long"])
                np.add.at(step, f["first"] + f["long"], -d_odds / f["long"])
                d = np.bincount(f["inv"], np.cumsum(step)[:-1], minlength=len(f["size"])).astype(np.float32)
                dz = np.stack([-d, d], axis=1)
                d_out, d_bias = f["mean"].T @ dz, np.array([-d_odds.sum(), d_odds.sum()], dtype=np.float32)
                d_vec = np.repeat((dz @ self.out.T) / f["size"][:, None], f["size"], axis=0)
                total = np.stack([np.bincount(f["grams"], d_vec[:, k], minlength=BUCKETS) for k in range(DIM)], axis=1).astype(np.float32)
                g_vec += (total**2).mean(axis=1)
                self.vectors -= rate * total / np.sqrt(g_vec)[:, None]
                g_out += d_out**2
                g_bias += d_bias**2
                self.out -= rate * d_out / np.sqrt(g_out)
                self.bias -= 0.3 * rate * d_bias / np.sqrt(g_bias)
        top = np.concatenate([self.highest([t for t, _ in every[lo : lo + batch]], flat, begin) for lo in range(0, len(every), batch)])
        self.slope, self.shift = curve(top, y)
        return self

    def highest(self, texts: list[np.ndarray], flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
        f = self.forward(texts, flat, begin)
        return np.maximum.reduceat(f["odds"], np.flatnonzero(np.concatenate([[True], f["text"][1:] != f["text"][:-1]])))

    def folded(self) -> tuple[np.ndarray, float]:
        """Softmax and curve are linear in the mean, so each bucket has one number and the bias another."""
        return self.slope * (self.vectors @ (self.out[:, 1] - self.out[:, 0])), self.slope * float(self.bias[1] - self.bias[0]) + self.shift


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of the logistic curve for labels ``y``, by Newton steps with a small penalty."""
    mean, std = float(x.mean()), float(x.std()) + 1e-9
    z, w = np.stack([(x - mean) / std, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(2), z.T @ (p - y) + 0.05 * w)
    slope = max(0.0, float(w[0])) / std
    return slope, float(w[1]) - slope * mean


def word_odds(fresh: list[str], odds: np.ndarray) -> np.ndarray:
    bags = [bag(w) for w in fresh]
    size = np.fromiter(map(len, bags), dtype=np.int64, count=len(bags))
    flat = np.fromiter(chain.from_iterable(bags), dtype=np.int64, count=int(size.sum()))
    return np.add.reduceat(odds[flat], np.cumsum(size) - size) / size


def score_text(text: str | None, odds: np.ndarray, bias: float, cache: dict[str, float]) -> float:
    """The probability of the most toxic passage of the whole text. ``cache``: a word's part of the log-odds."""
    got = words(text)
    if not got:
        return 0.0
    fresh = list({w for w in got if w not in cache})
    own = dict(zip(fresh, word_odds(fresh, odds).tolist(), strict=True)) if fresh else {}
    each = np.fromiter((own[w] if w in own else cache[w] for w in got) if own else map(cache.__getitem__, got), dtype=np.float64, count=len(got))
    if len(cache) > CACHE:
        cache.clear()
    cache.update((w, x) for w, x in own.items() if len(w) <= CACHE_CHARS)
    total = np.concatenate([[0.0], np.cumsum(each)])
    n = min(SPAN, len(got))
    return float(1 / (1 + np.exp(-np.clip((total[n:] - total[:-n]).max() / n + bias, -30, 30))))


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of whole texts."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    odds, bias = model.folded()

    def batch(cols: dict[str, list], cache: dict[str, float]) -> dict[str, list]:
        s = [score_text(t, odds, bias, cache) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "score": s, "predicted": [int(x >= threshold) for x in s]}

    return map_slices(docs.select("doc_id", "text"), batch, "doc_id long, score double, predicted int", dict)


def fit(docs: DataFrame, labels: DataFrame, rows: int = 4000, max_chars: int = 20_000) -> Model | None:
    """Trained on rows whose crc32(doc_id) mod 3 is not 1."""
    sample = labelled_sample(docs, labels, "toxic", fold("doc_id", 3) != 1, rows, max_chars)
    return Model().train(sample) if sample else None


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
