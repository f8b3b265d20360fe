"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of quality 1; unlabelled documents are a sample of the whole table. A small
network over the whole text's hashed n-grams (words, pairs of words, and runs of four bytes, each kind as the square root
of its shares) and some counts of its surface is trained to minimise the non-negative unbiased risk

    pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))

with logistic loss; where the second part falls below zero its gradient is reversed. The class prior pi is estimated from
a first pass: a network learns positives against unlabelled texts from one half of both; on the other half, the smallest ratio of upper tails (the share of
unlabelled texts above a score over the share of positives above it), taken where tails are large enough.

Trained on bounded samples (``rows`` positives and ``rows`` unlabelled texts in hash order, of those over ``max_chars``
characters an excerpt from all parts); whole texts of all documents are scored. Labels of fold 0 are never read, nor are
labels of quality 0.
Defined cases: null and empty texts have the features of an empty text and are scored as such; an empty table gives an
empty one; without a positive every score is 1 (nothing is rejected on no evidence); repeated rows and ids score alike;
other columns, whatever their names, pass through (``keep_good``) or are ignored (``score``).
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, fold, keep_where, labelled_sample, lower_ascii, map_slices, mix64, table, word_hashes, words_of

_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-]|_")
_RUN = re.compile(r"([^\w\s])\1")
SURFACE = 15
#: Buckets of each kind of n-gram.
BUCKETS = 1 << 10
KINDS = 3
FEATURES = SURFACE + KINDS * BUCKETS
#: Weight of n-grams beside standardised counts.
GRAM_SCALE = 1.0
_ROLL = 1 << 20


def grams(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed words, pairs of words and runs of four bytes, lower-cased; zeros without any."""
    out = np.zeros((KINDS, BUCKETS), dtype=np.float32)
    raw = lower_ascii(text.encode("utf-8", "surrogatepass")) if text else b""
    w = word_hashes(raw)
    mask = np.uint64(BUCKETS - 1)
    if len(w):
        out[0] = np.bincount((w & mask).astype(np.int64), minlength=BUCKETS) / len(w)
    if len(w) > 1:
        out[1] = np.bincount((mix64(w[:-1] * BASE + w[1:]) & mask).astype(np.int64), minlength=BUCKETS) / (len(w) - 1)
    if (n := len(raw) - 3) > 0:
        count = np.zeros(BUCKETS, dtype=np.int64)
        c = np.frombuffer(raw, dtype=np.uint8)
        for lo in range(0, n, _ROLL):  # bounded memory for very long texts
            hi = min(n, lo + _ROLL)
            four = sum(c[lo + i : hi + i].astype(np.uint32) << np.uint32(8 * i) for i in range(4))
            count += np.bincount((four * np.uint32(2654435769)) >> np.uint32(22), minlength=BUCKETS)
        out[2] = count / n
    return np.sqrt(out).ravel()


def features(text: str | None) -> np.ndarray:
    """Counts of the surface, then n-grams."""
    return np.concatenate([np.array(surface(text), dtype=np.float32), grams(text)])


def surface(text: str | None) -> list[float]:
    """Of the whole text; shares unless said otherwise."""
    t = text or ""
    w = words_of(t)
    n, m = len(w), max(1, len(w))
    size = max(1, len(t))
    lines = [x for x in t.split("\n") if x.strip()]
    letters = sum(x[-1:].isalpha() for x in w)
    raw = t.encode("utf-8", "surrogatepass")
    packed = len(zlib.compress(raw, 1)) / max(1, len(raw)) if len(raw) < 1 << 22 else sum(len(zlib.compress(raw[i : i + (1 << 22)], 1)) for i in range(0, len(raw), 1 << 22)) / len(raw)
    same = sum(map(bytes.__eq__, w, w[1:])) / m
    symbols = len(_SYMBOL.findall(t))
    return [
        min(1.0, 12 * symbols / size), min(1.0, 20 * len(_RUN.findall(t)) / size), same, len(set(w)) / m, min(1.0, packed), letters / m,
        sum(len(x) == 1 for x in w) / m, min(2.0, size / m / 8), sum(map(t.count, "0123456789")) / size, sum(x[:1].isupper() for x in w) / m,
        sum(x.endswith((b".", b"!", b"?")) for x in w) / m, t.count("|") * 10 / size, len(set(lines)) / max(1, len(lines)), float(np.log1p(n) / 10), float(n == 0),
    ]


class Network:
    """One hidden layer; g > 0 means positive."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean.astype(np.float32), std.astype(np.float32)
        first = rng.normal(size=(FEATURES, hidden)) / np.sqrt(SURFACE)
        first[SURFACE:] *= 0.3
        self.p = [x.astype(np.float32) for x in (first, np.zeros(hidden), rng.normal(size=hidden) / np.sqrt(hidden), np.zeros(1))]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Surface counts standardised, n-grams centred; in place."""
        z = np.subtract(x, self.mean, out=x)
        z[:, :SURFACE] = np.clip(z[:, :SURFACE] / self.std[:SURFACE], -6, 6)
        z[:, SURFACE:] *= GRAM_SCALE
        return z

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.p[0] + self.p[1])
        return h, h @ self.p[2] + self.p[3][0]

    def back(self, z: np.ndarray, h: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        dh = d[:, None] * self.p[2] * (1 - h**2)
        return [z.T @ dh, dh.sum(0), h.T @ d, np.array([d.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(self.scaled(x))[1].astype(np.float64), -30, 30)))

    def train(self, pos: np.ndarray, unl: np.ndarray, pi: float | None, epochs: int = 20, batch: int = 512, rate: float = 0.005) -> Network:
        """On scaled features. With ``pi`` None: positives against unlabelled texts, for the prior."""
        rng = np.random.default_rng(3)
        m, v, step = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p], 0
        sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        for _ in range(epochs):
            for _ in range(max(1, len(unl) // batch)):
                zp, zu = pos[rng.integers(len(pos), size=batch)], unl[rng.integers(len(unl), size=batch)]
                (hp, gp), (hu, gu) = self.forward(zp), self.forward(zu)
                plus, minus, wild = (-sig(-gp) / batch, sig(gp) / batch, sig(gu) / batch)  # slopes of the mean losses
                if pi is None:
                    grads = [a + b for a, b in zip(self.back(zp, hp, plus), self.back(zu, hu, wild), strict=True)]
                else:
                    rest = np.logaddexp(0, gu).mean() - pi * np.logaddexp(0, gp).mean()
                    a, b = self.back(zu, hu, wild), self.back(zp, hp, -pi * minus)
                    if rest >= 0:
                        grads = [x + y + z for x, y, z in zip(self.back(zp, hp, pi * plus), a, b, strict=True)]
                    else:
                        grads = [-(x + y) for x, y in zip(a, b, strict=True)]
                step += 1
                for i, g in enumerate(grads):
                    g = (g + 1e-4 * self.p[i]).astype(np.float32)
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - np.float32(rate) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + np.float32(1e-8))
        return self


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Upper bound of the share of positives among unlabelled texts, from scores of both."""
    best = 1.0
    for t in np.quantile(pos, np.linspace(0.02, 0.9, 45)):
        p, u = (pos >= t).mean(), (unl >= t).mean()
        if p * len(pos) >= 50 and u * len(unl) >= 50:
            best = min(best, u / p)
    return float(np.clip(best, 0.05, 0.95))


def _matrix(texts: list[str]) -> np.ndarray:
    out = np.empty((len(texts), FEATURES), dtype=np.float32)
    for i, t in enumerate(texts):
        out[i] = features(t)
    return out


def learn(positives: list[str], unlabelled: list[str]) -> Network | None:
    if not positives or not unlabelled:
        return None
    pos, unl = _matrix(positives), _matrix(unlabelled)
    mean, std = unl.mean(0), unl.std(0) + 1e-3
    first = Network(mean, std)
    pos, unl = first.scaled(pos), first.scaled(unl)
    first.train(pos[::2], unl[::2], None, epochs=15)
    # log-odds of the half not learned from; of a single text there is no other half
    odds = [first.forward(x[1::2] if len(x) > 1 else x)[1] for x in (pos, unl)]
    pi = estimate_prior(*odds)
    net = Network(mean, std).train(pos, unl, pi)
    net.prior = pi
    return net


def fit(docs: DataFrame, labels: DataFrame, rows: int = 3000, max_chars: int = 20_000) -> Network | None:
    """Positives: quality 1 of rows whose crc32(doc_id) mod 5 is not 0. Unlabelled: any document, in hash order."""
    one = labels.where(F.col("quality") == 1)
    positives = [t for t, _ in labelled_sample(docs, one, "quality", fold("doc_id", 5) != 0, rows, max_chars)]
    every = docs.select("doc_id", F.lit(0).alias("wild"))
    unlabelled = [t for t, _ in labelled_sample(docs, every, "wild", F.lit(True), rows, max_chars)]
    return learn(positives, unlabelled)


def scorer(net: Network | None):
    """A function from texts to scores."""
    if net is None:
        return lambda texts: [1.0] * len(texts)
    return lambda texts: net.score(np.stack([features(t) for t in texts])).tolist() if texts else []


def score(docs: DataFrame, net: Network | None, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted)."""
    of = scorer(net)

    def batch(cols: dict[str, list]) -> dict[str, list]:
        s = of(cols["text"])
        return {"doc_id": cols["doc_id"], "score": s, "predicted": [int(x >= threshold) for x in s]}

    return map_slices(docs.select("doc_id", "text"), batch, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, net: Network | None, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that ``score`` would reject."""
    of = scorer(net)
    return keep_where(docs, "text", lambda texts: [x >= threshold for x in of(texts)])


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
