"""A quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; the rest of the corpus is unlabelled, a mixture of good and bad whose
share of good, the class prior, is estimated from the training labels. The non-negative risk of a linear model with
logistic loss is minimised: prior * loss of positives as positive, plus the loss of unlabelled as negative less
prior * loss of positives as negative; where that difference falls below zero, which no true risk can, the step
raises it instead. Labels of held-out documents take no part.

Features describe the form of a text only: shares of kinds of characters, lengths, repetition, and word shapes hashed
to a fixed number of bins. They are computed where the texts are; the driver sees the bounded training sample alone.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Bounds of the training sample: positives, and unlabelled documents.
MAX_POSITIVE, MAX_UNLABELLED = 6000, 12000
FOLDS, HELD_OUT = 3, 1
BINS = 64
_SHAPE = bytes(
    97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)
)
_RUNS = re.compile(rb"(.)\1+", re.S)
DIM = 12 + BINS


def features(text: str) -> list[float]:
    """The form of one whole text as ``DIM`` numbers.

    Without a word: the intercept, lengths and shares of characters of 0, and the shares of repetition that one word has.
    """
    raw = text.encode()
    words = raw.split()
    out = [0.0] * DIM
    if not words:
        out[0] = out[8] = out[9] = out[10] = out[11] = 1.0
        return out
    n, size = len(words), len(raw)
    shape = raw.translate(_SHAPE)
    small, large, digits, spaces = (shape.count(c) for c in (b"a", b"A", b"0", b" "))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    triples = n - 2
    out[:12] = [
        1.0,
        small / size,
        large / size,
        digits / size,
        (size - small - large - digits - spaces) / size,
        min(1.0, (size - spaces) / n / 20),
        np.log1p(n) / 10,
        min(n, 50) / 50,
        len(set(words)) / n,
        len(set(zip(words, words[1:], words[2:], strict=False))) / triples if triples > 0 else 1.0,
        len(set(lines)) / len(lines),
        max(Counter(words).values()) / n,
    ]
    for word, times in Counter(_RUNS.sub(rb"\1", shape).split()).items():
        out[12 + crc32(word) % BINS] += times / n
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def risk(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the unbiased risk: of positives as positive, and of the rest as negative."""
    p, u = positive @ w, unlabelled @ w
    loss = lambda x: np.logaddexp(0, -x).mean()
    return prior * loss(p), loss(-u) - prior * loss(-p)


def step(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """The direction to go against: the gradient of the risk, or, where its second part is negative, of that part's rise."""
    p, u = positive @ w, unlabelled @ w
    toward = -prior * ((1 - sigmoid(p)) @ positive) / len(p)
    away = sigmoid(u) @ unlabelled / len(u) - prior * (sigmoid(p) @ positive) / len(p)
    return toward + away if risk(w, positive, unlabelled, prior)[1] >= 0 else -away


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 800, rate: float = 0.05, ridge: float = 1e-4) -> np.ndarray:
    """Weights that minimise the non-negative risk, by full-batch Adam."""
    w, m, v = (np.zeros(positive.shape[1]) for _ in range(3))
    for t in range(1, rounds + 1):
        g = step(w, positive, unlabelled, prior) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves the remainder kept for testing; a null id is hashed as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def _matrix(docs: DataFrame, chosen: DataFrame) -> np.ndarray:
    """Features of the chosen documents, at most as many as the bounds above."""
    of = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text")
    found = map_texts(of, lambda texts: [[features(t) for t in texts]], ["x array<double>"])
    rows = found.groupBy("doc_id").agg(F.min("x").alias("x")).toPandas().sort_values("doc_id")
    return np.array(rows["x"].tolist()).reshape(-1, DIM)


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> np.ndarray:
    """The weights, from training-fold labels and unlabelled training-fold documents, both in hash order of ids.

    The prior is the share of good documents among all training labels. Without a positive or an unlabelled
    document the weights are zero, and every score one half.
    """
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = usable.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    ids = docs.select("doc_id").dropna().filter(~held_out(F.col("doc_id"))).distinct()
    order = F.xxhash64("doc_id")
    good = ids.join(usable.filter("quality = 1").select("doc_id").distinct(), "doc_id").orderBy(order, "doc_id").limit(max_positive)
    rest = ids.orderBy(order, "doc_id").limit(max_unlabelled)
    positive, unlabelled = _matrix(docs, good), _matrix(docs, rest)
    if not len(positive) or not len(unlabelled):
        return np.zeros(DIM)
    return fit(positive, unlabelled, min(max(share, 0.01), 0.99))


def classify(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1, higher for better), ``predicted`` (1 if 0.5 or more).

    Whole texts are scored, null as empty; a text without words is scored like a
    text of one word without characters. One row comes out for each row.
    """

    def score(texts: list[str]) -> list[list]:
        return [sigmoid(np.array([features(t) for t in texts]) @ weights).tolist()]

    scored = map_texts(docs, score, ["score double"], text=text)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
