"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class gets a mean and a covariance that is shrunk towards the pooled one and towards a scaled identity.  The
two Cholesky factors are computed once, cached in the model and broadcast; a score is the logistic of the
calibrated difference of the two Gaussian log-densities (squared Mahalanobis distances by forward substitution).

Only labelled rows outside the held-out remainder are learned from: about ``learning.MAX_LABELLED`` of them at
most.  Inputs are statistics of the whole text alone.

Defined results: a null text scores as the empty text; repeated rows score alike; with no labelled rows of
either class every score is the share of good labels (0.5 without any); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.learning import fit_logistic, remainder, sigmoid, training_rows

MODULUS, HELD = 5, 0
THRESHOLD = 0.3
FEATURES = 14

_CLASS = np.zeros(256, np.int8)  # of bytes: 0 other ASCII symbol, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence mark, 6 non-ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[[32, 9, 10, 11, 12, 13]] = 4
_CLASS[[ord(c) for c in ".,;:'\"-?()"]] = 5


def _share(part: float, whole: float) -> float:
    """Variance-stabilised share: the arcsine of its square root."""
    return float(np.arcsin(np.sqrt(min(1.0, part / whole)))) if whole else 0.0


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one whole text."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    by = np.bincount(_CLASS[data], minlength=7) if len(data) else np.zeros(7)
    words = text.split()
    n, size = len(words), len(data)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = by[1] + by[2] + by[6]
    short = sum(1 for w in words if not any(map(str.isalnum, w[:2]))) if n else 0
    return [
        np.log1p(n),
        np.log1p(size / n) if n else 0.0,
        _share(by[2], letters),
        _share(by[0], size),
        _share(by[3], size),
        _share(by[5], size),
        _share(by[6], size),
        np.log1p(by[0]),
        np.log1p(by[2]) - np.log1p(n),
        _share(len(set(words)), n) - 0.05 * np.log1p(n),
        _share(sum(map(eq, words, words[1:])), n),
        _share(len(lines) - len(set(lines)), len(lines)),
        np.log1p(n / len(lines)) if lines else 0.0,
        _share(short, n),
    ]


def forward(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of ``factor @ x = b`` for a lower triangular factor, row by row."""
    x = np.empty_like(b)
    for i in range(len(b)):
        x[i] = (b[i] - (factor[i, :i, None] * x[:i]).sum(0)) / factor[i, i]
    return x


class Discriminant:
    """Two shrunken Gaussians with cached Cholesky factors, and a calibration of their log-density difference."""

    def __init__(self, x: np.ndarray, y: np.ndarray, to_pooled: float = 0.1, to_identity: float = 0.02):
        self.base = float(y.mean()) if len(y) else 0.5
        self.parts = None
        if len(y) == 0 or y.min() == y.max():
            return
        self.centre, self.spread = x.mean(0), x.std(0) + 1e-6
        z = (x - self.centre) / self.spread
        groups = [z[y == k] for k in (0, 1)]
        pooled = sum((g - g.mean(0)).T @ (g - g.mean(0)) for g in groups) / len(z)
        self.parts = []
        for g in groups:
            own = (g - g.mean(0)).T @ (g - g.mean(0)) / len(g)
            weight = to_pooled + (1 - to_pooled) * x.shape[1] / (x.shape[1] + len(g))  # fewer rows, more shrinkage
            s = (1 - weight) * own + weight * pooled
            s = (1 - to_identity) * s + to_identity * np.trace(s) / len(s) * np.eye(len(s))
            factor = np.linalg.cholesky(s)
            self.parts.append((g.mean(0), factor, 2 * np.log(np.diag(factor)).sum()))
        self.w = np.array([1.0, 0.0])
        d = self.difference(x)
        w = fit_logistic(d[:, None], y.astype(float), ridge=1e-3)
        if w[0] > 0:
            self.w = w

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log p(x | good) - log p(x | poor), squashed where both are far away."""
        z = (x - self.centre) / self.spread
        low, high = (-0.5 * (forward(factor, (z - m).T) ** 2).sum(0) - 0.5 * logdet for m, factor, logdet in self.parts)
        return np.arcsinh((high - low) / 4)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.base)
        return sigmoid(self.difference(x) * self.w[0] + self.w[1])


def features_of(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), FEATURES)


def fit(documents: DataFrame, labels: DataFrame, modulus: int = MODULUS, held: int = HELD) -> Discriminant:
    """The model, from labelled rows outside the held-out remainder."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": list(features_of(b.text)), "y": b.y})

    rows = training_rows(documents, labels, "quality", modulus, held).mapInPandas(task, "x array<double>, y int").toPandas()
    rows = rows.iloc[np.lexsort((rows.y, rows.x.map(tuple)))] if len(rows) else rows  # in one order, whatever the partitions
    x = np.stack(rows.x.to_list()) if len(rows) else np.empty((0, FEATURES))
    return Discriminant(x, rows.y.to_numpy())


def scorer(documents: DataFrame, model: Discriminant) -> Column:
    """The score column of ``documents`` (its column text is read)."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(held.value.score(features_of(texts)))

    return score(F.col("text"))


def score_quality(documents: DataFrame, labels: DataFrame, modulus: int = MODULUS, held: int = HELD, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = fit(documents, labels, modulus, held)
    rows = documents.select("doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), scorer(documents, model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` that score ``threshold`` or more, with all their columns."""
    model = fit(documents, labels)
    return documents.where(scorer(documents, model) >= threshold)
