"""Shared parts of the trained scorers: hold-out rule, bounded labelled sample, logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on, at most (about; they are taken by a hash of doc_id).
MAX_LABELLED = 20_000


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))


def training_rows(documents: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, limit: int = MAX_LABELLED):
    """(text, y) of labelled ids outside the held-out remainder: all, or about ``limit`` by a hash of doc_id.

    An id that several rows carry counts once, with the text of the smallest hash, so the bound holds for rows too.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder(F.col("doc_id"), modulus) != held))
    known = known.groupBy("doc_id").agg(F.max(label).alias("y"))
    total = known.count()
    if total > limit:
        known = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) < int(limit / total * (1 << 30)))
    # The labelled side is bounded by ``limit``, so it may be broadcast.
    rows = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("t.text", "y")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights (intercept last) of a ridge logistic regression by Newton steps; the intercept is not shrunk."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    shrink = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = sigmoid(x1 @ w)
        gradient = x1.T @ (p - y) + shrink @ w
        hessian = (x1 * (p * (1 - p))[:, None]).T @ x1 + shrink
        step = np.linalg.solve(hessian + 1e-9 * np.eye(len(w)), gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
