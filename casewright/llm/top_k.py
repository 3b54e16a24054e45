"""Exact top-k search by inner product over quantised vectors, with multi-resolution segment statistics.

Every vector is cut into 1, 4, 16, ... segments; each keeps the mean and the deviation of its segments.  For
segments of length L, ``|q - x|^2 >= sum L * ((mq - mx)^2 + (sq - sx)^2)``, so
``q.x <= sum L * (mq * mx + sq * sx)``: a bound that tightens from coarse to fine.  A candidate whose bound
falls below a query's floor is dropped; survivors of the finest level are scored exactly, in integers.  A floor is
the k-th best exact score so far; it starts from a sample of about ``SEED`` rows, so every task prunes from its first
row on.  A small slack covers rounding, so no true neighbour is lost, and the sample changes no result.

Statistics are computed once and kept beside the vectors.  Queries are dealt by hash into blocks of about ``block``
rows; one block at a time is gathered and broadcast (a bounded size), searched, written to a checkpoint and freed.

Defined results: a vector that is null, empty, of another length than its query, or that holds a null or
non-finite component takes no part, nor does a null vec_id.  Rows are told apart, not vec_ids: rows that repeat a
vec_id are candidates each (for each other too) and, where it is asked for, queries each.  Ties go to the smaller
vec_id.  Fewer candidates than k: all are returned.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.session import cut

SCHEMA = "query long, query_id long, vec_id long, score long"
EXACT = 2**53
SEED = 1024


def quantised(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v (array of floor(scale * x)) for the rows that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * float(scale)))
    kept = embeddings.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def levels(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine: 1, 4, 16, ... up to a quarter of the dimensions."""
    out = [1]
    while out[-1] * 4 <= max(1, dim // 4):
        out.append(out[-1] * 4)
    return out


def statistics(m: np.ndarray, segments: int) -> np.ndarray:
    """Rows [sqrt(L) * mean, sqrt(L) * deviation] by segment: their inner products bound those of the rows."""
    cuts = np.linspace(0, m.shape[1], segments + 1).astype(int)
    length = np.diff(cuts)
    total = np.add.reduceat(m, cuts[:-1], axis=1)
    square = np.add.reduceat(m * m, cuts[:-1], axis=1)
    mean = total / length
    deviation = np.sqrt(np.maximum(square / length - mean * mean, 0))
    return np.hstack([mean, deviation]) * np.sqrt(np.hstack([length, length]))


def _keep(best: tuple, q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple:
    """The k best of what was kept and what is new, for each query (best first, ties to the smaller id)."""
    q, ids, score = (np.concatenate(pair) for pair in zip(best, (q, ids, score), strict=True))
    order = np.lexsort((ids, -score, q))
    q = q[order]
    start = np.r_[0, np.flatnonzero(np.diff(q)) + 1]
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)])) if len(q) else np.arange(0)
    order = order[rank < k]
    return q[rank < k], ids[order], score[order]


def prepared(vectors: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id, dim, v (its numbers as bytes) and s (the statistics of all levels, as bytes)."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, rows in b.groupby(b.v.map(len)):
                m = np.stack(rows.v.to_list()).astype(np.int64)
                s = np.hstack([statistics(m.astype(np.float64), n) for n in levels(dim)])
                yield pd.DataFrame({"row": rows.row, "vec_id": rows.vec_id, "dim": dim, "v": [x.tobytes() for x in m], "s": [x.tobytes() for x in s]})

    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
    return cut(numbered.mapInPandas(task, "row long, vec_id long, dim int, v binary, s binary"))


def _matrix(values: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


@dataclass
class Block:
    """Queries of one length: row numbers, ids, numbers, statistics by level, and the floor of each."""

    rows: np.ndarray
    ids: np.ndarray
    m: np.ndarray
    s: np.ndarray
    floor: np.ndarray

    @staticmethod
    def of(queries: pd.DataFrame, sample: pd.DataFrame, k: int) -> Block:
        rows, m = queries.row.to_numpy(np.int64), _matrix(queries.v, np.int64)
        floor = np.full(len(rows), -np.inf)
        if len(sample) > k:
            score = m.astype(np.float64) @ _matrix(sample.v, np.int64).astype(np.float64).T
            score[rows[:, None] == sample.row.to_numpy(np.int64)[None, :]] = -np.inf
            floor = np.partition(score, len(sample) - k, axis=1)[:, len(sample) - k]
            floor -= np.abs(floor) * 1e-9 + 1e-3
        return Block(rows, queries.vec_id.to_numpy(np.int64), m, _matrix(queries.s, np.float64), floor)

    def levels(self) -> list[slice]:
        ends = np.cumsum([0, *(2 * n for n in levels(self.m.shape[1]))])
        return [slice(lo, hi) for lo, hi in zip(ends[:-1], ends[1:], strict=True)]


def search_block(block: Block, batches: Iterator[pd.DataFrame], k: int, chunk: int = 2048, pruned: list[int] | None = None):
    """Top k of one partition's candidates for a block of queries; ``pruned`` counts [pairs, pairs scored] if given."""
    dim = block.m.shape[1]
    qf = block.m.astype(np.float64)
    most = np.abs(qf).max(initial=0)
    best: tuple = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    floor = block.floor.copy()
    for batch in batches:
        batch = batch[batch.dim == dim]
        for at in range(0, len(batch), chunk):
            part = batch.iloc[at : at + chunk]
            ids, x, xs = part.vec_id.to_numpy(np.int64), _matrix(part.v, np.int64), _matrix(part.s, np.float64)
            alive = block.rows[:, None] != part.row.to_numpy(np.int64)[None, :]
            for level in block.levels():
                bound = block.s[:, level] @ xs[:, level].T
                alive &= bound * (1 + 1e-9) + 1e-3 + 1e-9 * np.abs(bound) >= floor[:, None]
                if alive.mean() < 0.02:
                    break
            xf = x.astype(np.float64)
            if pruned is not None:
                pruned[0] += alive.size
                pruned[1] += int(alive.sum())
            if most * np.abs(xf).max(initial=0) * dim < EXACT and alive.mean() > 0.2:
                full = qf @ xf.T
                qi, xi = np.nonzero(alive & (full >= floor[:, None]))
                score = full[qi, xi].astype(np.int64)
            else:
                qi, xi = np.nonzero(alive)
                score = np.empty(len(qi), np.int64)
                for s in range(0, len(qi), 1 << 16):
                    score[s : s + (1 << 16)] = np.einsum("ij,ij->i", block.m[qi[s : s + (1 << 16)]], x[xi[s : s + (1 << 16)]])
            if not len(qi):
                continue
            best = _keep(best, qi, ids[xi], score, k)
            count = np.bincount(best[0], minlength=len(floor))
            last = np.cumsum(count) - 1
            full_now = count >= k
            floor[full_now] = np.maximum(floor[full_now], best[2][last[full_now]])
    yield pd.DataFrame({"query": block.rows[best[0]], "query_id": block.ids[best[0]], "vec_id": best[1], "score": best[2]})


def top_k(vectors: DataFrame, wanted: Column, k: int = 10, block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` that is ``wanted``, the k other rows with the largest
    inner product.

    ``vectors`` holds vec_id and v (array<long>), as from :func:`quantised`; ``wanted`` is a condition on vec_id.
    """
    spark = vectors.sparkSession
    vectors = prepared(vectors)
    queries = vectors.where(wanted)
    blocks = max(1, -(-queries.count() // block))
    every = max(1, vectors.count() // SEED)
    sample = vectors.where(F.pmod(F.xxhash64("row", F.lit("seed")), F.lit(every)) == 0).select("row", "dim", "v").toPandas()
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    found = []
    for b in range(blocks):
        rows = dealt.where(F.col("block") == b).drop("block").toPandas()
        for dim, same in rows.groupby("dim"):
            held = spark.sparkContext.broadcast(Block.of(same, sample[sample.dim == dim], k))

            def task(batches, held=held):
                return search_block(held.value, batches, k)

            found.append(cut(vectors.mapInPandas(task, SCHEMA)))
            held.destroy()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = F.expr(f"slice(array_sort(collect_list(struct(-score as s, vec_id))), 1, {int(k)})")
    merged = reduce(DataFrame.unionAll, found)
    # Two steps: first within salted parts, so no task gathers one query's rows from all partitions.
    salted = merged.groupBy("query", "query_id", F.pmod(F.xxhash64("vec_id"), F.lit(16)).alias("part")).agg(best.alias("b"))
    rows = salted.select("query", "query_id", F.explode("b").alias("x")).select("query", "query_id", "x.vec_id", (-F.col("x.s")).alias("score"))
    ranked = rows.groupBy("query", "query_id").agg(best.alias("b")).select("query_id", F.posexplode("b").alias("p", "x"))
    return ranked.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))


def search_multiples(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """Queries: rows whose vec_id is divisible by ``every``; candidates: all rows but the query's own."""
    return top_k(quantised(embeddings), F.col("vec_id") % every == 0, k)
