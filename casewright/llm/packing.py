"""Best-fit packing with conflicts: bins ordered by residual carry source and duplicate-cluster bitmaps.

Documents are cut into pieces of at most ``capacity`` tokens (runs of non-space characters): full pieces fill a bin
alone, the rest is packed.  A piece goes to the tightest bin that holds it and has neither its source nor its
duplicate cluster: the search starts at the bin of least sufficient residual and goes on to the next larger one
until a compatible bin is found; only without any is a bin opened.

Pieces are dealt evenly (round robin over a fixed, checkpointed table) to tasks, which pack windows of ``window``
pieces, largest first.  Memory is bounded by the window, and neither a hot source nor a large cluster can gather in
one task.  Bins never span windows; a window is a task's whole share, so only its last bins stay half empty.

Defined results: a text that is null or has no tokens gets one row with bin null; a null source conflicts with
nothing; null clusters likewise; repeated rows are packed separately (they conflict); pieces of one size go as they
come, bins of one residual by number; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.session import cut

CAPACITY, WINDOW, PER_TASK = 2048, 16384, 16384
SCHEMA = "doc_id long, piece int, first_token long, n_tokens long, bin long, bin_offset long"


def best_fit(sizes: Sequence[int], sources: Sequence[int], clusters: Sequence[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece; sources and clusters are small numbers, -1 for none."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    residuals: list[tuple[int, int]] = []  # (residual, bin) in order
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in order:
        size = sizes[i]
        source = 1 << sources[i] if sources[i] >= 0 else 0
        cluster = 1 << clusters[i] if clusters[i] >= 0 else 0
        at = bisect_left(residuals, (size, -1))
        while at < len(residuals):  # successor search: on to the next tightest until one is compatible
            b = residuals[at][1]
            if not (source_bits[b] & source or cluster_bits[b] & cluster):
                break
            at += 1
        if at < len(residuals):
            residual, b = residuals.pop(at)
        else:
            residual, b = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        bins[i], offsets[i] = b, capacity - residual
        source_bits[b] |= source
        cluster_bits[b] |= cluster
        insort(residuals, (residual - size, b))
    return bins, offsets


def _numbers(values: pd.Series) -> list[int]:
    return pd.factorize(values)[0].tolist()


def pack_windows(batches: Iterator[pd.DataFrame], capacity: int, window: int) -> Iterator[pd.DataFrame]:
    """Packs one task's pieces, window by window; bins are numbered by task, then in order."""
    base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    used = 0

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        nonlocal used
        bins, offsets = best_fit(rows.n_tokens.tolist(), _numbers(rows.source), _numbers(rows.cluster), capacity)
        out = rows[["doc_id", "piece", "first_token", "n_tokens"]].copy()
        out["bin"] = np.array(bins, np.int64) + base + used
        out["bin_offset"] = offsets
        used += max(bins, default=-1) + 1
        return out

    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        while len(held) >= window:
            yield packed(held.iloc[:window])
            held = held.iloc[window:].reset_index(drop=True)
    if held is not None and len(held):
        yield packed(held)


def text_cluster(text: Column) -> Column:
    """Cluster of a text by itself: equal up to case and spacing."""
    return F.xxhash64(F.regexp_replace(F.trim(F.lower(text)), r"\s+", " "))


def pack_documents(documents: DataFrame, cluster: Column | None = None, capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, bin and bin_offset: one row for every piece of every row.

    Reads doc_id, text and source; ``cluster`` is a long column (default: texts equal up to case and spacing).
    """
    text = F.col("text")
    n = F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")
    own = F.when(text.isNotNull(), text_cluster(text) if cluster is None else cluster)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("source").alias("h"), F.col("source").isNull().alias("free"), own.alias("cluster"), n.alias("n"))
    rows = rows.select("doc_id", F.when(~F.col("free"), F.col("h")).alias("source"), "cluster", "n")
    last = F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("int") - 1
    pieces = rows.select("*", F.explode_outer(F.sequence(F.lit(0), last)).alias("piece"))
    first = F.col("piece").cast("long") * capacity
    pieces = cut(pieces.select("doc_id", "source", "cluster", "piece", first.alias("first_token"), F.least(F.lit(capacity), F.col("n") - first).alias("n_tokens")))
    some = pieces.where("n_tokens > 0")
    tasks = max(1, -(-some.count() // PER_TASK))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return pack_windows(batches, capacity, window)

    packed = some.repartition(tasks).mapInPandas(task, SCHEMA)
    none = pieces.where("n_tokens = 0").select("doc_id", "piece", "first_token", "n_tokens", F.lit(None).cast("long").alias("bin"), F.lit(None).cast("long").alias("bin_offset"))
    return packed.unionByName(none)
