"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups are equal texts.  Every group is placed on the shard where the dot product of group and residual capacity is
highest, the groups with the largest share of a total first.  A group that holds ``1 / (shards * HEAVY)`` of some
total or more is heavy: there are at most ``3 * shards * HEAVY`` of those, so they are gathered and placed together.
What capacity they leave is dealt to tasks of about ``PER_TASK`` of the other groups in proportion to what the tasks
hold, and each task places its groups in its part of every shard.  A group larger than ``1 / (shards * SPLIT)`` of a
total is split by doc_id into several items, so that no group of copies makes a shard uneven or lands in one task.

Slots are numbered within (shard, hash bucket) and shifted by the buckets' counts, so no task holds a whole shard.

Defined results: a null text has no bytes and checksum 0 and forms a group with other null texts; repeated rows
each get a slot of their own; groups of one size go in the order of their keys, shards that suit alike in a rotation
that the task's number begins; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.decontaminate import text_key
from casewright.session import cut

HEAVY, SPLIT, PER_TASK, PER_BUCKET = 256, 8, 16384, 50_000
SIZES = ("bytes", "tokens", "rows")


def pack(items: np.ndarray, shards: int, residual: np.ndarray | None = None, first: int = 0) -> np.ndarray:
    """The shard of each item (rows of shares of the capacities), by largest dot product of item and residual capacity.

    Items go in order of their largest share, then as they come.  ``residual`` (default: even shares) is what each
    shard can take; it is changed, and may become negative.  ``first``: the shard that wins a tie.
    """
    residual = np.full((shards, items.shape[1]), 1 / shards) if residual is None else residual
    turned = np.roll(residual, -first, axis=0)
    out = np.zeros(len(items), np.int32)
    for i in np.argsort(-items.max(axis=1), kind="stable"):
        s = int(np.argmax(turned @ items[i]))
        turned[s] -= items[i]
        out[i] = (s + first) % shards
    residual[:] = np.roll(turned, first, axis=0)
    return out


def _shares(rows: pd.DataFrame, total: dict) -> np.ndarray:
    return rows[list(SIZES)].to_numpy(float) / [max(1, total[c]) for c in SIZES]


def _place_light(groups: DataFrame, total: dict, residual: np.ndarray) -> DataFrame:
    """(a, b, shard) of the groups (a, b and sizes) that are not heavy, placed in tasks."""
    tasks = max(1, -(-groups.count() // PER_TASK))
    whole = groups.agg(*[F.sum(c).alias(c) for c in SIZES]).first().asDict()
    light = np.array([max(1e-12, (whole[c] or 0) / max(1, total[c])) for c in SIZES])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts).sort_values(["a", "b"])
        share = _shares(rows, total)
        number = TaskContext.get().partitionId() if TaskContext.get() else 0
        yield rows[["a", "b"]].assign(shard=pack(share, len(residual), residual * (share.sum(axis=0) / light), number % len(residual)))

    return groups.repartition(tasks, "a", "b").mapInPandas(task, "a long, b long, shard int")


def shard_documents(documents: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row; the law is ``bytes``."""
    text = F.col("text")
    key = text_key(text)
    rows = cut(
        documents.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long").alias("tokens"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            key.a.alias("a"),
            key.b.alias("b"),
            F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id()).alias("one"),
        )
    )
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    total = rows.agg(*sums).first().asDict()
    if not total["rows"]:
        return _with_slots(rows.withColumn("shard", F.lit(0)), shards, 0)
    share = F.greatest(*[F.col(c) / F.lit(float(max(1, total[c]))) for c in SIZES])
    groups = cut(rows.groupBy("a", "b").agg(*sums).withColumn("share", share))
    heavy = groups.where(F.col("share") * (shards * HEAVY) >= 1)
    pieces = F.when(F.col("share") * (shards * SPLIT) > 1, F.ceil(F.col("share") * (shards * SPLIT * 4))).otherwise(1).cast("int")
    # At most 3 * shards * HEAVY groups are heavy, so this side may be gathered and broadcast.
    heavy = F.broadcast(heavy.select("a", "b", pieces.alias("pieces")))
    pieced = rows.join(heavy, ["a", "b"]).withColumn("piece", F.pmod(F.xxhash64("one", F.lit("piece")), F.col("pieces")))
    items = pieced.groupBy("a", "b", "piece").agg(*sums).toPandas().sort_values(["a", "b", "piece"])
    residual = np.full((shards, len(SIZES)), 1 / shards)
    items["shard"] = pack(_shares(items, total), shards, residual)
    found = documents.sparkSession.createDataFrame(items[["a", "b", "piece", "shard"]], "a long, b long, piece long, shard int")
    columns = ["doc_id", "size", "text_crc32", "a", "b", "shard"]
    placed = pieced.join(F.broadcast(found), ["a", "b", "piece"]).select(*columns)
    light = _place_light(groups.join(heavy, ["a", "b"], "left_anti").select("a", "b", *SIZES), total, residual)
    others = rows.join(heavy, ["a", "b"], "left_anti").join(light, ["a", "b"]).select(*columns)
    return _with_slots(cut(placed.unionAll(others)), shards, total["rows"])


def _with_slots(rows: DataFrame, shards: int, n: int) -> DataFrame:
    buckets = max(8, -(-n // (shards * PER_BUCKET)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "a", "b")
    # One row for each shard and bucket, that is for about PER_BUCKET documents.
    numbered = rows.withColumn("n", F.row_number().over(inside)).join(F.broadcast(offsets) if buckets <= 50_000 else offsets, ["shard", "bucket"])
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("n") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
