"""Graph statistics: degree tables, histograms, decades, hubs, components and path lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.operators.components import components
from casewright.operators.edges import degrees
from casewright.operators.paths import distances, pair_distances
from casewright.session import cut

# Lower bounds of the two reports' degree bins.
BINS_A = [0, 1, 2, 3, 6, 11, 21, 51, 101, 501]
BINS_B = [0, 1, 2, 3, 4, 6, 11, 21, 51, 101, 501]


def histogram(values: DataFrame, column: str, bins: list[int]) -> DataFrame:
    """(bin, low, n, share) of the values; bins are given by their lower bounds."""
    low = F.lit(bins[0])
    for b in bins[1:]:
        low = F.when(F.col(column) >= b, F.lit(b)).otherwise(low)
    counted = values.groupBy(low.cast("int").alias("low")).agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy()  # over the bins, of which there are a dozen
    return counted.select("low", "n", F.round(F.col("n") / F.sum("n").over(total), 6).alias("share"))


def moments(values: DataFrame, column: str) -> DataFrame:
    return values.agg(F.round(F.avg(column), 6).alias("mean"), F.median(column).alias("median"), F.max(column).alias("max"))


def by_decade(nodes: DataFrame, year: Column) -> DataFrame:
    text = year.cast("string")
    return nodes.where(F.coalesce(text, F.lit("")) != "").groupBy(F.concat(F.substring(text, 1, 3), F.lit("0s")).alias("decade")).agg(F.count(F.lit(1)).alias("n"))


def top(nodes: DataFrame, by: str, n: int = 40) -> DataFrame:
    """The n rows with the largest ``by`` (ties: lowest id) and their rank; only n rows reach one task."""
    first = nodes.orderBy(F.desc(by), "id").limit(n)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), "id")))


def component_sizes(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(size, n): how many components have a size; isolated ``nodes`` count as components of one."""
    sizes = components(edges, "citing", "cited").groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    if nodes is not None:
        ends = edges.select(F.col("citing").alias("id")).union(edges.select("cited"))
        alone = nodes.select("id").join(ends, "id", "left_anti")
        sizes = sizes.unionByName(alone.select(F.col("id").alias("label"), F.lit(1).cast("long").alias("size")))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are among ``nodes``."""
    ids = nodes.select("id")
    return edges.join(ids, edges.citing == ids.id, "left_semi").join(ids, edges.cited == ids.id, "left_semi")


def remove_hubs(edges: DataFrame, k: int, by: str = "indeg") -> DataFrame:
    """Edges that touch none of the k nodes of the largest ``by`` (indeg, or degree), ties to the lowest id."""
    hubs = F.broadcast(degrees(edges).orderBy(F.desc(by), "id").limit(k).select("id"))
    return edges.join(hubs, edges.citing == hubs.id, "left_anti").join(hubs, edges.cited == hubs.id, "left_anti")


def remeasured(edges: DataFrame, k: int, by: str = "indeg", nodes: DataFrame | None = None) -> DataFrame:
    """One row (nodes, edges, components, largest, share) of the graph without its k hubs.

    With ``nodes`` the ones that the removal leaves alone stay, as components of one; else they are dropped.
    """
    kept = cut(remove_hubs(edges, k, by).select("citing", "cited"))
    sizes = components(kept, "citing", "cited").groupBy("label").agg(F.count(F.lit(1)).alias("size")).select("size")
    if nodes is not None:
        hubs = F.broadcast(degrees(edges).orderBy(F.desc(by), "id").limit(k).select("id"))
        ends = kept.select(F.col("citing").alias("id")).union(kept.select("cited"))
        alone = nodes.select("id").join(hubs, "id", "left_anti").join(ends, "id", "left_anti")
        sizes = sizes.unionAll(alone.select(F.lit(1).cast("long").alias("size")))
    n = kept.agg(F.count(F.lit(1)).alias("edges"))
    rows = sizes.agg(F.sum("size").alias("nodes"), F.count(F.lit(1)).alias("components"), F.max("size").alias("largest"))
    return rows.join(F.broadcast(n)).select("nodes", "edges", "components", "largest", F.round(F.col("largest") / F.col("nodes"), 6).alias("share"))


def sample_pairs(nodes: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n pairs (a, b) of distinct nodes, chosen by a seeded hash, so alike on any cluster; n is the sample's size."""
    order = lambda salt: F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt))
    pick = lambda salt: nodes.select("id").orderBy(order(salt), "id").limit(n)
    rank = lambda salt: F.row_number().over(Window.orderBy(order(salt), "id"))
    a = pick("a").select(F.col("id").alias("a"), rank("a").alias("r"))
    b = pick("b").select(F.col("id").alias("b"), rank("b").alias("r"))
    return a.join(b, "r").where("a <> b").select("a", "b")


def path_lengths(edges: DataFrame, pairs: DataFrame, depth: int | None, mode: str = "any", connected: bool = False) -> DataFrame:
    """(length, n, share, running): pairs by distance; length null for those beyond ``depth`` (None: no bound) or unreachable.

    ``connected``: all pairs are known to lie in one component.
    """
    if depth is None:
        found = pair_distances(edges, pairs, mode, connected)
    else:
        found = distances(edges, pairs.select(F.col("a").alias("id")).distinct(), depth, mode)
        found = found.select(F.col("source").alias("a"), F.col("id").alias("b"), "d")
    met = pairs.join(found, ["a", "b"], "left")
    counted = met.groupBy(F.col("d").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    every, upto = Window.partitionBy(), Window.orderBy(F.col("length").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(every)
    return counted.select("length", "n", F.round(F.col("n") / total, 6).alias("share"), F.round(F.sum("n").over(upto) / total, 6).alias("running"))
