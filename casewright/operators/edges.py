"""Edge tables: lookups, rollups, degrees, clean-up rules, folding of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import text as T
from casewright.operators.components import components
from casewright.session import cut, Scratch


def double_lookup(cites: DataFrame, owner: DataFrame) -> DataFrame:
    """(citing_opinion, cited_opinion, depth) with the clusters of both ends (null outside ``owner``).

    ``owner`` maps opinion to cluster.  Both joins are plain equi-joins; Spark broadcasts the map while it is small.
    """
    a = owner.select(F.col("opinion").alias("citing_opinion"), F.col("cluster").alias("citing"))
    b = owner.select(F.col("opinion").alias("cited_opinion"), F.col("cluster").alias("cited"))
    return cites.join(a, "citing_opinion", "left").join(b, "cited_opinion", "left")


def rollup(pairs: DataFrame) -> DataFrame:
    """Cluster edges without self edges: summed depth and the number of opinion pairs."""
    known = pairs.where("citing is not null and cited is not null and citing <> cited")
    return known.groupBy("citing", "cited").agg(F.sum("depth").alias("depth"), F.count(F.lit(1)).alias("opinion_pairs"))


def citing_counts(pairs: DataFrame) -> DataFrame:
    """For each cited cluster: citing opinions of all courts, and of known clusters (self cites included)."""
    return pairs.where("cited is not null").groupBy("cited").agg(
        F.count(F.lit(1)).alias("all_courts"), F.count_if(F.col("citing").isNotNull()).alias("known_courts")
    )


def degrees(edges: DataFrame) -> DataFrame:
    """(id, indeg, outdeg, degree) over the end points of ``edges``, in one shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("citing").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("cited").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    out = ends.select("e.*").groupBy("id").agg(F.sum("i").alias("indeg"), F.sum("o").alias("outdeg"))
    return out.withColumn("degree", F.col("indeg") + F.col("outdeg"))


def without(edges: DataFrame, excluded: DataFrame) -> DataFrame:
    """Edges that touch no excluded id and are no self loop."""
    x = excluded.select("id")
    kept = edges.where("citing <> cited").join(x, edges.citing == x.id, "left_anti")
    return kept.join(x, kept.cited == x.id, "left_anti")


def with_meta(edges: DataFrame, meta: DataFrame) -> DataFrame:
    """Edges with year, name and cite of both ends (null where unknown), as *_a (citing) and *_b (cited)."""
    side = lambda k, s: meta.select(F.col("id").alias(k), *[F.col(c).alias(f"{c}_{s}") for c in ("year", "name", "cite")])
    return edges.join(side("citing", "a"), "citing", "left").join(side("cited", "b"), "cited", "left")


def respects_time() -> Column:
    """Not forward in time: unknown years (null or 0) and the same year pass."""
    known = (F.coalesce("year_a", F.lit(0)) != 0) & (F.coalesce("year_b", F.lit(0)) != 0)
    return ~F.coalesce(known & (F.col("year_b") > F.col("year_a")), F.lit(False))


def is_same_case() -> Column:
    """Whether both ends of an edge with metadata are one and the same case."""
    return T.same_case(*[F.col(f"{c}_{s}") for s in "ab" for c in ("year", "cite", "name")])


def ordered(edges: DataFrame) -> DataFrame:
    """Edges by citing, then cited (a range-partitioned sort)."""
    return edges.orderBy("citing", "cited")


def typed_map(raw: DataFrame) -> DataFrame:
    """Opinion-level cites from text columns (citing_opinion, cited_opinion, depth): rows with an id that is no number
    are left out; an empty or null depth counts 1, and any other depth that is no number leaves its row out too."""
    number = lambda c: F.col(c).try_cast("long")
    empty = F.coalesce(F.trim("depth"), F.lit("")) == ""
    rows = raw.select(number("citing_opinion").alias("citing_opinion"), number("cited_opinion").alias("cited_opinion"), F.when(empty, F.lit(1)).otherwise(number("depth")).cast("long").alias("depth"))
    return rows.where("citing_opinion is not null and cited_opinion is not null and depth is not null")


def known_of(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` with a column known: whether their key is among ``keys`` (so that misses can be counted as well)."""
    held = keys.select(F.col(key)).distinct().withColumn("known", F.lit(True))
    return rows.join(held, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def fold_map(marked: DataFrame) -> DataFrame:
    """(id, canonical) of clusters folded into the best-connected one (ties: lowest id) of their component.

    ``marked``: edges with metadata; degrees count its rows, links are its pairs of one and the same case.
    """
    ends = marked.select("citing", "cited")
    degree = ends.select(F.col("citing").alias("id")).union(ends.select("cited")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    same = marked.where(is_same_case())
    labels = components(same, "citing", "cited").join(degree, F.col("node") == degree.id)
    best = labels.groupBy("label").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("canonical"))
    return labels.join(best, "label").where("node <> canonical").select(F.col("node").alias("id"), "canonical")


def remap(edges: DataFrame, fold: DataFrame) -> DataFrame:
    """Distinct edges between canonical ids, without the self loops that folding makes."""
    a = fold.select(F.col("id").alias("citing"), F.col("canonical").alias("to_a"))
    b = fold.select(F.col("id").alias("cited"), F.col("canonical").alias("to_b"))
    moved = edges.join(a, "citing", "left").join(b, "cited", "left")
    return moved.select(F.coalesce("to_a", "citing").alias("citing"), F.coalesce("to_b", "cited").alias("cited")).where("citing <> cited").distinct()


def giant(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id) of the largest component of the end points; ties go to the smallest label."""
    labels = components(edges, "citing", "cited", scratch)
    top = labels.groupBy("label").count().orderBy(F.desc("count"), "label").limit(1)
    return labels.join(F.broadcast(top.select("label")), "label", "left_semi").select(F.col("node").alias("id"))


def clean_graph(edges: DataFrame, meta: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The game graph's edges and the fold map: exclude, time, fold, related names, largest component, in this order."""
    marked = cut(with_meta(without(edges.select("citing", "cited"), excluded), meta).where(respects_time()))
    fold = cut(fold_map(marked))
    moved = with_meta(remap(marked.select("citing", "cited"), fold), meta)
    related = F.coalesce(T.related_case(F.col("year_a"), F.col("name_a"), F.col("year_b"), F.col("name_b")), F.lit(False))
    kept = cut(moved.where(~related).select("citing", "cited"))
    inside = giant(kept)
    graph = kept.join(inside.select(F.col("id").alias("citing")), "citing", "left_semi")
    return graph, fold


def merge_map(nodes: DataFrame) -> DataFrame:
    """(id, canonical) of greedily merged duplicate clusters.

    Within one cite, clusters go by degree (descending), then id; each unused one absorbs the later ones that fit
    *it* (same date or year, names overlapping by half).  This isn't transitive, so it runs group by group in
    pandas; a group is the clusters of one page of one reporter.
    """
    import pandas as pd

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["degree", "id"], ascending=[False, True])
        items = list(zip(rows.id, rows.date.fillna(""), rows.year.fillna(""), map(frozenset, rows.tokens), strict=True))
        taken, out = set(), []
        for i, (leader, date, year, words) in enumerate(items):
            if leader in taken:
                continue
            for other, date2, year2, words2 in items[i + 1 :]:
                near = date == date2 or (year and year == year2)
                shared = len(words & words2) / min(len(words), len(words2)) if words and words2 else 0.0
                if other not in taken and near and shared >= 0.5:
                    taken.add(other)
                    out.append((other, leader))
        return pd.DataFrame(out, columns=["id", "canonical"])

    active = nodes.where("cite <> '' and degree > 0").withColumn("tokens", T.merge_tokens(F.col("name")))
    several = active.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("cite"))).where("k > 1")
    return several.select("cite", "id", "degree", "date", "year", "tokens").groupBy("cite").applyInPandas(merge, "id long, canonical long")


def merge_edges(edges: DataFrame, fold: DataFrame) -> DataFrame:
    """Edges summed over canonical ends, self loops dropped."""
    a = fold.select(F.col("id").alias("citing"), F.col("canonical").alias("to_a"))
    b = fold.select(F.col("id").alias("cited"), F.col("canonical").alias("to_b"))
    moved = edges.join(a, "citing", "left").join(b, "cited", "left")
    moved = moved.select(F.coalesce("to_a", "citing").alias("citing"), F.coalesce("to_b", "cited").alias("cited"), "depth", "opinion_pairs")
    return moved.where("citing <> cited").groupBy("citing", "cited").agg(F.sum("depth").alias("depth"), F.sum("opinion_pairs").alias("opinion_pairs"))


def merge_nodes(nodes: DataFrame, fold: DataFrame, sums: list[str], lists: list[str]) -> DataFrame:
    """Canonical rows: ``sums`` added up and ``lists`` united (sorted) over the merged ones, other columns their own."""
    group = nodes.join(fold, "id", "left").select("*", F.coalesce("canonical", "id").alias("__to"))
    united = group.groupBy("__to").agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists],
        F.array_sort(F.collect_list(F.when(F.col("canonical").isNotNull(), F.col("id")))).alias("merged_ids"),
    )
    own = nodes.drop(*sums, *lists).join(fold, "id", "left_anti")
    return own.join(united, F.col("id") == F.col("__to")).drop("__to")
