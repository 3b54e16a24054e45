"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.session import Scratch, cut

# So many links at most are left for the driver, which saves the rounds over small tables.
MAX_LAST = 100_000


def union_find(links: list[tuple]) -> list[tuple]:
    """(node, name) of the nodes of ``links`` but for one of each component, which is the name."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in links:
        parent[find(x)] = find(y)
    return [(x, find(x)) for x in parent if find(x) != x]


def components(links: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(node, label): the smallest node that each linked node reaches; links are undirected.

    Each round every node takes the name of the first node next to it, or keeps its own if that comes first, and the
    links are renamed.  Nodes of one name belong to one component, so nothing is lost.  The first round takes the
    smallest node (stars around their smallest node are done at once), later ones order by a hash that is another one
    each round: whatever the shape (path, star, clique), a round then leaves about half of the nodes or fewer, so
    rounds grow with the logarithm of the size.  A link is held once, from its later end x to its earlier end y, so only
    an x gets another name.  Names are read backwards at the end, from the smallest table to the largest.  Null ends and
    self links are left out; repeated links count once; an empty table gives an empty one.  With a ``scratch`` the result
    is one of its tables, else a checkpoint.
    """

    def turned(links: DataFrame, turn: int) -> DataFrame:
        """Links from the end that comes later in the turn's order to the one that comes first."""
        h = lambda c: F.xxhash64(c, F.lit(turn)) if turn else F.lit(0)
        first = F.struct(h("x"), "x") < F.struct(h("y"), "y")
        return links.select(F.when(first, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(first, F.col("x")).otherwise(F.col("y")).alias("y"))

    with Scratch(links.sparkSession) as own:
        edges = own.keep(turned(links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y"), 0))
        names = []
        while n := edges.count():
            turn = len(names)
            if n <= MAX_LAST:
                of = edges.schema["x"].dataType.simpleString()
                names.append(own.keep(links.sparkSession.createDataFrame(union_find(edges.collect()), f"node {of}, name {of}")))
                break
            first = F.min_by("y", F.xxhash64("y", F.lit(turn))) if turn else F.min("y")
            names.append(named := own.keep(edges.groupBy(F.col("x").alias("node")).agg(first.alias("name"))))
            ends = edges.join(named.select(F.col("node").alias("x"), F.col("name").alias("p")), "x")
            ends = ends.join(named.select(F.col("node").alias("y"), F.col("name").alias("q")), "y", "left")
            ends = turned(ends.select(F.col("p").alias("x"), F.coalesce("q", "y").alias("y")).where("x <> y"), turn + 1)
            edges = own.keep(ends.distinct() if turn else ends)  # the first round makes few links alike
        if not names:
            return (scratch.keep if scratch else cut)(edges.select(F.col("x").alias("node"), F.col("y").alias("label")))
        last = names.pop()
        while names:
            named = names.pop()
            root = last.select(F.col("node").alias("name"), F.col("name").alias("root"))
            later = last.join(named, "node", "left_anti")
            last = own.keep(named.join(root, "name", "left").select("node", F.coalesce("root", "name").alias("name")).unionByName(later))
        alone = last.select("name").distinct().join(last.select(F.col("node").alias("name")), "name", "left_anti")
        last = last.unionByName(alone.select(F.col("name").alias("node"), "name"))  # those that kept their own name
        smallest = last.groupBy("name").agg(F.min("node").alias("label"))
        return (scratch.keep if scratch else cut)(last.join(smallest, "name").select("node", "label"))
