"""Path puzzles: eligible targets, seeded draws, opponent candidates, greedy races, route replay, curated pairs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from casewright.functions import text as T
from casewright.functions.seeded import generator, pick
from casewright.operators.paths import REVERSE, distances, distances_to, hops
from casewright.session import cut


def targets_from(edges: DataFrame, nodes: DataFrame, start: DataFrame, mode: str = "any", low: int = 3, high: int = 5) -> DataFrame:
    """(source, id, shortest, par): real nodes ``low`` to ``high`` hops from each start."""
    near = distances(edges, start, high, mode).where(F.col("d").between(low, high))
    real = nodes.where("is_real").select("id")
    return near.join(real, "id", "left_semi").select("source", "id", F.col("d").alias("shortest"), T.par(F.col("d")).alias("par"))


def starts_for(edges: DataFrame, nodes: DataFrame, target: DataFrame, mode: str = "any", low: int = 2, high: int = 3) -> DataFrame:
    """(target, id, d): real nodes from which a target is ``low`` to ``high`` hops away, by a reverse search."""
    near = distances(edges, target, high, REVERSE[mode]).where(F.col("d").between(low, high))
    return near.join(nodes.where("is_real").select("id"), "id", "left_semi").select(F.col("source").alias("target"), "id", "d")


def nth(rows: DataFrame, at: int) -> Row:
    """The row at a place in the order of ids: one row reaches the driver."""
    return rows.orderBy("id").offset(at).limit(1).first()


def drawn(rng, rows: DataFrame) -> Row | None:
    """A seeded row of an id table; only its count and that row reach the driver."""
    n = rows.count()
    return nth(rows, int(rng() * n)) if n else None


def draw_puzzle(edges: DataFrame, nodes: DataFrame, seed: object, mode: str = "any", tries: int = 500, pool: DataFrame | None = None) -> dict | None:
    """A seeded puzzle (start, target, shortest, par), or None.

    With a ``pool`` (start, target) of the mode the draw is one of its pairs; else a real start, then a real target
    three to five hops away, again if there is none.  Candidates stay distributed: counts and single rows are drawn.
    """
    rng = generator(seed if mode == "any" else f"{seed}:{mode}")
    if pool is not None and not pool.isEmpty():
        pair = drawn(rng, pool.withColumn("id", F.struct("start", "target")))
        found = distances(edges, edges.sparkSession.createDataFrame([(pair.start,)], "id long"), 9, mode).where(F.col("id") == pair.target).first()
        d = found.d if found else None
        return {"seed": seed, "mode": mode, "start": pair.start, "target": pair.target, "shortest": d, "par": None if d is None else 1 if d == 1 else d + 2}
    real = nodes.where("is_real").select("id")
    n = real.count()
    for _ in range(tries if n else 0):
        start = edges.sparkSession.createDataFrame([(nth(real, int(rng() * n)).id,)], "id long")
        chosen = drawn(rng, cut(targets_from(edges, nodes, start, mode)))
        if chosen:
            return {"seed": seed, "mode": mode, "start": chosen.source, "target": chosen.id, "shortest": chosen.shortest, "par": chosen.par}
    return None


def draw_pool(edges: DataFrame, nodes: DataFrame, mode: str, size: int, seed: object, targets: DataFrame | None = None, low: int = 2, high: int = 3) -> list[tuple[int, int]]:
    """Up to ``size`` distinct seeded pairs (start, target): a target among ``targets`` (or the real nodes) and a real
    start ``low`` to ``high`` hops before it; ``size * 50`` tries at most."""
    rng = generator(f"pool:{seed}:{mode}")
    ends = cut((targets if targets is not None else nodes.where("is_real")).select("id"))
    n, out = ends.count(), []
    for _ in range(size * 50 if n else 0):
        if len(out) >= size:
            break
        target = edges.sparkSession.createDataFrame([(nth(ends, int(rng() * n)).id,)], "id long")
        start = drawn(rng, cut(starts_for(edges, nodes, target, mode, low, high)))
        if start and (start.id, start.target) not in out:
            out.append((start.id, start.target))
    return out


class DistanceCache:
    """Distances to targets by (target, mode), each searched once and kept as Parquet under ``path``."""

    def __init__(self, edges: DataFrame, path: str, depth: int = 9):
        self.edges, self.path, self.depth, self.spark = edges, path, depth, edges.sparkSession

    def to(self, target: int, mode: str = "any") -> DataFrame:
        """(target, id, d) of all nodes that reach the target within the depth."""
        place = f"{self.path}/mode={mode}/target={int(target)}"
        try:
            return self.spark.read.parquet(place).select(F.lit(int(target)).cast("long").alias("target"), "id", "d")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        goal = self.spark.createDataFrame([(target,)], "id long")
        distances_to(self.edges, goal, self.depth, mode).select("id", "d").write.mode("overwrite").parquet(place)
        return self.to(target, mode)


def curated_shortest(edges: DataFrame, pairs: DataFrame, cap: int = 8) -> DataFrame:
    """Curated pairs (older, newer, year_older, year_newer) with shortest.any, .back and .forward (null beyond ``cap``).

    The two change places if their years are the wrong way round; back runs from the newer, forward from the older.
    """
    wrong = F.col("year_older") > F.col("year_newer")
    older, newer = F.when(wrong, F.col("newer")).otherwise(F.col("older")), F.when(wrong, F.col("older")).otherwise(F.col("newer"))
    rows = cut(pairs.select(*[c for c in pairs.columns if c not in ("older", "newer", "year_older", "year_newer")], older.alias("older"), newer.alias("newer")))
    for mode, a, b in (("any", "older", "newer"), ("back", "newer", "older"), ("forward", "older", "newer")):
        found = distances(edges, rows.select(F.col(a).alias("id")).distinct(), cap, mode).select(F.col("source").alias(a), F.col("id").alias(b), F.col("d").alias(f"d_{mode}"))
        rows = rows.join(found, [a, b], "left")
    return rows.withColumn("shortest", F.struct(*[F.col(f"d_{m}").alias(m) for m in ("any", "back", "forward")])).drop("d_any", "d_back", "d_forward")


def opponent_candidates(edges: DataFrame, nodes: DataFrame, at: int, target: int, visited: list[int], mode: str = "any", depth: int = 9) -> DataFrame:
    """(id, is_target, closer, top10): what an opponent at ``at`` may choose from."""
    spark = edges.sparkSession
    gone = [*visited, at]
    cands = hops(edges, mode).where(F.col("src") == at).select(F.col("dst").alias("id")).where(~F.col("id").isin(gone)).distinct()
    goal = spark.createDataFrame([(target,)], "id long")
    left = distances(edges, goal, depth, REVERSE[mode]).select("id", "d")
    here = left.where(F.col("id") == at).select(F.col("d").alias("here"))
    rows = cands.join(left, "id", "left").join(nodes.select("id", "cited_all"), "id").crossJoin(F.broadcast(here.agg(F.first("here").alias("here"))))
    rank = F.row_number().over(Window.orderBy(F.desc("cited_all"), "id"))  # over one node's neighbours
    closer = F.coalesce(F.col("d") == F.col("here") - 1, F.lit(False))
    return rows.select("id", (F.col("id") == target).alias("is_target"), closer.alias("closer"), (rank <= 10).alias("top10"))


def opponent_move(edges: DataFrame, nodes: DataFrame, seed: object, at: int, target: int, visited: list[int], mode: str = "any") -> tuple[int | None, str]:
    """The stand-in opponent's seeded move and how it was chosen."""
    rows = opponent_candidates(edges, nodes, at, target, visited, mode).orderBy("id").collect()
    if not rows:
        return None, "no unvisited neighbour"
    if any(r.is_target for r in rows):
        return target, "target in reach"
    rng = generator(f"{seed}:{at}:{mode}")
    closer = [r.id for r in rows if r.closer]
    if rng() < 0.6 and closer:
        return pick(rng, closer), "closer"
    best = {r.id: r.top10 for r in rows}
    order = [r.id for r in nodes.where(F.col("id").isin([k for k, v in best.items() if v])).orderBy(F.desc("cited_all"), "id").select("id").collect()]
    return pick(rng, order), "random-top10"


def best_steps(candidates: DataFrame) -> DataFrame:
    """(race, id, score): each race's next move: highest score, then most cited, then lowest id."""
    order = F.struct("score", "cited_all", -F.col("id"))
    return candidates.groupBy("race").agg(F.max_by(F.struct("id", "score"), order).alias("m")).select("race", "m.id", "m.score")


def most_cited(candidates: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` candidates of each race, the most cited first (ties: lowest id)."""
    rank = F.row_number().over(Window.partitionBy("race").orderBy(F.desc("cited_all"), "id"))
    return candidates.withColumn("rank", rank).where(F.col("rank") <= cap).drop("rank")


def run_race(edges: DataFrame, nodes: DataFrame, start: int, target: int, mode: str = "any", max_hops: int = 12, cap: int = 60) -> dict:
    """A greedy best-first route with backtracking, scored by word overlap of the nodes' texts (column text).

    Each move is one small query over the current node's neighbours.
    """
    step = hops(edges, mode).persist()
    goal = nodes.where(F.col("id") == target).select(F.col("text").alias("goal"))
    path, scores, visited = [start], [], {start}
    for _ in range(3 * max_hops):
        if path[-1] == target or len(path) > max_hops:
            break
        near = step.where(F.col("src") == path[-1]).select(F.col("dst").alias("id")).where(~F.col("id").isin(list(visited)))
        rows = near.join(nodes, "id").crossJoin(F.broadcast(goal)).select(F.lit(0).alias("race"), "id", "cited_all", T.relatedness(F.col("text"), F.col("goal")).alias("score"))
        kept = most_cited(rows, cap)
        hit = kept.where(F.col("id") == target).count()
        found = best_steps(kept).first()
        if hit:
            move, score = target, None
        elif found is None:
            if len(path) == 1:
                break
            path.pop()
            scores.pop()
            continue
        else:
            move, score = found.id, found.score
        path.append(move)
        scores.append(score)
        visited.add(move)
    step.unpersist()
    return {"path": path, "score": scores, "reached": path[-1] == target}


def replay(routes: DataFrame, trails: DataFrame) -> DataFrame:
    """(key, next, note): the next node of each trail's stored route while the trail is its opening.

    routes: key, path; trails: key, visited (array, in order).
    """
    k = F.size("visited")
    rows = trails.join(routes, "key", "left")
    follows = F.coalesce(F.slice("path", F.lit(1), F.greatest(k, F.lit(1))) == F.col("visited"), F.lit(False))
    nxt = F.try_element_at("path", k + 1)
    note = F.when(~follows, "off route").when(nxt.isNull(), "gave up").otherwise("on route")
    return rows.select("key", F.when(follows, nxt).alias("next"), note.alias("note"))


def oriented(pairs: DataFrame, mode: str) -> DataFrame:
    """Curated pairs with a path in the mode: back runs from newer to older, else from older to newer."""
    a, b = ("newer", "older") if mode == "back" else ("older", "newer")
    d = F.col(f"shortest.{mode}")
    return pairs.where(d.isNotNull()).select("group", F.col(a).alias("start"), F.col(b).alias("target"), d.alias("shortest"), T.par(d).alias("par"))


def usable_pairs(found: DataFrame, canon: DataFrame, longest: int = 3, directed: bool = False) -> DataFrame:
    """Pairs of canon ids 2 to ``longest`` hops apart, both with text and real; found: source, id, d."""
    good = canon.where("has_text and is_real").select("id")
    rows = found.where(F.col("d").between(2, longest)).join(good, "id", "left_semi")
    rows = rows.join(good.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("source").alias("a"), F.col("id").alias("b"), "d")
    return rows if directed else rows.where("a < b")
