"""The questions of the game's service as functions over nodes and edges; answers are plain dicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions.markup import link_opinions
from casewright.operators import puzzles
from casewright.operators.paths import MODES, shortest_paths

DEPTH = 12


class ApiError(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


class Api:
    """nodes: id, name, cite, year, date, cited_all, cited_scotus, is_real (and text for races); edges: citing, cited.

    opinions: cap_id, node, html, cites_to; records: cap_id, node (what cap_ids mean).  Without them cases have no text.
    """

    FIELDS = ("id", "name", "cite", "year", "date", "cited_all", "cited_scotus", "is_real")

    def __init__(self, nodes: DataFrame, edges: DataFrame, starters: DataFrame | None = None, routes: DataFrame | None = None, opinions: DataFrame | None = None, records: DataFrame | None = None):
        self.nodes, self.edges, self.starters_table, self.routes = nodes, edges, starters, routes
        self.opinions, self.records = opinions, records

    def _mode(self, mode: str) -> str:
        if mode not in MODES:
            raise ApiError(400, f"mode must be one of {', '.join(MODES)}")
        return mode

    def _objects(self, ids: list[int]) -> list[dict]:
        rows = {r.id: r.asDict() for r in self.nodes.where(F.col("id").isin(ids)).select(*[c for c in self.FIELDS if c in self.nodes.columns]).collect()}
        missing = [i for i in ids if i not in rows]
        if missing:
            raise ApiError(404, f"no such case: {missing[0]}")
        return [rows[i] for i in ids]

    def path(self, a: int, b: int, mode: str = "any") -> dict:
        self._objects([a, b])
        pair = self.nodes.sparkSession.createDataFrame([(a, b)], "a long, b long")
        found = shortest_paths(self.edges, pair, DEPTH, self._mode(mode)).first()
        if found is None:
            return {"length": None, "mode": mode}
        return {"length": len(found.path) - 1, "mode": mode, "path": self._objects(list(found.path))}

    def pair_puzzle(self, pair: str, mode: str = "any") -> dict:
        try:
            a, b = (int(x) for x in pair.split("-"))
        except ValueError:
            raise ApiError(400, "pair must be <start>-<target>") from None
        found = self.path(a, b, mode)
        if found["length"] is None:
            raise ApiError(404, "no path between that pair in this mode")
        d = found["length"]
        return {"seed": 0, "mode": mode, "pair": pair, "start": found["path"][0], "target": found["path"][-1], "shortest": d, "par": 1 if d == 1 else d + 2}

    def puzzle(self, seed: int, mode: str = "any") -> dict:
        found = puzzles.draw_puzzle(self.edges, self.nodes, seed, self._mode(mode))
        if found is None:
            raise ApiError(500, "no puzzle found")
        start, target = self._objects([found["start"], found["target"]])
        return found | {"start": start, "target": target}

    def starters(self, mode: str = "any") -> list[dict]:
        rows = puzzles.oriented(self.starters_table, self._mode(mode)).collect() if self.starters_table is not None else []
        return [r.asDict(recursive=True) | {"mode": mode, "seed": 0} for r in rows]

    def opponent(self, seed: int, at: int, target: int, visited: list[int], mode: str = "any") -> dict:
        spark = self.nodes.sparkSession
        self._objects(list(dict.fromkeys([at, target, *visited])))
        if self.routes is not None and visited and visited[-1] == at:
            key = f"{self._mode(mode)}:{visited[0]}-{target}"
            trail = spark.createDataFrame([(key, visited)], "key string, visited array<long>")
            found = puzzles.replay(self.routes, trail).first()
            if found.note != "off route":
                return {"move": found.next, "note": found.note}
        move, how = puzzles.opponent_move(self.edges, self.nodes, seed, at, target, visited, self._mode(mode))
        return {"move": move, "note": f"stand-in ({how})"}

    def case(self, id: int, limit: int = 200) -> dict:
        node = self._objects([id])[0]
        n = self.nodes.select("id", "year", "date", "cited_all")
        cites = self.edges.where(F.col("citing") == id).select(F.col("cited").alias("id")).join(n, "id").orderBy(F.coalesce("year", F.lit(0)), "date", "id")
        by = self.edges.where(F.col("cited") == id).select(F.col("citing").alias("id")).join(n, "id")
        top = by.orderBy(F.desc("cited_all"), "id").limit(limit)
        lists = {"cites": [r.id for r in cites.collect()], "cited_by": [r.id for r in top.collect()], "cited_by_total": by.count()}
        return node | lists | self._text(id)

    def _text(self, id: int) -> dict:
        """The linked opinion of one node, its counts, and a note where there is none."""
        if self.opinions is not None and self.records is not None:
            own = self.opinions.where(F.col("node") == id).orderBy("cap_id").limit(1)
            row = link_opinions(own, self.records).first()
            if row is not None:
                return {"html": row.html, "text_stats": row.stats.asDict(), "note": None}
        return {"html": None, "text_stats": None, "note": "no text of this case"}

    def stats(self) -> dict:
        return self.nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if("is_real").alias("real")).first().asDict() | {"edges": self.edges.count()}
