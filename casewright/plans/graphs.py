"""Registered queries over the graph: components, folding, bounded and shortest paths, puzzles."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import text as T
from casewright.operators import edges as E
from casewright.operators import paths as P
from casewright.operators import puzzles as Z
from casewright.operators import stats as S
from casewright.operators.components import components
from casewright.plans.registry import Registry
from casewright.plans.relational import _jaccard, _NAME, _overlap, _PLAIN
from casewright.plans.standins import G_EDGES, G_META, G_NODES, graph_edges, graph_links, graph_meta, graph_nodes
from casewright.session import cut, table

R = Registry()
query = R.query

_COMPONENTS = """sub AS MATERIALIZED (SELECT citing, cited FROM g_edges WHERE {0}), u AS MATERIALIZED (SELECT citing AS a, cited AS b FROM sub UNION SELECT cited, citing FROM sub),
reach(id, label) USING KEY (id) AS (SELECT DISTINCT a, a FROM u UNION
  SELECT u.b, min(reach.label) FROM reach JOIN u ON u.a = reach.id LEFT JOIN recurring.reach k ON k.id = u.b GROUP BY u.b, k.label HAVING min(reach.label) < k.label)"""


@query(f"WITH RECURSIVE {G_EDGES}, {_COMPONENTS.format('true')} SELECT size, count(*) AS n FROM (SELECT label, count(*) AS size FROM reach GROUP BY label) GROUP BY size")
def component_sizes(spark, d):
    return S.component_sizes(graph_edges(spark, d))


_REAL = "citing IN (SELECT id FROM g_nodes WHERE is_real) AND cited IN (SELECT id FROM g_nodes WHERE is_real)"


@query(f"""WITH RECURSIVE {G_EDGES}, {G_NODES}, {_COMPONENTS.format(_REAL)}, c AS (SELECT label, count(*) AS size FROM reach GROUP BY label
  UNION ALL SELECT id, 1 FROM g_nodes WHERE is_real AND id NOT IN (SELECT id FROM reach)) SELECT size, count(*) AS n FROM c GROUP BY size""")
def component_sizes_h(spark, d):
    """The other report's domain: kept nodes only, isolated ones counted."""
    e = graph_edges(spark, d).persist()
    real = graph_nodes(spark, d, e).where("is_real").select("id")
    found = S.component_sizes(cut(S.within(e, real)), real)
    e.unpersist()
    return found


@query(f"WITH RECURSIVE {G_EDGES}, {_COMPONENTS.format('true')} SELECT id FROM reach WHERE label = (SELECT label FROM reach GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)")
def giant_component(spark, d):
    return E.giant(graph_edges(spark, d))


_FOLD = f"""{G_EDGES}, {G_META}, m AS MATERIALIZED (SELECT id, year, cite, {_NAME("name")} AS t, {_PLAIN("name")} AS p FROM g_meta),
ok AS MATERIALIZED (SELECT citing, cited, a.year = b.year AND (a.cite = b.cite OR {_jaccard("a.t", "b.t")} >= 0.6) AS same FROM g_edges JOIN m a ON a.id = citing JOIN m b ON b.id = cited WHERE NOT b.year > a.year),
deg AS MATERIALIZED (SELECT id, count(*) AS n FROM (SELECT citing AS id FROM ok UNION ALL SELECT cited FROM ok) GROUP BY id),
u AS MATERIALIZED (SELECT citing AS a, cited AS b FROM ok WHERE same UNION SELECT cited, citing FROM ok WHERE same),
reach(id, label) USING KEY (id) AS (SELECT DISTINCT a, a FROM u UNION
  SELECT u.b, min(reach.label) FROM reach JOIN u ON u.a = reach.id LEFT JOIN recurring.reach k ON k.id = u.b GROUP BY u.b, k.label HAVING min(reach.label) < k.label),
fold AS MATERIALIZED (SELECT id, first_value(id) OVER (PARTITION BY label ORDER BY n DESC, id) AS canonical FROM reach JOIN deg USING (id))"""


@query(f"WITH RECURSIVE {_FOLD} SELECT id, label FROM reach")
def many_components(spark, d):
    """The groups of one and the same case: thousands of small components."""
    marked = E.with_meta(graph_edges(spark, d).select("citing", "cited"), graph_meta(spark, d)).where(E.respects_time() & E.is_same_case())
    return components(marked, "citing", "cited").select(F.col("node").alias("id"), "label")


@query(f"WITH RECURSIVE {_FOLD} SELECT id, canonical FROM fold WHERE id <> canonical")
def fold_same_case(spark, d):
    marked = E.with_meta(graph_edges(spark, d).select("citing", "cited"), graph_meta(spark, d)).where(E.respects_time())
    return E.fold_map(cut(marked))


@query(f"""WITH RECURSIVE {_FOLD}, moved AS (SELECT DISTINCT coalesce(x.canonical, citing) AS citing, coalesce(y.canonical, cited) AS cited FROM ok
  LEFT JOIN fold x ON x.id = citing LEFT JOIN fold y ON y.id = cited WHERE coalesce(x.canonical, citing) <> coalesce(y.canonical, cited))
SELECT citing, cited FROM moved JOIN m a ON a.id = citing JOIN m b ON b.id = cited WHERE NOT (a.year = b.year AND {_overlap("a.p", "b.p")} >= 0.5)""")
def cleaned_edges(spark, d):
    """Time filter, fold and related-name filter, in this order (before the largest component is taken)."""
    meta = graph_meta(spark, d)
    marked = cut(E.with_meta(graph_edges(spark, d).select("citing", "cited"), meta).where(E.respects_time()))
    moved = E.with_meta(E.remap(marked.select("citing", "cited"), cut(E.fold_map(marked))), meta)
    related = F.coalesce(T.related_case(F.col("year_a"), F.col("name_a"), F.col("year_b"), F.col("name_b")), F.lit(False))
    return moved.where(~related).select("citing", "cited")


def _hops(mode: str) -> str:
    return {
        "back": "h AS MATERIALIZED (SELECT citing AS src, cited AS dst FROM g_edges)",
        "forward": "h AS MATERIALIZED (SELECT cited AS src, citing AS dst FROM g_edges)",
        "any": "h AS MATERIALIZED (SELECT citing AS src, cited AS dst FROM g_edges UNION SELECT cited, citing FROM g_edges)",
    }[mode]


def _bfs(mode: str, depth: int, sources: str) -> str:
    return f"""{_hops(mode)}, walk(source, id, d) AS (SELECT id, id, 0 FROM ({sources}) UNION SELECT source, dst, d + 1 FROM walk JOIN h ON src = walk.id WHERE d < {depth}),
dist AS MATERIALIZED (SELECT source, id, CAST(min(d) AS INTEGER) AS d FROM walk GROUP BY source, id)"""


def _bfs_query(name: str, mode: str, depth: int, ids: list[int], reverse: bool = False):
    values = ", ".join(f"({i})" for i in ids)
    used = P.REVERSE[mode] if reverse else mode
    who = "target" if reverse else "source"
    sql = f"WITH RECURSIVE {G_EDGES}, {_bfs(used, depth, f'SELECT * FROM (VALUES {values}) v(id)')} SELECT source AS {who}, id, d FROM dist"

    def run(spark, d):
        sources = spark.createDataFrame([(i,) for i in ids], "id long")
        e = graph_edges(spark, d)
        return P.distances_to(e, sources, depth, mode) if reverse else P.distances(e, sources, depth, mode)

    run.__name__ = name
    query(sql)(run)


_bfs_query("bfs_any", "any", 4, [0])
_bfs_query("bfs_back", "back", 6, [100])
_bfs_query("bfs_forward", "forward", 6, [100])
_bfs_query("reverse_dist", "back", 5, [40], True)
_bfs_query("multi_source_dist", "any", 2, [0, 10, 20, 30, 50, 77])

_PAIRS = [(0, 100), (10, 200), (5, 5), (30, 40), (77, 1200), (64, 900)]


@query(f"""WITH RECURSIVE {G_EDGES}, {_hops("any")}, w(a, b) AS (VALUES {", ".join(map(str, _PAIRS))}),
walk(a, id, d) AS (SELECT DISTINCT a, CAST(a AS BIGINT), 0 FROM w UNION SELECT a, dst, d + 1 FROM walk JOIN h ON src = walk.id WHERE d < 6),
dist AS MATERIALIZED (SELECT a, id, min(d) AS d FROM walk GROUP BY a, id),
p(a, id, d, path) AS (SELECT a, id, d, [id] FROM dist WHERE d = 0 UNION ALL
  SELECT a, dst, d, min(path) FROM (SELECT p.a, h.dst, t.d, list_append(p.path, h.dst) AS path FROM p JOIN h ON h.src = p.id JOIN dist t ON t.a = p.a AND t.id = h.dst AND t.d = p.d + 1) GROUP BY a, dst, d)
SELECT CAST(w.a AS BIGINT) AS a, CAST(w.b AS BIGINT) AS b, path FROM w JOIN p ON p.a = w.a AND p.id = w.b""")
def shortest_path_lex(spark, d):
    pairs = spark.createDataFrame(_PAIRS, "a long, b long")
    return P.shortest_paths(graph_edges(spark, d), pairs, 6)


@query(f"""WITH RECURSIVE {G_EDGES}, {_hops("any")}, prs AS MATERIALIZED (SELECT DISTINCT o_orderkey AS a, (o_orderkey * 7 + 13) % (SELECT count(*) FROM orders) AS b FROM orders WHERE o_orderkey % 1000 = 0),
dist(source, id, d) USING KEY (source, id) AS (SELECT DISTINCT a, a, 0 FROM prs UNION
  SELECT w.source, h.dst, min(w.d) + 1 FROM dist w JOIN h ON h.src = w.id LEFT JOIN recurring.dist k ON k.source = w.source AND k.id = h.dst GROUP BY w.source, h.dst, k.d HAVING k.d IS NULL OR min(w.d) + 1 < k.d),
c AS (SELECT CAST(d AS INTEGER) AS length, count(*) AS n FROM prs LEFT JOIN dist ON source = a AND id = b WHERE a <> b GROUP BY d)
SELECT length, n, round(n / sum(n) OVER (), 6) AS share, round(sum(n) OVER (ORDER BY length NULLS LAST) / sum(n) OVER (), 6) AS running FROM c""")
def path_length_hist(spark, d):
    """Sampled pairs (one source in a thousand), paths of any length."""
    return _path_lengths(spark, d, None)


def _path_lengths(spark, d, depth):
    orders = table(spark, d, "orders")
    n = orders.agg(F.count(F.lit(1)).alias("n"))
    pairs = orders.where("o_orderkey % 1000 = 0").join(F.broadcast(n)).select(F.col("o_orderkey").alias("a"), ((F.col("o_orderkey") * 7 + 13) % F.col("n")).alias("b")).where("a <> b").distinct()
    return S.path_lengths(graph_links(spark, d), pairs, depth)


@query(f"""WITH RECURSIVE {G_EDGES}, {G_NODES}, {_bfs("any", 5, "SELECT 10 AS id")}
SELECT CAST(source AS BIGINT) AS source, id, d AS shortest, CASE WHEN d = 1 THEN 1 ELSE d + 2 END AS par FROM dist WHERE d BETWEEN 3 AND 5 AND id IN (SELECT id FROM g_nodes WHERE is_real)""")
def puzzle_candidates(spark, d):
    e = graph_edges(spark, d).persist()
    return Z.targets_from(e, graph_nodes(spark, d, e), spark.createDataFrame([(10,)], "id long"))


@query(f"""WITH RECURSIVE {G_EDGES}, {G_NODES}, {_bfs("forward", 3, "SELECT 40 AS id")}
SELECT CAST(source AS BIGINT) AS target, id, d FROM dist WHERE d BETWEEN 2 AND 3 AND id IN (SELECT id FROM g_nodes WHERE is_real)""")
def pool_candidates(spark, d):
    e = graph_edges(spark, d).persist()
    return Z.starts_for(e, graph_nodes(spark, d, e), spark.createDataFrame([(40,)], "id long"), "back")


@query(f"""WITH RECURSIVE {G_EDGES}, {G_NODES}, {_bfs("any", 9, "SELECT 200 AS id")}, c AS (SELECT DISTINCT dst AS id FROM h WHERE src = 10 AND dst NOT IN (10, 3))
SELECT c.id, c.id = 200 AS is_target, coalesce(dist.d = (SELECT d FROM dist WHERE id = 10) - 1, false) AS closer,
  row_number() OVER (ORDER BY cited_all DESC, c.id) <= 10 AS top10 FROM c JOIN g_nodes n ON n.id = c.id LEFT JOIN dist ON dist.id = c.id""")
def opponent_candidates(spark, d):
    e = graph_edges(spark, d).persist()
    return Z.opponent_candidates(e, graph_nodes(spark, d, e), 10, 200, [3])


@query(f"""WITH {G_EDGES}, {G_NODES}, c AS (SELECT citing AS race, cited AS id, weight + cited % 5 AS score, cited_all FROM g_edges JOIN g_nodes ON id = cited),
k AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY cited_all DESC, id) AS r FROM c)
SELECT race, id, score FROM (SELECT *, row_number() OVER (PARTITION BY race ORDER BY score DESC, cited_all DESC, id) AS w FROM k WHERE r <= 60) WHERE w = 1""")
def race_step_argmax(spark, d):
    return _race_steps(spark, d, 60)


def _race_steps(spark, d, cap):
    e = graph_edges(spark, d).persist()
    n = graph_nodes(spark, d, e)
    rows = e.join(n, F.col("cited") == n.id).select(F.col("citing").alias("race"), "id", (F.col("weight") + F.col("cited") % 5).alias("score"), "cited_all")
    return Z.best_steps(Z.most_cited(rows, cap))


@query("""WITH r AS (SELECT conv_id AS key, list(length(text) ORDER BY turn) AS path FROM conversations GROUP BY 1),
t AS (SELECT key, CASE WHEN key % 4 = 0 THEN [-1] ELSE path[1 : 1 + key % 3] END AS visited FROM r)
SELECT r.key, CASE WHEN path[1 : len(visited)] = visited THEN path[len(visited) + 1] END AS next,
  CASE WHEN path[1 : len(visited)] <> visited THEN 'off route' WHEN path[len(visited) + 1] IS NULL THEN 'gave up' ELSE 'on route' END AS note FROM r JOIN t USING (key)""")
def route_prefix_match(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("key"), "turn", F.length("text").cast("long").alias("n"))
    routes = c.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "n"))), lambda x: x.n).alias("path"))
    first = F.slice("path", F.lit(1), (F.col("key") % 3 + 1).cast("int"))
    trails = routes.select("key", F.when(F.col("key") % 4 == 0, F.array(F.lit(-1).cast("long"))).otherwise(first).alias("visited"))
    return Z.replay(routes, trails)


@query("""SELECT n_regionkey AS "group", n_nationkey + 100 AS start, n_nationkey AS target, n_nationkey % 4 + 1 AS shortest, CASE WHEN n_nationkey % 4 = 0 THEN 1 ELSE n_nationkey % 4 + 3 END AS par FROM nation WHERE n_nationkey % 5 <> 0""")
def starters_oriented(spark, d):
    n = table(spark, d, "nation")
    back = F.when(F.col("n_nationkey") % 5 != 0, F.col("n_nationkey") % 4 + 1)
    pairs = n.select(F.col("n_regionkey").alias("group"), F.col("n_nationkey").alias("older"), (F.col("n_nationkey") + 100).alias("newer"), F.struct(back.alias("any"), back.alias("back"), F.lit(None).cast("int").alias("forward")).alias("shortest"))
    return Z.oriented(pairs, "back")


#: Stand-in for the curated cases: one of each nation.
_CANON = "canon AS MATERIALIZED (SELECT n_nationkey * 40 AS id FROM nation SEMI JOIN g_nodes ON g_nodes.id = n_nationkey * 40 AND is_real)"


def _canon(spark, d, nodes):
    ids = table(spark, d, "nation").select((F.col("n_nationkey") * 40).cast("long").alias("id"))
    return nodes.where("is_real").join(F.broadcast(ids), "id", "left_semi").withColumn("has_text", F.lit(True))


@query(f"""WITH RECURSIVE {G_EDGES}, {G_NODES}, {_CANON}, {_bfs("any", 3, "SELECT id FROM canon")}
SELECT CAST(source AS BIGINT) AS a, dist.id AS b, d FROM dist JOIN canon ON canon.id = dist.id WHERE d BETWEEN 2 AND 3 AND source < dist.id""")
def canon_pairs(spark, d):
    e = graph_edges(spark, d).persist()
    canon = cut(_canon(spark, d, graph_nodes(spark, d, e)))
    return Z.usable_pairs(P.distances(e, canon, 3), canon)


@query(f"""WITH RECURSIVE {G_EDGES}, {G_NODES}, {_CANON}, {_bfs("back", 5, "SELECT id FROM canon")}
SELECT CAST(source AS BIGINT) AS a, dist.id AS b, d FROM dist JOIN canon ON canon.id = dist.id WHERE d BETWEEN 2 AND 5""")
def canon_pairs_directed(spark, d):
    e = graph_edges(spark, d).persist()
    canon = cut(_canon(spark, d, graph_nodes(spark, d, e)))
    return Z.usable_pairs(P.distances(e, canon, 5, "back"), canon, 5, directed=True)
