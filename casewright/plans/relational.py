"""Registered queries of the relational core: lookups, rollups, degrees, rankings, clean-up (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import text as T
from casewright.operators import edges as E
from casewright.operators import stats as S
from casewright.plans.registry import Registry
from casewright.plans.standins import G_EDGES, G_META, G_NODES, graph_edges, graph_meta, graph_nodes
from casewright.session import table

R = Registry()
query = R.query

#: Stand-in exclusions: the busiest orders by key.
EXCLUDED = [0, 7, 42, 99]


def _opinions(spark: SparkSession, d: str) -> DataFrame:
    """Opinions (one for each distinct supplier of an order) and their order as cluster."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    return li.select((F.col("l_orderkey") * 100000 + F.col("l_suppkey")).alias("opinion"), F.col("l_orderkey").alias("cluster"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Opinion-level cites with the clusters of both ends; every seventh order is outside."""
    e = graph_edges(spark, d)
    owner = _opinions(spark, d).where("cluster % 7 <> 3")
    first = _opinions(spark, d).groupBy("cluster").agg(F.min("opinion").alias("o"))
    a = first.select(F.col("cluster").alias("citing"), F.col("o").alias("citing_opinion"))
    b = _opinions(spark, d).select(F.col("cluster").alias("cited"), F.col("opinion").alias("cited_opinion"))
    raw = e.join(a, "citing").join(b, "cited").select("citing_opinion", "cited_opinion", F.col("weight").alias("depth"))
    return E.double_lookup(raw, owner)


OPINIONS = """ops AS MATERIALIZED (SELECT DISTINCT l_orderkey * 100000 + l_suppkey AS opinion, l_orderkey AS cluster FROM lineitem)"""
PAIRS = f"""{G_EDGES}, {OPINIONS}, own AS (SELECT * FROM ops WHERE cluster % 7 <> 3),
raw AS (SELECT a.o AS citing_opinion, b.opinion AS cited_opinion, weight AS depth FROM g_edges
  JOIN (SELECT cluster, min(opinion) AS o FROM ops GROUP BY 1) a ON a.cluster = citing JOIN ops b ON b.cluster = cited),
pairs AS MATERIALIZED (SELECT citing_opinion, cited_opinion, depth, x.cluster AS citing, y.cluster AS cited FROM raw
  LEFT JOIN own x ON x.opinion = citing_opinion LEFT JOIN own y ON y.opinion = cited_opinion)"""


@query("SELECT o_orderkey AS id, o_custkey AS docket_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def docket_semi_join(spark, d):
    court = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = table(spark, d, "orders")
    return orders.join(court, orders.o_custkey == court.c_custkey, "left_semi").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("docket_id"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unmapped_anti_join(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey")
    orders = table(spark, d, "orders")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left_anti").select(F.col("o_orderkey").alias("id"))


@query(f"WITH {PAIRS} SELECT citing, cited, count(*) AS n, CAST(sum(depth) AS BIGINT) AS depth FROM pairs GROUP BY ALL")
def double_lookup_map(spark, d):
    return _pairs(spark, d).groupBy("citing", "cited").agg(F.count(F.lit(1)).alias("n"), F.sum("depth").alias("depth"))


@query(f"""WITH {PAIRS} SELECT citing, cited, CAST(sum(depth) AS BIGINT) AS depth, count(*) AS opinion_pairs FROM pairs
WHERE citing IS NOT NULL AND cited IS NOT NULL AND citing <> cited GROUP BY ALL""")
def edge_rollup(spark, d):
    return E.rollup(_pairs(spark, d))


@query(f"WITH {PAIRS} SELECT cited, count(*) AS all_courts, count(citing) AS known_courts FROM pairs WHERE cited IS NOT NULL GROUP BY ALL")
def indegree_counts(spark, d):
    return E.citing_counts(_pairs(spark, d))


@query("""SELECT o_orderkey AS id, coalesce(ops, '') AS opinion_ids, coalesce(first_return, '') AS us_cite, coalesce(n, 0) AS n_cites,
  substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS year FROM orders LEFT JOIN (
  SELECT l_orderkey, string_agg(CAST(s AS VARCHAR), ';' ORDER BY s) AS ops FROM (SELECT DISTINCT l_orderkey, l_suppkey AS s FROM lineitem) GROUP BY 1) a ON a.l_orderkey = o_orderkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n, min_by(l_suppkey || ' U.S. ' || l_partkey, l_linenumber * 1000000 + l_partkey) FILTER (l_returnflag = 'R') AS first_return FROM lineitem GROUP BY 1) b
  ON b.l_orderkey = o_orderkey""")
def node_enrichment(spark, d):
    li = table(spark, d, "lineitem")
    ops = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("l_suppkey")), lambda s: s.cast("string")), ";").alias("ops"))
    cite = F.when(F.col("l_returnflag") == "R", F.concat(F.col("l_suppkey"), F.lit(" U.S. "), F.col("l_partkey")))
    order = F.when(F.col("l_returnflag") == "R", F.col("l_linenumber") * 1000000 + F.col("l_partkey"))
    cites = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.min_by(cite, order).alias("first"))
    rows = table(spark, d, "orders").join(ops, "o_orderkey", "left").join(cites, "o_orderkey", "left")
    return rows.select(
        F.col("o_orderkey").alias("id"), F.coalesce("ops", F.lit("")).alias("opinion_ids"), F.coalesce("first", F.lit("")).alias("us_cite"),
        F.coalesce("n", F.lit(0)).alias("n_cites"), F.substring(F.col("o_orderdate").cast("string"), 1, 4).alias("year"),
    )


_TIME = "NOT coalesce(coalesce(a.year, 0) <> 0 AND coalesce(b.year, 0) <> 0 AND b.year > a.year, false)"


@query(f"""WITH {G_EDGES}, {G_META}, f AS (SELECT cited AS citing, citing AS cited FROM g_edges WHERE citing % 5 = 0 UNION ALL SELECT citing, cited FROM g_edges WHERE citing % 5 <> 0)
SELECT f.citing, f.cited FROM f LEFT JOIN g_meta a ON a.id = f.citing LEFT JOIN g_meta b ON b.id = f.cited
WHERE {_TIME} AND f.citing NOT IN (0, 7, 42, 99) AND f.cited NOT IN (0, 7, 42, 99)""")
def time_respecting_edges(spark, d):
    e = graph_edges(spark, d)
    turned = e.where("citing % 5 = 0").select(F.col("cited").alias("citing"), F.col("citing").alias("cited"))
    e = turned.unionByName(e.where("citing % 5 <> 0").select("citing", "cited"))
    excluded = spark.createDataFrame([(x,) for x in EXCLUDED], "id long")
    return E.with_meta(E.without(e, excluded), graph_meta(spark, d)).where(E.respects_time()).select("citing", "cited")


_TOK = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda x: x NOT IN ({1})))"
_NAME = lambda c: _TOK.format(c, ", ".join(f"'{w}'" for w in T.NAME_STOP))
_PLAIN = lambda c: _TOK.format(c, ", ".join(f"'{w}'" for w in T.NAME_STOP + T.GENERIC))


def _overlap(a: str, b: str) -> str:
    return f"CASE WHEN least(len({a}), len({b})) > 0 THEN len(list_intersect({a}, {b})) / least(len({a}), len({b})) ELSE 0.0 END"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END"


@query(f"""WITH {G_EDGES}, {G_META}, m AS (SELECT id, year, {_PLAIN("name")} AS t FROM g_meta)
SELECT citing, cited FROM g_edges JOIN m a ON a.id = citing JOIN m b ON b.id = cited WHERE a.year = b.year AND {_overlap("a.t", "b.t")} >= 0.5""")
def related_edges_dropped(spark, d):
    rows = E.with_meta(graph_edges(spark, d).select("citing", "cited"), graph_meta(spark, d))
    return rows.where(T.related_case(F.col("year_a"), F.col("name_a"), F.col("year_b"), F.col("name_b"))).select("citing", "cited")


@query(f"""WITH {G_EDGES}, m AS (SELECT citing - citing % 4 AS a, cited - cited % 4 AS b, weight FROM g_edges)
SELECT a AS citing, b AS cited, CAST(sum(weight) AS BIGINT) AS depth, count(*) AS opinion_pairs FROM m WHERE a <> b GROUP BY ALL""")
def canonical_remap(spark, d):
    e = graph_edges(spark, d).select("citing", "cited", F.col("weight").alias("depth"), F.lit(1).cast("long").alias("opinion_pairs"))
    fold = table(spark, d, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") - F.col("o_orderkey") % 4).alias("canonical"))
    return E.merge_edges(e, fold)


@query(f"""WITH {G_EDGES}, x AS (SELECT citing AS id, 0 AS i, 1 AS o FROM g_edges UNION ALL SELECT cited, 1, 0 FROM g_edges)
SELECT id, CAST(sum(i) AS BIGINT) AS indeg, CAST(sum(o) AS BIGINT) AS outdeg, count(*) AS degree FROM x GROUP BY id""")
def degree_table(spark, d):
    return E.degrees(graph_edges(spark, d))


def _bins(bins: list[int], column: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} >= {b} THEN {b}" for b in reversed(bins)) + f" ELSE {bins[0]} END"


_IND = f"""WITH {G_EDGES}, {G_NODES}, ends AS (SELECT citing AS id FROM g_edges UNION SELECT cited FROM g_edges)"""


@query(f"""{_IND}, v AS (SELECT cited_scotus AS v FROM g_nodes SEMI JOIN ends USING (id)), c AS (SELECT {_bins(S.BINS_A, "v")} AS low, count(*) AS n FROM v GROUP BY 1)
SELECT low, n, round(n / sum(n) OVER (), 6) AS share FROM c""")
def degree_histogram_g(spark, d):
    return S.histogram(E.degrees(graph_edges(spark, d)), "indeg", S.BINS_A)


@query(f"""{_IND}, c AS (SELECT {_bins(S.BINS_B, "cited_scotus + outdeg")} AS low, count(*) AS n FROM g_nodes GROUP BY 1)
SELECT low, n, round(n / sum(n) OVER (), 6) AS share FROM c""")
def degree_histogram_h(spark, d):
    e = graph_edges(spark, d)
    return S.histogram(graph_nodes(spark, d, e).withColumn("degree", F.col("cited_scotus") + F.col("outdeg")), "degree", S.BINS_B)


@query(f"{_IND} SELECT round(avg(cited_scotus), 6) AS mean, median(cited_scotus) AS median, max(cited_scotus) AS max FROM g_nodes SEMI JOIN ends USING (id)")
def degree_moments(spark, d):
    return S.moments(E.degrees(graph_edges(spark, d)), "indeg")


def _top(column: str) -> str:
    return f"""WITH {G_EDGES}, {G_NODES} SELECT CAST(row_number() OVER (ORDER BY {column} DESC, id) AS INTEGER) AS rank, id, {column} AS n FROM g_nodes ORDER BY {column} DESC, id LIMIT 40"""


@query(_top("cited_scotus"))
def top40_in_scotus(spark, d):
    e = graph_edges(spark, d).persist()
    return S.top(graph_nodes(spark, d, e), "cited_scotus").select("rank", "id", F.col("cited_scotus").alias("n"))


@query(_top("cited_all"))
def top40_all(spark, d):
    e = graph_edges(spark, d)
    return S.top(graph_nodes(spark, d, e), "cited_all").select("rank", "id", F.col("cited_all").alias("n"))


@query("SELECT substr(CAST(year(o_orderdate) AS VARCHAR), 1, 3) || '0s' AS decade, count(*) AS n FROM orders GROUP BY 1")
def by_decade(spark, d):
    return S.by_decade(table(spark, d, "orders"), F.year("o_orderdate"))


def _hubs(k: int, value: str) -> str:
    return f"""{_IND}, h AS (SELECT id FROM g_nodes SEMI JOIN ends USING (id) ORDER BY {value} DESC, id LIMIT {k})
SELECT citing, cited FROM g_edges WHERE citing NOT IN (FROM h) AND cited NOT IN (FROM h)"""


@query(_hubs(20, "cited_scotus"))
def hub_removal_20(spark, d):
    return S.remove_hubs(graph_edges(spark, d).select("citing", "cited"), 20)


@query(_hubs(100, "cited_scotus + outdeg"))
def hub_removal_100(spark, d):
    return S.remove_hubs(graph_edges(spark, d).select("citing", "cited"), 100, "degree")


@query(f"WITH {G_EDGES}, {G_NODES} SELECT g_edges.cited AS id, citing AS other, year FROM g_edges JOIN g_nodes ON id = citing ORDER BY 1, cited_all DESC, 2")
def cited_by_sorted(spark, d):
    e = graph_edges(spark, d).persist()
    rows = e.join(graph_nodes(spark, d, e), F.col("citing") == F.col("id"))
    return rows.orderBy("cited", F.desc("cited_all"), "citing").select(F.col("cited").alias("id"), F.col("citing").alias("other"), "year")


@query(f"WITH {G_EDGES}, {G_NODES} SELECT citing AS id, cited AS other, year, date FROM g_edges JOIN g_nodes ON id = cited ORDER BY 1, coalesce(year, 0), date, 2")
def cites_sorted(spark, d):
    e = graph_edges(spark, d).persist()
    rows = e.join(graph_nodes(spark, d, e), F.col("cited") == F.col("id"))
    return rows.orderBy("citing", F.coalesce("year", F.lit(0)), "date", "cited").select(F.col("citing").alias("id"), F.col("cited").alias("other"), "year", "date")


@query(f"WITH {G_EDGES} SELECT citing, cited, weight FROM g_edges ORDER BY citing, cited")
def edges_ordered(spark, d):
    return E.ordered(graph_edges(spark, d))


@query(f"WITH {G_EDGES} SELECT citing AS id, cited AS other FROM g_edges UNION SELECT cited, citing FROM g_edges")
def undirected_neighbours(spark, d):
    from casewright.operators.paths import hops

    return hops(graph_edges(spark, d), "any").select(F.col("src").alias("id"), F.col("dst").alias("other"))


@query("""SELECT event_type AS title, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS views, count_if(value >= 50) AS n50, count_if(value >= 20) AS n20, count_if(value >= 10) AS n10
FROM events GROUP BY 1""")
def pageview_sums(spark, d):
    ev = table(spark, d, "events").withColumn("p", F.from_json("props", "k long"))
    return ev.groupBy(F.col("event_type").alias("title")).agg(F.sum("p.k").alias("views"), *[F.count_if(F.col("value") >= n).alias(f"n{n}") for n in (50, 20, 10)])


@query(f"WITH {G_EDGES} SELECT citing AS id, list_sort(list(cited)) AS cites, CAST(dense_rank() OVER (ORDER BY citing) - 1 AS INTEGER) AS position FROM g_edges GROUP BY citing")
def csr_export(spark, d):
    from casewright.operators.export import adjacency

    return adjacency(graph_edges(spark, d))


@query("""SELECT 'cases' AS k, count(*) AS n, min(substr(CAST(o_orderdate AS VARCHAR), 1, 10)) AS first, max(substr(CAST(o_orderdate AS VARCHAR), 1, 10)) AS last,
count_if(o_totalprice < 50000) AS short FROM orders""")
def build_summary(spark, d):
    day = F.substring(F.col("o_orderdate").cast("string"), 1, 10)
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("first"), F.max(day).alias("last"), F.count_if(F.col("o_totalprice") < 50000).alias("short")).select(F.lit("cases").alias("k"), "*")


@query(f"""WITH {G_EDGES}, {G_NODES} SELECT CASE WHEN year < 1995 THEN 'a' WHEN year < 1997 THEN 'b' ELSE 'c' END AS era, count(*) AS n,
round(max(ln(1 + cited_all) / ln(1 + (SELECT max(cited_all) FROM g_nodes))), 6) AS brightest FROM g_nodes GROUP BY 1""")
def era_buckets(spark, d):
    n = graph_nodes(spark, d, graph_edges(spark, d)).persist()
    most = n.agg(F.max("cited_all").alias("most"))
    era = F.when(F.col("year") < 1995, "a").when(F.col("year") < 1997, "b").otherwise("c")
    rows = n.join(F.broadcast(most))
    return rows.groupBy(era.alias("era")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.log1p("cited_all") / F.log1p("most")), 6).alias("brightest"))


@query("SELECT CAST(floor(p_size / 5) AS BIGINT) AS x, CAST(floor(p_retailprice / 100) AS BIGINT) AS y, count(*) AS n FROM part GROUP BY ALL")
def grid_bins(spark, d):
    return table(spark, d, "part").groupBy(F.floor(F.col("p_size") / 5).alias("x"), F.floor(F.col("p_retailprice") / 100).alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT p_partkey AS id, p_brand AS cite, p_name AS name FROM part), x(id, cite, name) AS (VALUES (1, 'Brand#1', 'one'), (2, 'Brand#99', 'two'), (-5, 'Brand#3', 'five'))
SELECT x.id, CASE WHEN n.id IS NULL THEN x.name || ' not in node table' ELSE x.name || ' has cite ' || n.cite || ', expected ' || x.cite END AS problem
FROM x LEFT JOIN n ON n.id = x.id WHERE n.id IS NULL OR n.cite <> x.cite""")
def exclusion_audit(spark, d):
    from casewright.operators.resolve import audit

    expected = spark.createDataFrame([(1, "Brand#1", "one"), (2, "Brand#99", "two"), (-5, "Brand#3", "five")], "id long, cite string, name string")
    return audit(expected, table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("cite")))
