"""Registered queries of the index build, the reports and linked opinions."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import markup as M
from casewright.functions import text as T
from casewright.operators import edges as E
from casewright.operators import puzzles as Z
from casewright.operators import resolve as V
from casewright.operators import stats as S
from casewright.plans.graphs import _COMPONENTS, _FOLD, _hops
from casewright.plans.registry import Registry
from casewright.plans.relational import _overlap, EXCLUDED
from casewright.plans.standins import G_EDGES, G_NODES, graph_edges, graph_links, graph_meta, graph_nodes
from casewright.plans.texts import _MATCH, _match_sides, _RESOLVE, _resolved
from casewright.session import cut, Scratch, table

R = Registry()
query = R.query

_OUT = ", ".join(map(str, EXCLUDED))
_CLEAN = _FOLD.replace("WHERE NOT b.year > a.year)", f"WHERE NOT b.year > a.year AND citing NOT IN ({_OUT}) AND cited NOT IN ({_OUT}))")


@query(f"""WITH RECURSIVE {_CLEAN}, moved AS (SELECT DISTINCT coalesce(x.canonical, citing) AS citing, coalesce(y.canonical, cited) AS cited FROM ok
  LEFT JOIN fold x ON x.id = citing LEFT JOIN fold y ON y.id = cited WHERE coalesce(x.canonical, citing) <> coalesce(y.canonical, cited)),
kept AS MATERIALIZED (SELECT citing, cited FROM moved JOIN m a ON a.id = citing JOIN m b ON b.id = cited WHERE NOT (a.year = b.year AND {_overlap("a.p", "b.p")} >= 0.5)),
v AS MATERIALIZED (SELECT citing AS a, cited AS b FROM kept UNION SELECT cited, citing FROM kept),
found(id, label) USING KEY (id) AS (SELECT DISTINCT a, a FROM v UNION
  SELECT v.b, min(found.label) FROM found JOIN v ON v.a = found.id LEFT JOIN recurring.found k ON k.id = v.b GROUP BY v.b, k.label HAVING min(found.label) < k.label),
named AS MATERIALIZED (SELECT id, label FROM found), largest AS MATERIALIZED (SELECT label FROM named GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
SELECT citing, cited FROM kept JOIN named ON id = citing JOIN largest USING (label)""")
def game_graph(spark, d):
    """The whole clean-up: exclusions, time, fold, related names, largest component."""
    excluded = spark.createDataFrame([(x,) for x in EXCLUDED], "id long")
    return E.clean_graph(graph_edges(spark, d), graph_meta(spark, d), excluded)[0]


@query("""WITH r AS (SELECT CASE WHEN l_linenumber = 5 THEN 'n/a' ELSE CAST(l_orderkey AS VARCHAR) END AS a, CAST(l_partkey AS VARCHAR) AS b,
  CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(l_linenumber AS VARCHAR) WHEN 2 THEN 'x' END AS depth FROM lineitem)
SELECT CAST(a AS BIGINT) AS citing_opinion, CAST(b AS BIGINT) AS cited_opinion, CASE WHEN coalesce(depth, '') = '' THEN 1 ELSE CAST(depth AS BIGINT) END AS depth
FROM r WHERE a <> 'n/a' AND (depth IS NULL OR depth <> 'x')""")
def typed_citations(spark, d):
    k = F.col("l_linenumber")
    depth = F.when(k % 4 == 0, "").when(k % 4 == 1, k.cast("string")).when(k % 4 == 2, "x")
    a = F.when(k == 5, "n/a").otherwise(F.col("l_orderkey").cast("string"))
    return E.typed_map(table(spark, d, "lineitem").select(a.alias("citing_opinion"), F.col("l_partkey").cast("string").alias("cited_opinion"), depth.alias("depth")))


@query("""SELECT known, count(*) AS n FROM (SELECT o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS known FROM orders) GROUP BY 1""")
def counted_semi_join(spark, d):
    court = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return E.known_of(orders, court, "c_custkey").groupBy("known").agg(F.count(F.lit(1)).alias("n"))


_ENDS = "citing IN (SELECT id FROM g_nodes WHERE is_real) AND cited IN (SELECT id FROM g_nodes WHERE is_real)"


@query(f"WITH {G_EDGES}, {G_NODES} SELECT citing, cited FROM g_edges WHERE {_ENDS}")
def edges_of_known(spark, d):
    e = graph_edges(spark, d).select("citing", "cited")
    return S.within(e, graph_nodes(spark, d, e).where("is_real"))


_ALIAS = f"""{_MATCH}, mm AS (SELECT r.id, n.id AS node, 0 AS k, {_overlap("r.t", "n.t")} >= 0.5 AS near, degree, r.year = n.year AS same FROM r JOIN n ON n.cite = r.c1
UNION ALL SELECT r.id, n.id, 1, {_overlap("r.t", "n.t")} >= 0.5, degree, r.year = n.year FROM r JOIN n ON n.cite = r.c2),
first AS MATERIALIZED (SELECT id, node FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, near DESC, degree DESC, same DESC, node) AS w FROM mm) WHERE w = 1),
al AS (SELECT id, id - 2 AS canonical FROM r),
res AS MATERIALIZED (SELECT * FROM first UNION ALL SELECT al.id, first.node FROM al JOIN first ON first.id = canonical WHERE al.id NOT IN (SELECT id FROM first))"""


def _through(spark, d):
    nodes, records = _match_sides(spark, d)
    found = cut(V.match_records(records, nodes.withColumn("cites", F.array("cite")), ["c1", "c2"]))
    return V.through_alias(found, records.select("id", (F.col("id") - 2).alias("canonical"))), nodes, records


@query(f"WITH {_ALIAS} SELECT id, node FROM res")
def alias_propagation(spark, d):
    return _through(spark, d)[0]


@query(f"WITH {_ALIAS} SELECT node, list_sort(list(id)) AS records FROM res GROUP BY node")
def records_of_node(spark, d):
    return V.records_of(_through(spark, d)[0])


@query(f"""WITH {_MATCH}, t AS (SELECT n.id AS node, n.id + 1 AS record FROM n)
SELECT node, record, r.year % 7 AS volume, 'html/' || record || '.html' AS member, words, r.name FROM t JOIN r ON r.id = record WHERE record % 5 <> 0 ORDER BY node""")
def text_index(spark, d):
    nodes, records = _match_sides(spark, d)
    texts = nodes.select(F.col("id").alias("node"), (F.col("id") + 1).alias("record"))
    members = records.where("id % 5 <> 0").select(F.col("id").alias("record"), (F.col("year") % 7).alias("volume"), F.concat(F.lit("html/"), F.col("id"), F.lit(".html")).alias("member"))
    return V.text_index(texts, members, records.select(F.col("id").alias("record"), "words", "name"))


@query(f"""WITH {_MATCH}, t AS (SELECT n.id AS node, n.id + 1 AS record FROM n), x AS (SELECT node, words FROM t JOIN r ON r.id = record WHERE record % 5 <> 0)
SELECT n.id, words IS NOT NULL AS has_text, coalesce(words >= 300, false) AS is_real FROM n LEFT JOIN x ON node = n.id""")
def text_flags(spark, d):
    nodes, records = _match_sides(spark, d)
    index = nodes.select(F.col("id").alias("node"), (F.col("id") + 1).alias("r")).join(records.where("id % 5 <> 0").select(F.col("id").alias("r"), "words"), "r")
    return V.with_text_flags(nodes.select("id"), index)


@query("""WITH c AS (SELECT p_name || ' ' || p_partkey AS label, (p_size + p_partkey % 2) || ' U.S. ' || p_partkey AS cite FROM part)
SELECT label, c.cite, p_partkey AS id FROM c LEFT JOIN part ON c.cite IN (p_size || ' U.S. ' || p_partkey)""")
def sanity_lookups(spark, d):
    part = table(spark, d, "part")
    cite = lambda v: F.concat(v, F.lit(" U.S. "), F.col("p_partkey"))
    checks = part.select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("label"), cite(F.col("p_size") + F.col("p_partkey") % 2).alias("cite"))
    nodes = part.select(F.col("p_partkey").alias("id"), F.replace(cite(F.col("p_size")), F.lit("U.S."), F.lit("U. S.")).alias("us"), F.lit(None).cast("string").alias("sct"))
    return V.looked_up(checks, nodes, ["us", "sct"], spaces=False)


@query(f"""WITH {_RESOLVE}, e AS (SELECT citing, resolved, list_distinct(list(via)) AS ways FROM r WHERE resolved IS NOT NULL AND resolved <> citing GROUP BY ALL)
SELECT CASE WHEN len(ways) > 1 THEN 'several' ELSE ways[1] END AS way, count(*) AS n FROM e GROUP BY 1""")
def exclusive_paths(spark, d):
    return V.path_counts(V.resolved_edges(_resolved(spark, d)))


@query("""SELECT o_orderpriority AS source, count(*) AS n, min(dt) AS first, max(dt) AS last
FROM (SELECT o_orderpriority, CASE WHEN o_orderkey % 9 <> 0 THEN substr(CAST(o_orderdate AS VARCHAR), 1, 10) END AS dt FROM orders) GROUP BY ROLLUP (o_orderpriority)""")
def dates_by_source(spark, d):
    day = F.substring(F.col("o_orderdate").cast("string"), 1, 10)
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), F.when(F.col("o_orderkey") % 9 != 0, day).otherwise("").alias("date"))
    return V.date_spans(rows)


@query("SELECT c_mktsegment AS court, count(*) AS n FROM customer GROUP BY 1")
def courts(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("court")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT l_partkey AS item, l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 AS o, 'name ' || l_suppkey AS label, 'https://x/wiki/A_' || l_suppkey AS article,
  CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey || '  S.Ct. 7' ELSE '' END AS cite, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE CAST(year(l_shipdate) AS VARCHAR) || '-01' END AS date FROM lineitem),
u AS (SELECT DISTINCT ON (item, o) * FROM r ORDER BY item, o, label, article, cite, date)
SELECT item, min_by(label, o) AS label, 'A_' || substr(min_by(label, o), 6) AS title, CAST(max_by(substr(date, 1, 4), o) FILTER (date <> '') AS INTEGER) AS year,
list_sort(list_distinct(coalesce(list(replace(replace(cite, '  ', ' '), 'S.Ct.', 'S. Ct.')) FILTER (cite <> ''), []))) AS cites FROM u GROUP BY item""")
def folded_articles(spark, d):
    s = F.col("l_suppkey").cast("string")
    k = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("item"), (F.col("l_orderkey") * 1000 + k * 100 + F.col("l_suppkey") % 100).alias("ordinal"), F.concat(F.lit("name "), s).alias("label"), F.concat(F.lit("https://x/wiki/A_"), s).alias("article"),
        F.when(k % 2 == 0, F.concat(s, F.lit("  S.Ct. 7"))).otherwise("").alias("cite"), F.when(k % 3 == 0, "").otherwise(F.concat(F.year("l_shipdate").cast("string"), F.lit("-01"))).alias("date"),
    )
    first = rows.groupBy("item", "ordinal").agg(F.min(F.struct("label", "article", "cite", "date")).alias("r")).select("item", "ordinal", "r.*")
    return V.folded_items(first)


_VIEWS = "v AS (SELECT p_partkey AS node, p_name AS title, p_partkey * 7919 % 60000 AS views FROM part)"


def _views(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("title"), (F.col("p_partkey") * 7919 % 60000).alias("views"))


@query(f"WITH {_VIEWS} SELECT node, title, views FROM v ORDER BY views DESC, node")
def cases_by_views(spark, d):
    return V.by_views(_views(spark, d))


@query(f"WITH {_VIEWS} SELECT " + ", ".join(f"count_if(views >= {f}) AS n{f}" for f in V.VIEW_FLOORS) + " FROM v")
def view_floors(spark, d):
    return V.floors(_views(spark, d))


@query(f"WITH {G_EDGES}, {G_NODES}, {_VIEWS} SELECT node AS id, views FROM v JOIN g_nodes ON id = node WHERE is_real AND views >= 20000")
def notable_targets(spark, d):
    e = graph_edges(spark, d).persist()
    return V.notable_targets(_views(spark, d), graph_nodes(spark, d, e), 20000)


@query("""SELECT o_orderkey AS id, CAST(date_trunc('month', o_orderdate) - INTERVAL 12 MONTH AS DATE) AS first, CAST(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH AS DATE) AS last FROM orders""")
def view_windows(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), V.last_year(F.col("o_orderdate")).alias("w")).select("id", "w.*")


def _hubless(k: int, value: str, alone: bool) -> str:
    rest = "UNION ALL SELECT id, 1 FROM g_nodes SEMI JOIN ends USING (id) WHERE id NOT IN (FROM hub) AND id NOT IN (SELECT id FROM reach)" if alone else ""
    return f"""WITH RECURSIVE {G_EDGES}, {G_NODES}, ends AS (SELECT citing AS id FROM g_edges UNION SELECT cited FROM g_edges),
hub AS MATERIALIZED (SELECT id FROM g_nodes SEMI JOIN ends USING (id) ORDER BY {value} DESC, id LIMIT {k}),
{_COMPONENTS.format("citing NOT IN (FROM hub) AND cited NOT IN (FROM hub)")}, c AS (SELECT label, count(*) AS size FROM reach GROUP BY label {rest})
SELECT CAST(sum(size) AS BIGINT) AS nodes, (SELECT count(*) FROM sub) AS edges, count(*) AS components, max(size) AS largest, round(max(size) / sum(size), 6) AS share FROM c"""


@query(_hubless(20, "cited_scotus", True))
def hub_remeasure_g(spark, d):
    """Without the 20 most cited: nodes that are left alone stay."""
    e = graph_edges(spark, d).select("citing", "cited").persist()
    ends = e.select(F.col("citing").alias("id")).union(e.select("cited")).distinct()
    return S.remeasured(e, 20, nodes=ends)


@query(_hubless(100, "cited_scotus + outdeg", False))
def hub_remeasure_h(spark, d):
    """Without the 100 best connected: nodes that are left alone are dropped."""
    return S.remeasured(graph_edges(spark, d).select("citing", "cited").persist(), 100, "degree")


@query(f"WITH {G_EDGES}, {G_NODES} SELECT round(avg(cited_scotus + outdeg), 6) AS mean, median(cited_scotus + outdeg) AS median, max(cited_scotus + outdeg) AS max FROM g_nodes")
def degree_moments_h(spark, d):
    """Over all kept nodes, isolated ones too."""
    e = graph_edges(spark, d).persist()
    return S.moments(graph_nodes(spark, d, e).select((F.col("cited_scotus") + F.col("outdeg")).alias("degree")), "degree")


@query(f"""WITH RECURSIVE {G_EDGES}, {_COMPONENTS.format("true")}, {_hops("any")},
lcc AS MATERIALIZED (SELECT id FROM reach WHERE label = (SELECT label FROM reach GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)),
prs AS MATERIALIZED (SELECT a, b FROM (SELECT o_orderkey AS a, (o_orderkey * 11 + 5) % (SELECT count(*) FROM orders) AS b FROM orders WHERE o_orderkey % 1000 = 3) WHERE a IN (FROM lcc) AND b IN (FROM lcc) AND a <> b),
dist(source, id, d) USING KEY (source, id) AS (SELECT DISTINCT a, a, 0 FROM prs UNION
  SELECT w.source, h.dst, min(w.d) + 1 FROM dist w JOIN h ON h.src = w.id LEFT JOIN recurring.dist k ON k.source = w.source AND k.id = h.dst GROUP BY w.source, h.dst, k.d HAVING k.d IS NULL OR min(w.d) + 1 < k.d),
c AS (SELECT CAST(d AS INTEGER) AS length, count(*) AS n FROM prs JOIN dist ON source = a AND id = b GROUP BY d)
SELECT length, n, round(n / sum(n) OVER (), 6) AS share, round(sum(n) OVER (ORDER BY length) / sum(n) OVER (), 6) AS running FROM c""")
def path_length_hist_h(spark, d):
    """Sampled pairs within the largest component."""
    with Scratch(spark) as scratch:
        links = scratch.keep(graph_links(spark, d))
        inside = scratch.keep(E.giant(links, scratch))
        orders = table(spark, d, "orders")
        n = orders.agg(F.count(F.lit(1)).alias("n"))
        pairs = orders.where("o_orderkey % 1000 = 3").join(F.broadcast(n)).select(F.col("o_orderkey").alias("a"), ((F.col("o_orderkey") * 11 + 5) % F.col("n")).alias("b")).where("a <> b")
        pairs = cut(pairs.join(inside.select(F.col("id").alias("a")), "a", "left_semi").join(inside.select(F.col("id").alias("b")), "b", "left_semi"))
        links = links.join(inside.select(F.col("id").alias("citing")), "citing", "left_semi")
        return S.path_lengths(links, pairs, None, connected=True)


def _walk(mode: str, a: str, b: str) -> str:
    """Distances from a to b of the curated pairs, by mode."""
    hops = _hops(mode).replace("h AS", f"h_{mode} AS")
    return f"""{hops}, w_{mode}(source, id, d) AS (SELECT DISTINCT {a}, {a}, 0 FROM prs UNION SELECT source, dst, d + 1 FROM w_{mode} JOIN h_{mode} ON src = w_{mode}.id WHERE d < 4),
t_{mode} AS MATERIALIZED (SELECT older, newer, CAST(min(d) AS INTEGER) AS d FROM prs JOIN w_{mode} ON source = {a} AND id = {b} GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {G_EDGES}, {G_NODES}, raw AS (SELECT citing AS older, cited AS newer FROM g_edges JOIN nation ON citing = n_nationkey * 40 + 3),
prs AS MATERIALIZED (SELECT CASE WHEN a.year > b.year THEN newer ELSE older END AS older, CASE WHEN a.year > b.year THEN older ELSE newer END AS newer FROM raw JOIN g_nodes a ON a.id = older JOIN g_nodes b ON b.id = newer),
{_walk("any", "older", "newer")}, {_walk("back", "newer", "older")}, {_walk("forward", "older", "newer")}
SELECT older, newer, t_any.d AS any, t_back.d AS back, t_forward.d AS forward FROM prs LEFT JOIN t_any USING (older, newer) LEFT JOIN t_back USING (older, newer) LEFT JOIN t_forward USING (older, newer)""")
def curated_pairs(spark, d):
    e = graph_edges(spark, d).persist()
    n = graph_nodes(spark, d, e)
    pairs = e.join(F.broadcast(table(spark, d, "nation").select((F.col("n_nationkey") * 40 + 3).cast("long").alias("citing"))), "citing").select(F.col("citing").alias("older"), F.col("cited").alias("newer"))
    for end in ("older", "newer"):
        pairs = pairs.join(n.select(F.col("id").alias(end), F.col("year").alias(f"year_{end}")), end)
    return Z.curated_shortest(e.select("citing", "cited"), pairs, 4).select("older", "newer", "shortest.*")


_ANCHOR = """'<a class="cite" data-id="' || {0} || '">'"""


@query(f"""WITH p AS (SELECT p_partkey AS k, p_size AS s, CASE WHEN (p_partkey + 1) % 4 <> 0 AND p_partkey + 1 <= (SELECT max(p_partkey) FROM part) THEN (p_partkey + 1) * 10 END AS one,
  CASE WHEN (p_partkey + 3) % 4 <> 0 AND p_partkey + 3 <= (SELECT max(p_partkey) FROM part) THEN (p_partkey + 3) * 10 END AS two,
  CASE WHEN (p_partkey + 2) % 4 <> 0 AND p_partkey + 2 <= (SELECT max(p_partkey) FROM part) THEN (p_partkey + 2) * 10 END AS three FROM part)
SELECT k AS cap_id, '<p>See ' || CASE WHEN one IS NULL THEN 'Roe v. Doe &amp; Co., ' || s || ' U.S. ' || k ELSE {_ANCHOR.format("one")} || 'Roe v. Doe &amp; Co., ' || s || ' U.S. ' || k || '</a>' END
  || ' and ' || CASE WHEN two IS NULL THEN s || ' Cranch ' || k ELSE {_ANCHOR.format("two")} || s || ' Cranch ' || k || '</a>' END
  || ', held <span class="page-label">*5</span> in ' || CASE WHEN three IS NULL THEN 'Ex parte Poe, x' ELSE {_ANCHOR.format("three")} || 'Ex parte Poe, x</a>' END || '.</p>' AS html,
  CAST((one IS NOT NULL)::INTEGER + (two IS NOT NULL)::INTEGER + (three IS NOT NULL)::INTEGER AS INTEGER) AS links, (two IS NOT NULL)::INTEGER AS links_text_pass, 2 AS cap_anchors FROM p""")
def linked_opinions(spark, d):
    """Opinions whose cites become links, with the case names before them drawn in."""
    part = table(spark, d, "part")
    k = F.col("p_partkey")
    html = F.concat(
        F.lit('<p class="attorneys">For whom</p><p data-blocks=\'1\'>See Roe v. Doe &amp; Co., <a class="citation" data-case-ids="'), k + 1, F.lit('">'), F.col("p_size"), F.lit(" U.S. "), k,
        F.lit("</a> and "), F.col("p_size"), F.lit(" Cranch "), k, F.lit(', held <a id="p5" class="page-label"> *5 </a> in Ex parte Poe, <a class="citation" data-case-ids="'), k, F.lit(","), k + 2, F.lit('">x</a>.<img src="i"></p>'),
    )
    cite = F.struct(F.concat(F.col("p_size"), F.lit(" Cranch "), k).alias("cite"), F.array(k + 3).alias("case_ids"))
    opinions = part.select(k.alias("cap_id"), html.alias("html"), F.array(cite).alias("cites_to"))
    nodes = part.where("p_partkey % 4 <> 0").select(k.alias("cap_id"), (k * 10).alias("node"))
    return M.link_opinions(opinions, nodes).select("cap_id", "html", "stats.links", "stats.links_text_pass", "stats.cap_anchors")


@query("""WITH p AS (SELECT p_partkey AS id, p_name AS t, 'Held ' || repeat(p_name || ' ', 20) AS long FROM part)
SELECT id, CASE id % 4 WHEN 0 THEN 'Syllabus & ' || t WHEN 1 THEN trim(long) WHEN 2 THEN trim(long) || ' “' || trim(long) ELSE '' END AS summary FROM p""")
def page_summaries(spark, d):
    """Syllabus, else a long summary in the head matter, else body paragraphs that read like an opening."""
    t, k = F.col("p_name"), F.col("p_partkey") % 4
    long = F.concat(F.lit("Held "), F.repeat(F.concat(t, F.lit(" ")), 20))
    head = lambda *parts: F.concat(F.lit('<section class="head-matter"><h4>x</h4>'), *parts, F.lit("</section>"))
    html = (
        F.when(k == 0, F.concat(head(F.lit('<p class="syllabus">Syllabus  &amp;<br>'), t, F.lit('<a class="page-label">*9</a></p><p>'), long, F.lit("</p>")), F.lit("<p>"), long, F.lit("</p>")))
        .when(k == 1, F.concat(head(F.lit('<p class="summary">'), long, F.lit('</p><p class="summary">short</p>')), F.lit("<p>Body</p>")))
        .when(k == 2, F.concat(head(F.lit("<p>"), long, F.lit("</p>")), F.lit("<p>"), long, F.lit("</p><p>lower "), long, F.lit("</p><blockquote>“"), long, F.lit("</blockquote><p>Short.</p>")))
        .otherwise(F.concat(F.lit("<p>lower "), long, F.lit("</p>")))
    )
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), M.summary(html).alias("summary"))


@query("SELECT p_partkey AS id, 'A & B <' || p_name || '>' AS text FROM part")
def unescaped_text(spark, d):
    raw = F.concat(F.lit("  A &amp;\n B&#160;&lt;"), F.col("p_name"), F.lit("&gt; "))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), M.unescape(raw).alias("text"))


@query("""SELECT doc_id, CASE WHEN position('on' IN text) > 0 THEN substr(text, greatest(position('on' IN text) - 20, 1), position('on' IN text) - greatest(position('on' IN text) - 20, 1) + 22) END AS around FROM documents""")
def context_windows(spark, d):
    return table(spark, d, "documents").select("doc_id", T.around(F.col("text"), F.lit("on"), 20).alias("around"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_brand END AS name FROM part""")
def first_names(spark, d):
    k = F.col("p_partkey") % 3
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.first_text(F.when(k == 0, F.col("p_name")).otherwise(""), F.when(k == 1, F.col("p_brand")), F.lit("")).alias("name"))

