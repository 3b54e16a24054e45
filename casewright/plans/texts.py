"""Registered queries of names, cites, resolution cascades and markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import markup as M
from casewright.functions import text as T
from casewright.operators import resolve as V
from casewright.plans.registry import Registry
from casewright.plans.relational import _jaccard, _NAME, _overlap
from casewright.plans.standins import G_EDGES, G_META, graph_edges, graph_meta
from casewright.session import table

R = Registry()
query = R.query


@query(f"""WITH {G_EDGES}, {G_META}, m AS MATERIALIZED (SELECT id, {_NAME("name")} AS t FROM g_meta)
SELECT citing, cited, round({_overlap("a.t", "b.t")}, 6) AS overlap, round({_jaccard("a.t", "b.t")}, 6) AS jaccard FROM g_edges JOIN m a ON a.id = citing JOIN m b ON b.id = cited""")
def name_overlap_pairs(spark, d):
    """How alike the names at both ends of each cite are."""
    m = graph_meta(spark, d).select("id", T.name_tokens(F.col("name")).alias("t"))
    a, b = (m.select(F.col("id").alias(end), F.col("t").alias(f"{end}_t")) for end in ("citing", "cited"))
    rows = graph_edges(spark, d).select("citing", "cited").join(a, "citing").join(b, "cited")
    x, y = F.col("citing_t"), F.col("cited_t")
    return rows.select("citing", "cited", F.round(T.overlap(x, y), 6).alias("overlap"), F.round(T.jaccard(x, y), 6).alias("jaccard"))


_CITE_TEXT = """CASE l_linenumber % 4 WHEN 0 THEN l_suppkey || ' U. S. ' || l_partkey WHEN 1 THEN l_suppkey || '  Cranch, Rep.  ' || l_partkey || 'n'
 WHEN 2 THEN l_suppkey || ' Howard ' || l_partkey ELSE 'No cite  ' || l_suppkey END"""


def _cites(spark, d):
    s, p = F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")
    k = F.col("l_linenumber") % 4
    text = F.when(k == 0, F.concat(s, F.lit(" U. S. "), p)).when(k == 1, F.concat(s, F.lit("  Cranch, Rep.  "), p, F.lit("n")))
    text = text.when(k == 2, F.concat(s, F.lit(" Howard "), p)).otherwise(F.concat(F.lit("No cite  "), s))
    return table(spark, d, "lineitem").withColumn("cite", text)


@query(f"""WITH c AS (SELECT DISTINCT {_CITE_TEXT} AS cite FROM lineitem)
SELECT cite, CASE WHEN cite LIKE 'No%' THEN '~' || lower(regexp_replace(cite, '\\s+', ' ', 'g')) ELSE
 '#' || regexp_extract(cite, '^(\\d+)', 1) || '|' || CASE WHEN cite LIKE '% U. S. %' THEN 'us' WHEN cite LIKE '%Cranch%' THEN 'cranch' ELSE 'how' END || '|' || regexp_extract(cite, '(\\d+)n?$', 1) END AS key FROM c""")
def cite_parse(spark, d):
    return _cites(spark, d).select("cite").distinct().select("cite", T.cite_key(F.col("cite")).alias("key"))


_RANGES = """rg AS MATERIALIZED (SELECT p_size AS volume, 'us' AS reporter, p_partkey AS id, p_partkey % 90 + 1 AS first, p_partkey % 90 + 1 + p_partkey % 3 AS last FROM part),
ct AS MATERIALIZED (SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS ref, l_partkey % 50 + 1 AS v, l_suppkey % 95 + 1 AS page FROM lineitem)"""


@query(f"""WITH {_RANGES} SELECT v || ' U. S. ' || page AS cite, min(id) AS id FROM (SELECT DISTINCT v, page FROM ct) c JOIN rg ON rg.volume = v AND page BETWEEN first AND last
GROUP BY v, page HAVING count(DISTINCT id) = 1""")
def page_range_join(spark, d):
    return _paged(spark, d, table(spark, d, "lineitem"))


def _paged(spark, d, li):
    page = F.col("p_partkey") % 90 + 1
    cite = F.concat(F.col("p_size"), F.lit(" U. S. "), page)
    cases = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(cite).alias("cites"), page.cast("string").alias("first_page"), (page + F.col("p_partkey") % 3).cast("string").alias("last_page"))
    text = F.concat(F.col("l_partkey") % 50 + 1, F.lit(" U. S. "), F.col("l_suppkey") % 95 + 1)
    cites = li.select(text.alias("cite")).distinct().withColumn("ref", F.col("cite"))
    return V.page_hits(cites, V.page_ranges(cases)).select(F.col("ref").alias("cite"), "id")


_RESOLVE = """cases AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 10 < 8), alias AS (SELECT p_partkey AS id, p_partkey - 1 AS canonical FROM part WHERE p_partkey % 10 = 8),
idx AS (SELECT p_size AS v, p_partkey % 100 + 1 AS p, p_partkey AS id FROM part WHERE p_partkey % 10 < 8),
rg AS (SELECT v, p AS first, p + 2 AS last, id FROM idx WHERE id % 2 = 0),
li AS MATERIALIZED (SELECT row_number() OVER () AS ref, l_partkey % 300 AS citing, l_partkey % 50 + 1 AS v, l_suppkey % 100 + 1 AS p, l_quantity > 25 AS rep,
  CASE WHEN l_linenumber % 3 = 0 THEN [l_partkey, l_partkey + 1] ELSE [] END AS ids, CAST(l_linenumber AS BIGINT) AS weight FROM lineitem),
x AS (SELECT ref, pos, coalesce(canonical, u.x) AS id FROM (SELECT ref, unnest(ids) AS x, unnest(range(len(ids))) AS pos FROM li) u LEFT JOIN alias ON alias.id = u.x),
a AS (SELECT ref, min_by(id, pos) AS by_id FROM x SEMI JOIN cases USING (id) GROUP BY ref),
b AS (SELECT v, p, min(id) AS by_cite, count(DISTINCT id) AS n FROM idx GROUP BY v, p),
c AS (SELECT ref, min(id) AS by_page FROM li JOIN rg ON rg.v = li.v AND li.p BETWEEN first AND last WHERE rep GROUP BY ref HAVING count(DISTINCT id) = 1),
r AS MATERIALIZED (SELECT li.*, coalesce(by_id, CASE WHEN n = 1 THEN by_cite END, CASE WHEN NOT coalesce(n > 1, false) THEN by_page END) AS resolved,
  CASE WHEN by_id IS NOT NULL THEN 'case_ids' WHEN n = 1 THEN 'cite_string' WHEN n > 1 THEN 'cite_ambiguous' WHEN by_page IS NOT NULL THEN 'page_range' ELSE '' END AS via
  FROM li LEFT JOIN a USING (ref) LEFT JOIN b USING (v, p) LEFT JOIN c USING (ref))"""


def _resolved(spark, d):
    part = table(spark, d, "part")
    cases = part.where("p_partkey % 10 < 8").select(F.col("p_partkey").alias("id"))
    alias = part.where("p_partkey % 10 = 8").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") - 1).alias("canonical"))
    page = F.col("p_partkey") % 100 + 1
    index = part.where("p_partkey % 10 < 8").select(F.concat(F.col("p_size"), F.lit(" U. S. "), page).alias("cite"), F.col("p_partkey").alias("id"))
    ranges = part.where("p_partkey % 10 < 8 and p_partkey % 2 = 0").select(F.col("p_size").cast("long").alias("volume"), F.lit("us").alias("reporter"), page.alias("first"), (page + 2).alias("last"), F.col("p_partkey").alias("id"))
    li = table(spark, d, "lineitem")
    ids = F.when(F.col("l_linenumber") % 3 == 0, F.array(F.col("l_partkey"), F.col("l_partkey") + 1)).otherwise(F.array().cast("array<long>"))
    cites = li.select(
        F.monotonically_increasing_id().alias("ref"), (F.col("l_partkey") % 300).alias("citing"), F.concat(F.col("l_partkey") % 50 + 1, F.lit(" U. S. "), F.col("l_suppkey") % 100 + 1).alias("cite"),
        F.when(F.col("l_quantity") > 25, "reporters:federal").otherwise("statutes").alias("category"), ids.alias("case_ids"), F.col("l_linenumber").cast("long").alias("weight"),
    )
    return V.resolve_cites(cites, cases, index, alias, ranges)


@query(f"""WITH {_RESOLVE} SELECT citing, resolved AS cited, CAST(sum(weight) AS BIGINT) AS weight, string_agg(DISTINCT via, '+' ORDER BY via) AS via FROM r
WHERE resolved IS NOT NULL AND resolved <> citing GROUP BY ALL""")
def cite_resolution(spark, d):
    return V.resolved_edges(_resolved(spark, d))


@query(f"""WITH {_RESOLVE} SELECT count(*) AS total, count_if(resolved <> citing AND via = 'case_ids') AS via_case_ids, count_if(resolved <> citing AND via = 'cite_string') AS via_cite_string,
count_if(resolved <> citing AND via = 'page_range') AS via_page_range, count_if(via = 'cite_ambiguous') AS ambiguous, count_if(resolved = citing) AS self_cites, count_if(resolved IS NULL AND len(ids) > 0) AS outside FROM r""")
def resolution_counts(spark, d):
    return V.resolution_summary(_resolved(spark, d))


@query("""WITH p AS (SELECT p_partkey AS id, p_name AS name, p_type AS date, CASE WHEN p_size <= 20 THEN p_brand || p_size END AS led FROM part WHERE p_partkey % 4 <> 0),
s AS (SELECT CASE WHEN p_partkey % 8 = 0 THEN p_partkey + 1 ELSE p_partkey END AS id, CASE WHEN p_partkey % 3 = 0 THEN 'new one' ELSE p_name END AS name, p_type AS date, p_brand || p_size AS led FROM part WHERE p_partkey % 4 = 0),
l AS (SELECT lower(led) AS k, min(id) AS by_led FROM p WHERE led IS NOT NULL GROUP BY 1 HAVING count(DISTINCT id) = 1),
n AS (SELECT date, name, max(id) AS by_name FROM p GROUP BY ALL)
SELECT s.id, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.id = s.id) THEN 'same_id' WHEN by_led IS NOT NULL THEN 'led' WHEN by_name IS NOT NULL THEN 'name_date' ELSE 'new' END AS how,
CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.id = s.id) THEN s.id ELSE coalesce(by_led, by_name) END AS target FROM s LEFT JOIN l ON l.k = lower(s.led) LEFT JOIN n ON n.date = s.date AND n.name = s.name""")
def sct_dedup(spark, d):
    part = table(spark, d, "part")
    led = F.concat("p_brand", F.col("p_size").cast("string"))
    p = part.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("date"), F.when(F.col("p_size") <= 20, led).alias("led"), F.col("p_partkey").alias("ordinal"))
    s = part.where("p_partkey % 4 = 0").select(
        F.when(F.col("p_partkey") % 8 == 0, F.col("p_partkey") + 1).otherwise(F.col("p_partkey")).alias("id"), F.when(F.col("p_partkey") % 3 == 0, "new one").otherwise(F.col("p_name")).alias("name"), F.col("p_type").alias("date"), led.alias("led"), F.col("p_partkey").alias("ordinal"),
    )
    return V.drop_second_reports(p, s)


_MATCH = f"""n AS MATERIALIZED (SELECT p_partkey AS id, p_name AS name, p_size AS year, p_partkey % 13 AS degree, p_brand || ' ' || p_size AS cite, {_NAME("p_name")} AS t FROM part WHERE p_partkey % 2 = 0),
r AS MATERIALIZED (SELECT p_partkey AS id, p_name AS name, p_size AS year, p_partkey * 37 % 600 AS words, CASE WHEN p_partkey % 3 <> 0 THEN p_brand || ' ' || p_size END AS c1, p_brand || ' ' || (p_size + 1) AS c2, {_NAME("p_name")} AS t FROM part WHERE p_partkey % 2 = 1)"""


def _match_sides(spark, d):
    part = table(spark, d, "part")
    cite = F.concat_ws(" ", "p_brand", F.col("p_size").cast("string"))
    nodes = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("year"), (F.col("p_partkey") % 13).alias("degree"), cite.alias("cite"))
    records = part.where("p_partkey % 2 = 1").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("year"), (F.col("p_partkey") * 37 % 600).alias("words"), F.when(F.col("p_partkey") % 3 != 0, cite).alias("c1"), F.concat_ws(" ", "p_brand", (F.col("p_size") + 1).cast("string")).alias("c2"),
    )
    return nodes, records


@query(f"""WITH {_MATCH}, m AS (SELECT r.id, n.id AS node, 0 AS k, {_overlap("r.t", "n.t")} >= 0.5 AS near, degree, r.year = n.year AS same FROM r JOIN n ON n.cite = r.c1
UNION ALL SELECT r.id, n.id, 1, {_overlap("r.t", "n.t")} >= 0.5, degree, r.year = n.year FROM r JOIN n ON n.cite = r.c2)
SELECT id, node FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, near DESC, degree DESC, same DESC, node) AS w FROM m) WHERE w = 1""")
def cap_to_cl(spark, d):
    nodes, records = _match_sides(spark, d)
    return V.match_records(records, nodes.withColumn("cites", F.array("cite")), ["c1", "c2"])


@query(f"""WITH {_MATCH}, m AS (SELECT n.id, r.id AS record, {_overlap("n.t", "r.t")} AS near, n.year = r.year AS same, words FROM n JOIN (SELECT DISTINCT id, unnest([c1, c2]) AS c FROM r) i ON i.c = n.cite JOIN r ON r.id = i.id),
j AS (SELECT id, count(*) AS n, arg_max(struct_pack(record := record, near := near), (near, same, words, -record)) AS top, count_if(words >= 300) AS reals, min(CASE WHEN words >= 300 THEN struct_pack(record := record, same := same) END) AS sole FROM m GROUP BY id)
SELECT id, CASE WHEN n = 1 OR top.near >= 0.5 THEN top.record ELSE sole.record END AS record FROM j WHERE n = 1 OR top.near >= 0.5 OR (reals = 1 AND sole.same)""")
def cl_to_cap(spark, d):
    nodes, records = _match_sides(spark, d)
    return V.match_texts(nodes.withColumn("other_cites", F.array().cast("array<string>")), records.withColumn("cites", F.array("c1", "c2")))


@query("""WITH n AS (SELECT p_partkey AS id, p_name AS name, CAST(p_size AS INTEGER) AS year, p_size || ' U.S. ' || p_partkey AS cite, p_partkey % 17 AS cited_all FROM part WHERE p_partkey % 3 = 0),
i AS (SELECT p_partkey AS item, p_name AS label, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS year, CASE WHEN p_partkey % 7 = 0 THEN [p_size || ' U.S. ' || p_partkey] ELSE [] END AS cites FROM part),
c AS (SELECT item, 0 AS k, n.id AS node FROM (SELECT item, unnest(cites) AS c FROM i) x JOIN n ON n.cite = x.c
 UNION ALL SELECT item, 2 + CASE n.year - i.year WHEN 0 THEN 0 WHEN -1 THEN 1 ELSE 2 END, min(n.id) FROM i JOIN n ON n.name = i.label AND n.year BETWEEN i.year - 1 AND i.year + 1 GROUP BY item, n.year, i.year
 UNION ALL SELECT item, 5, arg_max(n.id, (cited_all, -n.id)) FROM i JOIN n ON n.name = i.label WHERE i.year IS NULL GROUP BY item),
m AS (SELECT item, arg_min(node, k) AS node, CASE WHEN min(k) = 0 THEN 'us' ELSE 'name' END AS how FROM c GROUP BY item), v AS (SELECT node, item AS title, item % 1000 AS views FROM m)
SELECT node, title, views FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY views DESC, title) AS w FROM v) WHERE w = 1""")
def notable_cascade(spark, d):
    part = table(spark, d, "part")
    cite = F.concat(F.col("p_size"), F.lit(" U.S. "), F.col("p_partkey"))
    nodes = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("year"), cite.alias("cite"), (F.col("p_partkey") % 17).alias("cited_all"))
    items = part.select(
        F.col("p_partkey").alias("item"), F.col("p_name").alias("label"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("year"), F.when(F.col("p_partkey") % 7 == 0, F.array(cite)).otherwise(F.array().cast("array<string>")).alias("cites"),
    )
    views = part.select(F.col("p_partkey").alias("item"), (F.col("p_partkey") % 1000).alias("views"))
    found = V.match_articles(items, nodes).withColumn("title", F.col("item")).withColumn("ordinal", F.col("item"))
    return V.notable(found, views)


@query("""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, href, count(*) AS n FROM a GROUP BY ALL""")
def anchor_links(spark, d):
    return M.anchors(table(spark, d, "pages").select("page_id", "html"), "page_id").groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, length(regexp_replace(regexp_replace(html, '<img[^>]*>', '', 'g'), '<p class="attorneys"[^>]*>.*?</p>', '', 'gs')) AS n FROM pages""")
def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(M.strip(F.col("html"))).cast("long").alias("n"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 80 THEN text WHEN contains(text[1:80], ' ') THEN regexp_replace(text[1:80], ' [^ ]*$', '', 's') || ' ...' ELSE text[1:80] || ' ...' END AS card FROM documents""")
def clip_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clip(F.col("text"), 80).alias("card"))


@query(f"""WITH i AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{{5,}}')) AS b FROM benchmark), w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{{5,}}')) AS a FROM documents)
SELECT doc_id, item_id, round(4 * {_jaccard("a", "b")}, 4) AS score FROM w JOIN i ON item_id = doc_id % (SELECT count(*) FROM benchmark)""")
def word_jaccard_judge(spark, d):
    """Each document judged against its target item."""
    items = table(spark, d, "benchmark").select("item_id", T.long_words(F.col("text")).alias("b"))
    n = table(spark, d, "benchmark").agg(F.count(F.lit(1)).alias("n"))
    docs = table(spark, d, "documents").join(F.broadcast(n)).select("doc_id", (F.col("doc_id") % F.col("n")).alias("item_id"), T.long_words(F.col("text")).alias("a"))
    return docs.join(items, "item_id").select("doc_id", "item_id", F.round(T.jaccard(F.col("a"), F.col("b")) * 4, 4).alias("score"))


@query("""WITH RECURSIVE k AS (SELECT n_nationkey AS id, n_nationkey || ':back' AS s FROM nation), f(id, s, i, h) AS (SELECT id, s, 1, CAST(2166136261 AS BIGINT) FROM k
UNION ALL SELECT id, s, i + 1, CAST((xor(h, CAST(ascii(s[i]) AS BIGINT)) * 16777619) % 4294967296 AS BIGINT) FROM f WHERE i <= length(s)) SELECT id, h FROM f WHERE i = length(s) + 1""")
def fnv_hash(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), T.fnv1a(F.concat(F.col("n_nationkey"), F.lit(":back"))).alias("h"))


@query()
def syllabus_summary(spark, d):
    return table(spark, d, "pages").select("page_id", M.summary(F.col("html")).alias("summary"))


@query()
def merge_duplicates(spark, d):
    """Greedy merge of parts that share a brand and size and whose names overlap."""
    from casewright.operators.edges import merge_map

    part = table(spark, d, "part")
    return merge_map(part.select(
        F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("cite"), F.col("p_name").alias("name"), F.lit("").alias("date"), F.lit("1900").alias("year"), (F.col("p_partkey") % 5 + 1).alias("degree"),
    ))


@query("""WITH n AS (SELECT p_partkey AS id, p_name AS name, p_size || ' U.S. ' || p_partkey % 40 AS cite, p_size > 25 AS is_real, p_partkey % 17 AS cited_all FROM part),
c AS (SELECT p_partkey AS k, p_size || ' U.S. ' || (p_partkey * 3) % 60 AS cite, p_name AS name FROM part),
x AS (SELECT DISTINCT cite, name, list_distinct(string_split(lower(name), ' ')) AS w FROM c),
e AS (SELECT x.cite, x.name, arg_max(id, (len(list_intersect(w, list_distinct(string_split(lower(n.name), ' ')))), is_real, cited_all, -id)) AS node FROM x JOIN n ON n.cite = x.cite GROUP BY ALL),
v AS (SELECT x.cite, x.name, min(id) AS near FROM x JOIN n ON split_part(n.cite, ' U.S.', 1) = split_part(x.cite, ' U.S.', 1) WHERE len(list_intersect(w, list_distinct(string_split(lower(n.name), ' ')))) > 0 GROUP BY ALL)
SELECT x.cite, x.name, coalesce(node, near) AS node FROM x LEFT JOIN e USING (cite, name) LEFT JOIN v USING (cite, name) WHERE coalesce(node, near) IS NOT NULL""")
def canon_resolve(spark, d):
    return _canon_resolved(spark, d)


def _canon_resolved(spark, d):
    part = table(spark, d, "part")
    cite = lambda page: F.concat(F.col("p_size"), F.lit(" U.S. "), page)
    nodes = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), cite(F.col("p_partkey") % 40).alias("cite"), (F.col("p_size") > 25).alias("is_real"), (F.col("p_partkey") % 17).alias("cited_all"))
    canon = part.select(cite(F.col("p_partkey") * 3 % 60).alias("cite"), F.col("p_name").alias("name")).distinct()
    return V.canon_nodes(canon, nodes)


@query("""WITH n AS (SELECT p_partkey AS id, p_name AS name, p_size AS cites, [p_partkey, p_partkey % 7] AS opinions, p_partkey - p_partkey % 3 AS canonical FROM part),
f AS (SELECT canonical, CAST(sum(cites) AS BIGINT) AS cites, list_sort(list_distinct(flatten(list(opinions)))) AS opinions, coalesce(list_sort(list(id) FILTER (id <> canonical)), []) AS merged_ids FROM n GROUP BY 1)
SELECT id, name, f.cites, f.opinions, f.merged_ids FROM n JOIN f ON f.canonical = n.id""")
def merged_nodes(spark, d):
    from casewright.operators.edges import merge_nodes

    part = table(spark, d, "part")
    nodes = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("cites"), F.array(F.col("p_partkey"), F.col("p_partkey") % 7).alias("opinions"))
    fold = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") - F.col("p_partkey") % 3).alias("canonical"))
    return merge_nodes(nodes, fold, ["cites"], ["opinions"])


@query("SELECT page_id, url_decode(split_part(url, '/', -1)) AS title FROM pages")
def url_titles(spark, d):
    return table(spark, d, "pages").select("page_id", T.url_title(F.col("url")).alias("title"))
