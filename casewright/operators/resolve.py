"""Resolution cascades: which record does a cite, a page, or an article mean?

Each one is a set of candidates with a priority, cut down by window-free aggregates (``min_by`` / ``max_by``), so a
popular key is combined map-side instead of being gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions import text as T
from casewright.session import cut


def best(candidates: DataFrame, key: str | list[str], value: str, order: Column) -> DataFrame:
    """One row of each key: the value with the largest order."""
    keys = [key] if isinstance(key, str) else key
    return candidates.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def unique_only(index: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): n distinct values of a key; value is only to be used where n = 1."""
    return index.groupBy(key).agg(F.min(value).alias(value), F.count_distinct(value).alias("n"))


def page_ranges(cases: DataFrame) -> DataFrame:
    """(volume, reporter, first, last, id) from cases (id, cites array, first_page, last_page).

    Only cites whose page is the case's first page count.
    """
    page = lambda c: F.regexp_extract(F.col(c), r"^(\d+)", 1).try_cast("long")
    rows = cases.select("id", F.explode_outer("cites").alias("cite"), page("first_page").alias("first"), page("last_page").alias("last"))
    rows = rows.select("id", T.parse_cite(F.col("cite")).alias("p"), "first", "last").where("p is not null and p.page = first and last is not null")
    return rows.select(F.col("p.volume").alias("volume"), F.col("p.reporter").alias("reporter"), "first", "last", "id").distinct()


def page_blocks(ranges: DataFrame) -> DataFrame:
    """(volume, reporter, level, block, low, high): the smallest and the largest id of the ranges cut into aligned blocks.

    Block b of level k holds the pages b * 2^k to (b + 1) * 2^k - 1.  A range is a union of few disjoint blocks (two of a
    level at most), so a page is in a range exactly if one of the page's own blocks, one a level, is in the range's.
    """
    rows = ranges.where("first <= last").select("volume", "reporter", F.greatest(F.col("first").cast("long"), F.lit(0)).alias("first"), F.col("last").cast("long").alias("last"), "id").where("first <= last")
    rows = rows.withColumn("level", F.explode(F.expr("sequence(0, least(length(bin(last - first)), 62))")))
    rows = rows.withColumn("a", F.expr("shiftright(first - 1, level) + 1")).withColumn("b", F.expr("shiftright(last - (shiftleft(1L, level) - 1), level)")).where("a <= b")
    ends = F.expr("array(if(a % 2 = 1 or level = 62, a, null), if(b % 2 = 0 or level = 62, b, null))")
    rows = rows.select("volume", "reporter", "level", F.explode(ends).alias("block"), "id").where("block is not null")
    return rows.groupBy("volume", "reporter", "level", "block").agg(F.min("id").alias("low"), F.max("id").alias("high"))


def page_hits(cites: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ref, id) of the cites (ref, cite) whose page lies in the range of exactly one case.

    Each page of a volume is looked up once, by its blocks; cites never meet all ranges of their volume.
    """
    rows = cites.select("ref", T.parse_cite(F.col("cite")).alias("p")).where("p is not null")
    rows = rows.select("ref", F.col("p.volume").alias("volume"), F.col("p.reporter").alias("reporter"), F.col("p.page").alias("page"))
    page, blocks = ["volume", "reporter", "page"], page_blocks(ranges)
    levels = F.broadcast(blocks.select("level").distinct())  # 63 at most
    asked = rows.select(*page).distinct().join(levels).withColumn("block", F.expr("shiftright(page, level)"))
    held = asked.join(blocks, ["volume", "reporter", "level", "block"]).groupBy(*page).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    met = rows.join(held, page).groupBy("ref").agg(F.min("low").alias("id"), F.max("high").alias("high"))
    return met.where("id = high").drop("high")


def known_ids(cases: DataFrame, alias: DataFrame) -> DataFrame:
    """(x, id): what each id that means a known case stands for, after the alias."""
    to = alias.where("canonical is not null").select(F.col("id").alias("x"), F.col("canonical").alias("id"))
    ids = cases.select("id").distinct()
    return ids.select(F.col("id").alias("x"), "id").join(to, "x", "left_anti").unionByName(to.join(ids, "id", "left_semi"))


def resolve_cites(cites: DataFrame, cases: DataFrame, cite_index: DataFrame, alias: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every cite with ``resolved`` and ``via``.

    cites: ref, citing, cite, category, case_ids (array), weight.  First the first case id that is known (after the
    alias); then a cite string known for one case alone (``cite_ambiguous`` if for several, which ends the search);
    then, for reporters, a page inside one case's range.  The steps depend on the list of ids and on the cite string
    alone, so each distinct one is resolved once and cites without ids meet no list.
    """
    some = F.coalesce(F.size("case_ids") > 0, F.lit(False))
    ids = cites.where(some).select("case_ids").distinct().select("case_ids", F.posexplode("case_ids").alias("pos", "x"))
    by_list = ids.join(known_ids(cases, alias), "x").groupBy("case_ids").agg(F.min(F.struct("pos", "id")).alias("first")).select("case_ids", F.col("first.id").alias("by_id"))
    reporters = F.coalesce(F.startswith(F.col("category"), F.lit("reporters")), F.lit(False))
    # Kept, as filters on parsed cites would else be pushed below the aggregate and parse every row's.
    texts = cut(cites.groupBy("cite").agg(F.max(reporters).alias("paged")))
    known = unique_only(cite_index.select(T.cite_key(F.col("cite")).alias("key"), "id"), "key", "id").withColumnRenamed("id", "by_cite")
    by_page = page_hits(texts.where("paged").select(F.col("cite").alias("ref"), "cite"), ranges).select(F.col("ref").alias("cite"), F.col("id").alias("by_page"))
    told = texts.select("cite", T.cite_key(F.col("cite")).alias("key")).join(known, "key", "left").join(by_page, "cite", "left").withColumnRenamed("cite", "text")
    listed = cites.where(some).join(by_list, "case_ids", "left").select(*cites.columns, "by_id")
    rows = listed.unionByName(cites.where(~some).withColumn("by_id", F.lit(None).cast(by_list.schema["by_id"].dataType)))
    rows = rows.join(told, F.col("cite").eqNullSafe(F.col("text")), "left").withColumn("by_page", F.when(reporters, F.col("by_page")))
    several = F.col("n") > 1
    resolved = F.coalesce("by_id", F.when(F.col("n") == 1, F.col("by_cite")), F.when(~F.coalesce(several, F.lit(False)), F.col("by_page")))
    via = (
        F.when(F.col("by_id").isNotNull(), "case_ids")
        .when(F.col("n") == 1, "cite_string")
        .when(several, "cite_ambiguous")
        .when(F.col("by_page").isNotNull(), "page_range")
        .otherwise("")
    )
    return rows.select(*cites.columns, resolved.alias("resolved"), via.alias("via"))


def resolved_edges(resolved: DataFrame) -> DataFrame:
    """(citing, cited, weight, via) from resolved cites, self cites left out; via is sorted and '+'-joined."""
    kept = resolved.where("resolved is not null and resolved <> citing")
    each = kept.groupBy("citing", F.col("resolved").alias("cited"), "via").agg(F.sum(F.coalesce("weight", F.lit(1))).alias("weight"))
    via = F.array_join(F.array_sort(F.collect_set("via")), "+")
    return each.groupBy("citing", "cited").agg(F.sum("weight").alias("weight"), via.alias("via"))


def resolution_summary(resolved: DataFrame) -> DataFrame:
    """Counts of cites by outcome, one row."""
    away = F.col("resolved").isNotNull() & (F.col("resolved") != F.col("citing"))
    return resolved.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(away & (F.col("via") == v)).alias(f"via_{v}") for v in ("case_ids", "cite_string", "page_range")],
        F.count_if(F.col("via") == "cite_ambiguous").alias("ambiguous"),
        F.count_if(F.coalesce(F.col("resolved") == F.col("citing"), F.lit(False))).alias("self_cites"),
        F.count_if(F.col("resolved").isNull() & (F.size("case_ids") > 0)).alias("outside"),
    )


def drop_second_reports(primary: DataFrame, second: DataFrame) -> DataFrame:
    """Each ``second`` record with ``how`` and ``target``: same_id, led (its parallel cite is one primary's),
    name_date (same date and squashed name; the last such primary), or new.

    Both tables: id, name, date, led (cite or null), ordinal.
    """
    led = unique_only(primary.where("led is not null and led <> ''").select(T.cite_key(F.col("led")).alias("key"), "id"), "key", "id")
    led = led.where("n = 1").select("key", F.col("id").alias("by_led"))
    named = primary.select(F.col("date").alias("d"), T.squashed_name(F.col("name")).alias("s"), "id", "ordinal")
    named = named.groupBy("d", "s").agg(F.max_by("id", "ordinal").alias("by_name"))
    key = F.when(F.col("led") != "", T.cite_key(F.col("led")))
    rows = second.withColumn("key", key).withColumn("s", T.squashed_name(F.col("name"))).withColumn("d", F.col("date"))
    same = primary.select("id").distinct().withColumn("same", F.lit(True))
    rows = rows.join(same, "id", "left").join(led, "key", "left").join(named, ["d", "s"], "left")
    how = F.when(F.col("same"), "same_id").when(F.col("by_led").isNotNull(), "led").when(F.col("by_name").isNotNull(), "name_date").otherwise("new")
    target = F.when(F.col("same"), F.col("id")).otherwise(F.coalesce("by_led", "by_name"))
    return rows.select("id", how.alias("how"), target.alias("target"))


def match_records(records: DataFrame, nodes: DataFrame, cites: list[str]) -> DataFrame:
    """(id, node): each record's node by the first of its cites that any node has.

    Among several nodes: names overlapping by half or more, then degree, then the same year; ties to the lowest id.
    records: id, name, year and the cite columns in order; nodes: id, name, year, degree, cites (array).
    """
    index = nodes.select(F.col("id").alias("node"), F.explode("cites").alias("cite")).where("cite <> ''").distinct()
    tries = [records.select("id", F.lit(k).alias("rank"), F.col(c).alias("cite")).where("cite <> ''") for k, c in enumerate(cites)]
    met = reduce(DataFrame.unionAll, tries).join(index, "cite")
    first = met.groupBy("id").agg(F.min("rank").alias("rank"))
    met = met.join(first, ["id", "rank"]).select("id", "node").distinct()
    met = met.join(records.select("id", "name", "year"), "id").join(nodes.select(F.col("id").alias("node"), F.col("name").alias("name_b"), F.col("year").alias("year_b"), "degree"), "node")
    near = T.overlap(T.name_tokens(F.col("name")), T.name_tokens(F.col("name_b"))) >= 0.5
    order = F.struct(near, F.col("degree"), F.coalesce(F.col("year").eqNullSafe(F.col("year_b")), F.lit(False)), -F.col("node"))
    return best(met, "id", "node", order)


def match_texts(nodes: DataFrame, records: DataFrame, real: int = 300) -> DataFrame:
    """(id, record): the text record of each node.

    Candidates share the node's main cite, else the first of its other cites that has any.  One candidate is taken;
    of several the best by (overlap, same year, words), ties to the lowest id, if names overlap by half; else the
    only real one among them, if its year is the node's.
    nodes: id, name, year, cite, other_cites (array, in order); records: id, name, year, words, cites (array).
    """
    index = records.select(F.col("id").alias("record"), F.explode("cites").alias("c")).where("c <> ''").distinct()
    main = nodes.where("cite <> ''").select("id", F.lit(-1).alias("rank"), F.col("cite").alias("c"))
    other = nodes.select("id", F.posexplode("other_cites").alias("rank", "c")).where("c like '% S. Ct. %' or c like '% L. Ed. %'")
    met = main.unionAll(other).join(index, "c")
    first = met.groupBy("id").agg(F.min("rank").alias("rank"))
    met = met.join(first, ["id", "rank"]).select("id", "record").distinct()
    met = met.join(nodes.select("id", "name", "year"), "id").join(
        records.select(F.col("id").alias("record"), F.col("name").alias("name_b"), F.col("year").alias("year_b"), "words"), "record"
    )
    met = met.withColumn("near", T.overlap(T.name_tokens(F.col("name")), T.name_tokens(F.col("name_b"))))
    same = F.coalesce(F.col("year").eqNullSafe(F.col("year_b")), F.lit(False))
    order = F.struct("near", same, "words", -F.col("record"))
    is_real = F.col("words") >= real
    judged = met.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by(F.struct("record", "near"), order).alias("top"),
        F.count_if(is_real).alias("reals"),
        F.min(F.when(is_real, F.struct("record", same.alias("same")))).alias("only"),
    )
    record = (
        F.when((F.col("n") == 1) | (F.col("top.near") >= 0.5), F.col("top.record"))
        .when((F.col("reals") == 1) & F.col("only.same"), F.col("only.record"))
    )
    return judged.select("id", record.alias("record")).where("record is not null")


def match_articles(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """(item, node, how) of articles: by U.S. cite, S. Ct. cite, name and year (same, before, after), or name alone.

    items: item, label, year, cites (array); nodes: id, name, year, cite, cited_all (real ones only).
    A name alone counts only for articles without a year, and means the most cited node of that name.
    """
    cited = nodes.where("cite <> ''").groupBy(F.col("cite").alias("c")).agg(F.min("id").alias("node"))
    listed = items.select("item", F.explode("cites").alias("c"))
    us = listed.where(F.col("c").rlike(r"^\d+ U\.S\. \d+$")).withColumn("rank", F.lit(0))
    sct = listed.where(F.contains("c", F.lit("S. Ct."))).withColumn("rank", F.lit(1))
    by_cite = us.unionByName(sct).join(cited, "c").select("item", "rank", F.col("c").alias("tie"), "node")
    named = nodes.select(T.normal_name(F.col("name")).alias("s"), F.col("year").alias("y"), F.col("id").alias("node"), "cited_all")
    plain = items.select("item", "year", T.normal_name(F.col("label")).alias("s"))
    years = F.explode(F.array(*[F.struct((F.col("year") + d).alias("y"), F.lit(k).alias("rank")) for k, d in ((2, 0), (3, -1), (4, 1))]))
    dated = plain.where("year is not null").select("item", "s", years.alias("t")).select("item", "s", "t.y", "t.rank")
    by_year = dated.join(named.groupBy("s", "y").agg(F.min("node").alias("node")), ["s", "y"]).select("item", "rank", F.lit("").alias("tie"), "node")
    most = named.groupBy("s").agg(F.max_by("node", F.struct("cited_all", -F.col("node"))).alias("node"))
    by_name = plain.where("year is null").join(most, "s").select("item", F.lit(5).alias("rank"), F.lit("").alias("tie"), "node")
    found = by_cite.unionAll(by_year).unionAll(by_name)
    found = found.groupBy("item").agg(F.min(F.struct("rank", "tie", "node")).alias("b"))
    how = F.when(F.col("b.rank") == 0, "us").when(F.col("b.rank") == 1, "sct").otherwise("name")
    return found.select("item", "b.node", how.alias("how"))


def notable(matched: DataFrame, views: DataFrame) -> DataFrame:
    """(node, title, views): the most-read article of each node (ties: first title)."""
    rows = matched.join(views, "item", "left").withColumn("views", F.coalesce("views", F.lit(0)))
    top = rows.groupBy("node").agg(F.max_by(F.struct("title", "views"), F.struct("views", -F.col("ordinal"))).alias("t"))
    return top.select("node", "t.title", "t.views")


def audit(expected: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, problem) of expected rows (id, cite, name) that the node table lacks or gives another cite."""
    rows = expected.join(nodes.select("id", F.coalesce("cite", F.lit("")).alias("has"), F.lit(True).alias("there")), "id", "left")
    problem = F.when(F.col("there").isNull(), F.concat(F.col("name"), F.lit(" not in node table"))).when(
        F.col("has") != F.col("cite"), F.concat(F.col("name"), F.lit(" has cite "), F.col("has"), F.lit(", expected "), F.col("cite"))
    )
    return rows.select("id", problem.alias("problem")).where("problem is not null")


def canon_nodes(canon: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cite, name, node) of well-known cases: nodes of that cite by (shared words, real, most cited, lowest id); without
    one, the lowest node of the same volume that shares a word.

    canon: cite, name; nodes: id, name, cite, is_real, cited_all.
    """
    words = lambda c: F.array_distinct(F.split(F.replace(F.lower(c), F.lit("."), F.lit("")), " +"))
    plain = F.array(*[F.lit(w) for w in ("v", "the", "of", "")])
    c = canon.select("cite", F.col("name").alias("canon"), words(F.col("name")).alias("w"))
    n = nodes.where("cite <> ''").select(F.replace("cite", F.lit("U. S."), F.lit("U.S.")).alias("cite"), F.col("id").alias("node"), words(F.col("name")).alias("v"), "is_real", "cited_all")
    shared = F.size(F.array_intersect(F.array_except("w", plain), F.col("v")))
    exact = c.join(n, "cite").groupBy("cite", "canon").agg(F.max_by("node", F.struct(shared, "is_real", "cited_all", -F.col("node"))).alias("node"))
    volume = F.substring_index("cite", " U.S.", 1)
    near = c.withColumn("volume", volume).join(n.select(volume.alias("volume"), "node", "v"), "volume").where(F.arrays_overlap("w", "v"))
    near = near.groupBy("cite", "canon").agg(F.min("node").alias("near"))
    out = c.select("cite", "canon").join(exact, ["cite", "canon"], "left").join(near, ["cite", "canon"], "left")
    return out.select("cite", F.col("canon").alias("name"), F.coalesce("node", "near").alias("node")).where("node is not null")


def through_alias(resolved: DataFrame, alias: DataFrame) -> DataFrame:
    """(id, node) with those added whose canonical record is resolved while they are not (alias: id, canonical)."""
    open_ = alias.join(resolved.select("id"), "id", "left_anti")
    added = open_.join(resolved.select(F.col("id").alias("canonical"), "node"), "canonical").select("id", "node")
    return resolved.select("id", "node").unionByName(added)


def text_index(texts: DataFrame, members: DataFrame, records: DataFrame) -> DataFrame:
    """(node, record, volume, member, words, name), by node: the nodes' records whose page is in a volume.

    texts: node, record; members: record, volume, member (what the volumes hold); records: record, words, name.
    """
    return texts.join(members, "record").join(records, "record").select("node", "record", "volume", "member", "words", "name").orderBy("node")


def with_text_flags(nodes: DataFrame, index: DataFrame, real: int = 300) -> DataFrame:
    """Nodes with has_text and is_real (a text of ``real`` words or more)."""
    held = index.groupBy(F.col("node").alias("id")).agg(F.max("words").alias("words"))
    return nodes.join(held, "id", "left").withColumn("has_text", F.col("words").isNotNull()).withColumn("is_real", F.coalesce(F.col("words") >= real, F.lit(False))).drop("words")


def records_of(resolved: DataFrame) -> DataFrame:
    """(node, records): each node's records, sorted."""
    return resolved.groupBy("node").agg(F.array_sort(F.collect_set("id")).alias("records"))


def looked_up(checks: DataFrame, nodes: DataFrame, cites: list[str], spaces: bool = True) -> DataFrame:
    """Each check (label, cite) with the ids of the nodes that have its cite, or null; without ``spaces`` blanks don't count."""
    key = (lambda c: F.col(c)) if spaces else (lambda c: F.replace(F.col(c), F.lit(" "), F.lit("")))
    held = reduce(DataFrame.unionAll, [nodes.where(F.coalesce(F.col(c), F.lit("")) != "").select(key(c).alias("key"), "id") for c in cites]).distinct()
    return checks.withColumn("key", key("cite")).join(held, "key", "left").select("label", "cite", "id")


def path_counts(edges: DataFrame) -> DataFrame:
    """How many resolved edges came one way only, by way, and how many by several (via is '+'-joined)."""
    ways = F.split("via", "[+]")
    return edges.select(F.when(F.size(ways) > 1, "several").otherwise(F.element_at(ways, 1)).alias("way")).groupBy("way").agg(F.count(F.lit(1)).alias("n"))


def date_spans(records: DataFrame, source: str = "source", date: str = "date") -> DataFrame:
    """(source, n, first, last): records and their dates (text, empty ones left out) by source; source null for all."""
    some = F.nullif(F.col(date), F.lit(""))
    return records.rollup(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.min(some).alias("first"), F.max(some).alias("last"))


def folded_items(rows: DataFrame) -> DataFrame:
    """(item, label, title, year, cites) of rows (item, label, article, cite, date, ordinal): the first row's label and
    title, the last known year, all distinct cites cleaned."""
    first = lambda c: F.min_by(c, "ordinal")
    dated = F.when(F.coalesce("date", F.lit("")) != "", F.col("ordinal"))
    cite = F.when(F.coalesce("cite", F.lit("")) != "", T.clean_cite(F.col("cite")))
    return rows.groupBy("item").agg(
        first("label").alias("label"),
        first(T.url_title(F.col("article"))).alias("title"),
        F.max_by(F.substring("date", 1, 4), dated).try_cast("int").alias("year"),
        F.array_sort(F.collect_set(cite)).alias("cites"),
    )


# Yearly views that the report counts cases above.
VIEW_FLOORS = [50000, 20000, 10000, 5000, 2000]


def by_views(cases: DataFrame) -> DataFrame:
    """Notable cases (node, title, views), most viewed first, ties by node."""
    return cases.orderBy(F.desc("views"), "node")


def floors(cases: DataFrame, floors: list[int] = VIEW_FLOORS) -> DataFrame:
    """One row: how many cases have at least each of the views."""
    return cases.agg(*[F.count_if(F.col("views") >= f).alias(f"n{f}") for f in floors])


def notable_targets(cases: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """(id, views) of real nodes of the graph with at least ``least`` views."""
    return cases.where(F.col("views") >= least).select(F.col("node").alias("id"), "views").join(nodes.where("is_real").select("id"), "id", "left_semi")


def last_year(today: Column) -> Column:
    """Struct (first, last): the first days of the first and of the last of the 12 full months before a date."""
    last = F.add_months(F.trunc(today, "month"), -1)
    return F.struct(F.add_months(last, -11).alias("first"), last.alias("last"))
