"""Readers and exports by round trips through small files."""

import bz2
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from casewright.operators.api import Api, ApiError
from casewright.operators.export import columnar_graph, dense_ids, write_modes
from casewright.operators.resolve import page_hits, page_ranges, resolve_cites
from casewright.sources import files
from casewright.streaming.degrees import streaming_indegree


def test_dump(spark, tmp_path):
    text = 'id,court_id,case_name\n1,scotus,"A \\"quoted\\" v.\nB"\n2,,"x, y"\nbad,ca1,z\n'
    (tmp_path / "d.csv.bz2").write_bytes(bz2.compress(text.encode()))
    rows = files.read_dump(spark, str(tmp_path / "d.csv.bz2"), "id bigint, case_name string, court_id string").collect()
    assert [tuple(r) for r in rows] == [(1, 'A "quoted" v.\nB', "scotus"), (2, "x, y", None), (None, "z", "ca1")]


def test_pairs_and_supplement(spark, tmp_path):
    (tmp_path / "p.csv").write_text('a,b,c\n1,10,x\n2, 20 ,"y,z\n3,n/a\n4\n')
    rows = files.read_pairs(spark, str(tmp_path / "p.csv"), "opinion", "cluster")
    assert sorted(map(tuple, rows.collect())) == [(1, 10), (2, 20)]
    more = spark.createDataFrame([(2, 99), (5, 50)], "opinion long, cluster long")
    assert sorted(map(tuple, files.with_supplement(rows, more, "opinion").collect())) == [(1, 10), (2, 99), (5, 50)]


def test_volumes(spark, tmp_path):
    (tmp_path / "us").mkdir()
    case = {"id": 7, "name": "A v. B", "decision_date": "1900-01", "first_page": "5", "last_page": "9", "citations": [{"type": "official", "cite": "1 U.S. 5"}], "court": {"name_abbreviation": "U.S."}, "analysis": {"word_count": 400}, "cites_to": [{"cite": "1 U. S. 7", "category": "reporters:federal"}]}
    with zipfile.ZipFile(tmp_path / "us" / "1.zip", "w") as z:
        z.writestr("metadata/CasesMetadata.json", json.dumps([case, case | {"id": 8, "court": {"name_abbreviation": "Cal."}}]))
        z.writestr("html/0005-01.html", "<p>é</p>")
    (tmp_path / "us" / "2.zip").write_bytes(b"broken")
    cases = files.case_table(files.read_volumes(spark, f"{tmp_path}/us/*.zip"))
    row = cases.first()
    assert cases.count() == 1 and (row.id, row.us_cite, row.year, row.is_order_like, row.volume, row.reporter) == (7, "1 U.S. 5", 1900, False, 1, "us")
    ranges = page_ranges(cases)
    cites = cases.select(F.explode("cites_to").alias("c")).select(F.lit(1).alias("ref"), "c.cite")
    assert [tuple(r) for r in page_hits(cites, ranges).collect()] == [(1, 7)]
    assert files.read_opinions(spark, f"{tmp_path}/us/*.zip").first().html == "<p>é</p>"


def test_resolution_order(spark):
    cases, index = spark.createDataFrame([(1,), (2,), (3,)], "id long"), spark.createDataFrame([("1 U.S. 1", 1), ("2 U.S. 2", 2), ("2 U. S. 2", 3)], "cite string, id long")
    alias = spark.createDataFrame([(90, 3)], "id long, canonical long")
    ranges = spark.createDataFrame([(5, "us", 10, 20, 1), (6, "us", 10, 20, 1), (6, "us", 15, 30, 2)], "volume long, reporter string, first long, last long, id long")
    rows = [("a", "9 U.S. 9", "reporters:x", [77, 90, 1]), ("b", "1 U. S. 1", "laws", []), ("c", "2 U.S. 2", "reporters:x", []), ("d", "5 U.S. 12", "reporters:x", []), ("e", "6 U.S. 16", "reporters:x", []), ("f", "5 U.S. 12", "laws", []), ("g", "x", None, [78])]
    cites = spark.createDataFrame([(r, 50, c, k, i, None) for r, c, k, i in rows], "ref string, citing long, cite string, category string, case_ids array<long>, weight long")
    got = {r.ref: (r.resolved, r.via) for r in resolve_cites(cites, cases, index, alias, ranges).collect()}
    assert got == {"a": (3, "case_ids"), "b": (1, "cite_string"), "c": (None, "cite_ambiguous"), "d": (1, "page_range"), "e": (None, ""), "f": (None, ""), "g": (None, "")}


def test_pages_in_one_range_alone(spark):
    rng = random.Random(4)
    top = 2**63 - 1
    ranges = [(v, "us", lo, lo + rng.choice([-1, 0, 1, 2, 3, 7, 40, 300]), rng.randrange(12)) for v in (1, 2) for lo in (rng.randrange(400) for _ in range(14))]
    ranges += [(3, "us", 0, top, 1), (3, "us", 5, 6, 2), (3, "us", 5, 6, None), (4, "us", 9, 9, None), (4, "us", None, 9, 3), (5, "us", top, top, 6), (5, "us", top - 4, top, 6)]
    pages = [(v, p) for v in (1, 2) for p in range(720)] + [(3, p) for p in (0, 4, 5, 6, 7, top)] + [(4, 9), (5, top), (5, top - 4), (5, top - 5), (6, 1)]
    cites = spark.createDataFrame([(k, f"{v} U.S. {p}") for k, (v, p) in enumerate(pages)] * 2, "ref long, cite string")
    expected = {}
    for k, (v, p) in enumerate(pages):
        met = {i for w, _, lo, hi, i in ranges if w == v and i is not None and lo is not None and lo <= p <= hi}
        if len(met) == 1:
            expected[k] = met.pop()
    found = page_hits(cites, spark.createDataFrame(ranges, "volume long, reporter string, first long, last long, id long"))
    assert {r.ref: r.id for r in found.collect()} == expected and len(expected) > 400
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and ("<=" in x or ">=" in x)]  # no cite is held against all ranges of its volume


def test_resolution_of_lists_and_cites_met_again(spark):
    cases, index = spark.createDataFrame([(1,), (2,), (3,)], "id long"), spark.createDataFrame([("1 U.S. 1", 1)], "cite string, id long")
    alias = spark.createDataFrame([(2, 77), (90, 3), (91, None), (1, None)], "id long, canonical long")
    ranges = spark.createDataFrame([(5, "us", 10, 20, 1)], "volume long, reporter string, first long, last long, id long")
    rows = [("x", [None, 91, 2, 90]), ("x", [None, 91, 2, 90]), ("1 U.S. 1", [2, 77]), ("x", [1, 3]), ("x", [3, 1]), (None, None), (None, []), ("5 U.S. 11", None)]
    cites = spark.createDataFrame([(r, 50, c, "reporters", i, None) for r, (c, i) in enumerate(rows)], "ref int, citing long, cite string, category string, case_ids array<long>, weight long")
    got = resolve_cites(cites, cases, index, alias, ranges)
    assert got.columns == [*cites.columns, "resolved", "via"]
    assert [(r.resolved, r.via) for r in sorted(got.collect())] == [(3, "case_ids"), (3, "case_ids"), (1, "cite_string"), (1, "case_ids"), (3, "case_ids"), (None, ""), (None, ""), (1, "page_range")]


def test_graph_document(spark, tmp_path):
    nodes = spark.createDataFrame([(70_000, "b", 1901), (5, "a", 1900), (200_000, "c", None)], "id long, name string, year int")
    edges = spark.createDataFrame([(70_000, 5), (200_000, 5)], "citing long, cited long")
    assert {r.id: r.position for r in dense_ids(nodes).collect()} == {5: 0, 70_000: 1, 200_000: 2}
    (tmp_path / "g.json").write_text(columnar_graph(nodes, edges))
    back, pairs = files.read_graph(spark, str(tmp_path / "g.json"))
    assert sorted(map(tuple, back.select("id", "name", "year").collect()), key=str) == sorted(map(tuple, nodes.collect()), key=str)
    assert sorted(map(tuple, pairs.collect())) == [(70_000, 5), (200_000, 5)]


def test_modes_not_written_stay(spark, tmp_path):
    routes = spark.createDataFrame([("any", 1), ("back", 2)], "mode string, x int")
    write_modes(routes, str(tmp_path / "r"))
    write_modes(spark.createDataFrame([("any", 9)], "mode string, x int"), str(tmp_path / "r"))
    assert sorted((r.mode, r.x) for r in spark.read.parquet(str(tmp_path / "r")).collect()) == [("any", 9), ("back", 2)]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, 2, 1), (3, 2, 2), (1, 4, 1)], "citing long, cited long, weight long").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("citing long, cited long, weight long").parquet(str(tmp_path / "e"))
    query = streaming_indegree(stream).writeStream.format("memory").queryName("indeg").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("indeg").collect())) == [(2, 2, 3), (4, 1, 1)]


def test_api(spark):
    nodes = spark.createDataFrame([(i, f"n{i}", 1900 + i, str(1900 + i), i, True) for i in range(6)], "id long, name string, year int, date string, cited_all long, is_real boolean")
    edges = spark.createDataFrame([(i + 1, i) for i in range(5)], "citing long, cited long")
    api = Api(nodes, edges)
    assert [n["id"] for n in api.path(4, 1, "back")["path"]] == [4, 3, 2, 1] and api.path(1, 4, "back") == {"length": None, "mode": "back"}
    assert api.pair_puzzle("1-0")["par"] == 1 and api.pair_puzzle("0-3", "forward")["par"] == 5
    for call, status in ((lambda: api.pair_puzzle("x"), 400), (lambda: api.pair_puzzle("0-99"), 404), (lambda: api.path(0, 1, "up"), 400), (lambda: api.pair_puzzle("0-3", "back"), 404)):
        with pytest.raises(ApiError) as e:
            call()
        assert e.value.status == status
    case = api.case(2)
    assert case["cites"] == [1] and case["cited_by"] == [3] and api.stats() == {"nodes": 6, "real": 6, "edges": 5}
    routes = spark.createDataFrame([("any:0-3", [0, 1, 2, 3])], "key string, path array<long>")
    assert Api(nodes, edges, routes=routes).opponent(1, 1, 3, [0, 1])["move"] == 2


def test_cache_only_grows_by_new_keys(spark, tmp_path):
    from casewright.operators.export import append_new

    for rows in ([(1, "a")], [(1, "b"), (2, "c")]):
        append_new(str(tmp_path / "c"), spark.createDataFrame(rows, "k long, v string"), "k")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "c")).collect())) == [(1, "a"), (2, "c")]
