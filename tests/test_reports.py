"""Builders, caches, sinks and readers that no query holds, by small cases."""

import json
import zipfile

import pytest

from casewright.operators import export as X
from casewright.operators import puzzles as Z
from casewright.operators.api import Api
from casewright.operators.resolve import looked_up
from casewright.sources import constants, files


def chain(spark, n=8):
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)], "citing long, cited long")
    nodes = spark.createDataFrame([(i, i != 2, i) for i in range(n + 1)], "id long, is_real boolean, cited_all long")
    return edges, nodes


def test_draws_take_real_pairs_in_reach(spark):
    edges, nodes = chain(spark)
    found = Z.draw_puzzle(edges, nodes, 1)
    assert found == Z.draw_puzzle(edges, nodes, 1) and 3 <= abs(found["start"] - found["target"]) == found["shortest"] <= 5 and 2 not in (found["start"], found["target"])
    assert Z.draw_puzzle(edges.limit(0), nodes, 1, tries=1) is None
    pool = spark.createDataFrame([(5, 1), (7, 6)], "start long, target long")
    drawn = [Z.draw_puzzle(edges, nodes, s, "back", pool=pool) for s in range(2)]
    assert {(p["start"], p["target"], p["shortest"], p["par"]) for p in drawn} <= {(5, 1, 4, 6), (7, 6, 1, 1)}


def test_pool_pairs_are_distinct_and_in_reach(spark):
    edges, nodes = chain(spark)
    pairs = Z.draw_pool(edges, nodes, "back", 2, 9)
    assert len(pairs) == len(set(pairs)) == 2 and all(2 <= a - b <= 3 and 2 not in (a, b) for a, b in pairs)
    only = spark.createDataFrame([(0,)], "id long")
    assert Z.draw_pool(edges, nodes, "back", 1, 9, targets=only) == [(3, 0)]  # 2 is not real
    assert Z.draw_pool(edges, nodes, "back", 1, 9, targets=only.limit(0)) == []


def test_distances_are_searched_once(spark, tmp_path):
    edges, _ = chain(spark)
    cache = Z.DistanceCache(edges, str(tmp_path / "d"), depth=3)
    first = {r.id: r.d for r in cache.to(4, "back").collect()}
    assert first == {4: 0, 5: 1, 6: 2, 7: 3}
    cache.edges = None  # a second call must not search
    assert {r.id: r.d for r in cache.to(4, "back").collect()} == first


def test_index_is_read_by_version(spark, tmp_path):
    edges, nodes = chain(spark)
    path = str(tmp_path / "i")
    assert X.read_index(spark, path, 1) is None
    assert X.write_index({"nodes": nodes, "edges": edges}, path, 1) == {"nodes": 9, "edges": 8}
    assert X.read_index(spark, path, 1)["edges"].count() == 8 and X.read_index(spark, path, 2) is None
    X.write_index({"nodes": nodes.limit(1)}, path, 2)
    assert X.read_index(spark, path, 2)["nodes"].count() == 1 and X.read_index(spark, path, 1) is None
    assert X.write_with_side(edges, str(tmp_path / "e"), edges.groupBy("cited").count(), str(tmp_path / "c")) == (8, 8)


def test_markdown_and_sizes(spark):
    df = spark.createDataFrame([(1234567, "a|b", None)], "n long, t string, x double")
    assert X.markdown(df) == "| n | t | x |\n| --- | --- | --- |\n| 1,234,567 | a\\|b |  |"
    with pytest.raises(ValueError, match="more than 2 rows"):
        X.markdown(spark.range(3), most=2)
    size = X.packed_size("a" * 1000)
    assert size["bytes"] == 1000 > size["gzip"]


def test_graph_document_keeps_known_columns(spark, tmp_path):
    nodes = spark.createDataFrame([(5, "a", "1 U.S. 1", 1900, True, [7, 8]), (9, "b", None, None, False, [])], "id long, name string, cite string, year int, is_real boolean, cap_ids array<long>")
    (tmp_path / "g.json").write_text(X.columnar_graph(nodes, spark.createDataFrame([(9, 5)], "citing long, cited long")))
    back, _ = files.read_graph(spark, str(tmp_path / "g.json"))
    rows = {r.id: r for r in back.collect()}
    assert (rows[5].cite, rows[5].is_real, rows[5].cap_ids, rows[5].has_text) == ("1 U.S. 1", True, [7, 8], None) and rows[9].year is None


def test_readers_of_volumes_and_documents(spark, tmp_path):
    (tmp_path / "us").mkdir()
    with zipfile.ZipFile(tmp_path / "us" / "1.zip", "w") as z:
        z.writestr("metadata/CasesMetadata.json", json.dumps([{"id": 1, "court": {"name_abbreviation": "U.S."}}, {"id": 2, "court": {"name_abbreviation": "Cal."}}, {"id": 3}]))
        z.writestr("html/0005-01.html", "<p>x</p>")
        z.writestr("html/0007-01.html", "<p>y</p>")
        z.writestr("cases/0005-01.json", json.dumps({"id": 1, "cites_to": [{"cite": "1 U.S. 1"}]}))
    (tmp_path / "us" / "2.zip").write_bytes(b"broken")
    with zipfile.ZipFile(tmp_path / "us" / "3.zip", "w") as z:
        z.writestr("other", "x")
    path = f"{tmp_path}/us/*.zip"
    assert [tuple(r) for r in files.court_counts(files.read_volumes(spark, path)).collect()] == [("us", 1, 3, 1)]
    assert sorted(r.problem.split(":")[0] for r in files.broken_volumes(spark, path).collect()) == ["BadZipFile", "KeyError"]
    pages = {r.member: r for r in files.read_opinions(spark, path).collect()}
    assert pages["html/0005-01.html"].cites_to[0].cite == "1 U.S. 1" and pages["html/0007-01.html"].cites_to is None
    keys = spark.createDataFrame([("us", 1, "html/0007-01.html")], "reporter string, volume int, member string")
    assert [r.html for r in files.read_opinions(spark, path, keys).collect()] == ["<p>y</p>"]
    assert files.latest(spark, f"{tmp_path}/us/*.zip").endswith("/3.zip")
    assert files.read_document(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "some.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.read_document(spark, str(tmp_path / "some.json"), "a int").count() == 2


def test_selected_cases(spark):
    df = spark.createDataFrame([("us", True), ("s-ct", False), ("us", False)], "reporter string, is_order_like boolean")
    assert files.selected(df, us_only=True).count() == 2 and files.selected(df, orders=False).count() == 2 and files.selected(df, True, False).count() == 1


def test_constant_tables(spark):
    nodes = spark.createDataFrame([(1, "5 U. S. 137", ""), (2, None, "550 U.S. 544")], "id long, us string, sct string")
    found = {r.label: r.id for r in looked_up(constants.well_known(spark), nodes, ["us", "sct"], spaces=False).collect()}
    assert found["Marbury"] == 1 and found["Twombly"] == 2 and found["Erie"] is None and len(found) == 8
    assert constants.exclusions(spark).count() == 4


def test_case_with_text(spark):
    nodes = spark.createDataFrame([(i, f"n{i}", 1900 + i, str(1900 + i), i, True) for i in range(3)], "id long, name string, year int, date string, cited_all long, is_real boolean")
    edges = spark.createDataFrame([(2, 1), (1, 0)], "citing long, cited long")
    opinions = spark.createDataFrame([(20, 2, '<p>A v. B, <a class="citation" data-case-ids="10">1 U.S. 1</a></p>', None)], "cap_id long, node long, html string, cites_to array<struct<cite:string,case_ids:array<long>>>")
    records = spark.createDataFrame([(10, 1), (20, 2)], "cap_id long, node long")
    api = Api(nodes, edges, opinions=opinions, records=records)
    case = api.case(2)
    assert case["html"] == '<p><a class="cite" data-id="1">A v. B, 1 U.S. 1</a></p>' and case["text_stats"]["links"] == 1 and case["note"] is None
    assert api.case(1)["html"] is None and api.case(1)["note"]
