"""Golden values of the text functions, draws and markup."""

import pytest
from pyspark.sql import functions as F

from casewright.functions import markup as M
from casewright.functions import text as T
from casewright.functions.seeded import fnv1a, generator, mulberry32, pick


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "cite, key",
    [("264 U. S. 182", "#264|us|182"), ("264 U. S. 182", "#264|us|182"), ("1 Dall. Rep. 1", "#1|dall|1"), ("1 Dallas 1", "#1|dall|1"), ("547 U. S. 1205n", "#547|us|1205"), ("  No  Cite ", "~no cite"), (None, "~")],
)
def test_cites(spark, cite, key):
    assert value(spark, T.cite_key(F.lit(cite))) == key


def test_tokenisers_differ(spark):
    name = F.lit("The United States v. A. B. Company & Mr. X Railroad")
    assert sorted(value(spark, T.merge_tokens(name))) == ["mr", "railroad"]
    assert sorted(value(spark, T.name_tokens(name))) == ["b", "railroad", "states", "united", "x"]
    assert sorted(value(spark, T.distinctive_tokens(name))) == ["b", "x"]


def test_names(spark):
    assert value(spark, T.normal_name(F.lit("Nat'l Ass'n v. Bd. of Educ., Inc."))) == "national association board educ"
    assert value(spark, T.normal_name(F.lit("Nat'l Bd v. X"), expand=False)) == "nat l bd x"
    assert value(spark, T.squashed_name(F.lit("Café v. O'Neil"))) == "cafévoneil"
    assert value(spark, T.clip(F.lit("one two three"), 9)) == "one two ..."
    assert value(spark, T.clip(F.lit("one"), 9)) == "one"
    assert value(spark, T.overlap(F.array(), F.array(F.lit("a")))) == 0.0


def test_hash_and_draws(spark):
    assert fnv1a("1:back") == 2103295217 == value(spark, T.fnv1a(F.lit("1:back")))
    draw = mulberry32(1)
    assert [round(draw(), 6) for _ in range(2)] == [0.627074, 0.002736]
    assert pick(generator("k"), [1, 2, 3]) == pick(generator("k"), [1, 2, 3])


def test_links():
    html = '<p><em>See Swift</em> v. <em>Tyson</em>, <a class="citation" data-case-ids="5,6">16 Pet. 1</a> and 9 U. S. 9; <a class="citation" data-case-ids="7">x</a></p>'
    out, stats = M.link_cites(html, [("9 U. S. 9", [8]), ("1 U. S. 1", [])], {5: 50, 6: 50, 7: 70, 8: 80}, 70)
    assert stats["links"] == 2 and stats["links_text_pass"] == 1 and stats["linked_ids"] == [50, 80] and stats["cites_to_cases"] == 1
    assert '<a class="cite" data-id="80">9 U. S. 9</a>; x</p>' in out
    plain, _ = M.link_cites('<p>See Swift v. Tyson, <a class="citation" data-case-ids="5">16 Pet. 1</a></p>', [], {5: 50})
    assert plain == '<p>See <a class="cite" data-id="50">Swift v. Tyson, 16 Pet. 1</a></p>'
    unbalanced, _ = M.link_cites('<p>so <em>Swift v. Tyson, <a class="citation" data-case-ids="5">16 Pet. 1</a></em></p>', [], {5: 50})
    assert unbalanced == '<p>so <em>Swift v. Tyson, <a class="cite" data-id="50">16 Pet. 1</a></em></p>'


def test_link_opinions(spark):
    ops = spark.createDataFrame([(1, '<p>A v. B, <a class="citation" data-case-ids="2">1 U. S. 1</a></p><img src="x">', [("1 U. S. 1", [2])]), (2, "", None)], "cap_id long, html string, cites_to array<struct<cite:string,case_ids:array<long>>>")
    nodes = spark.createDataFrame([(2, 20)], "cap_id long, node long")
    rows = {r.cap_id: r for r in M.link_opinions(ops, nodes).collect()}
    assert rows[1].html == '<p><a class="cite" data-id="20">A v. B, 1 U. S. 1</a></p>' and rows[1].stats.links == 1
    assert rows[2].html == "" and rows[2].stats.links == 0


def test_summary():
    long = "A" * 150
    assert M.summarise(f'<section class="head-matter"><p class="summary">{long}</p></section><p>body</p>') == long
    assert M.summarise(f'<p>lower {long}</p><p>{long}<a class="page-label">12</a></p>') == long
    assert M.summarise(None) == ""


def test_urls_paths_and_windows(spark):
    assert value(spark, T.url_title(F.lit("https://x/wiki/A+b_%28c%29"))) == "A+b_(c)"
    assert tuple(value(spark, T.volume_of(F.lit("data/cap/raw/s-ct/134.zip")))) == ("s-ct", 134)
    with pytest.raises(Exception, match="not a volume"):
        value(spark, T.volume_of(F.lit("x.zip")))
    assert value(spark, T.around(F.lit("abc 1 U.S. 2 def"), F.lit("1 U.S. 2"), 2)) == "c 1 U.S. 2 d"
    assert value(spark, T.around(F.lit("abc"), F.lit("z"))) is None
