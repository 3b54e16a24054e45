"""Hand-made graphs: one branch each."""

import random

import pytest
from pyspark.sql import functions as F

from casewright.operators import edges as E
from casewright.operators import paths as P
from casewright.operators import puzzles as Z
from casewright.operators import stats as S
from casewright.operators import components as components_module
from casewright.operators.components import components
from casewright.queries import oracle_sql, queries
from oracle import compare


def graph(spark, pairs):
    return spark.createDataFrame(pairs, "citing long, cited long")


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def test_shortest_path_takes_smallest_sequence_and_knows_the_edges(spark):
    e = graph(spark, [(1, 3), (1, 2), (3, 4), (2, 4), (4, 5), (8, 9)])
    pairs = spark.createDataFrame([(1, 5), (5, 5), (1, 9), (5, 1)], "a long, b long")
    found = {(r.a, r.b): r.path for r in P.shortest_paths(e, pairs, 5).collect()}
    assert found == {(1, 5): [1, 2, 4, 5], (5, 5): [5], (5, 1): [5, 4, 2, 1]}
    assert {(r.a, r.b) for r in P.shortest_paths(e, pairs, 5, "back").collect()} == {(1, 5), (5, 5)}
    assert {(r.a, r.b) for r in P.shortest_paths(e, pairs, 2).collect()} == {(5, 5)}


def test_distances_in_modes_are_dual(spark):
    rng = random.Random(5)
    e = graph(spark, list({(rng.randrange(12), rng.randrange(12)) for _ in range(20)}))
    everyone = ids(spark, *range(12))
    back = {(r.source, r.id): r.d for r in P.distances(e, everyone, 12, "back").collect()}
    forward = {(r.source, r.id): r.d for r in P.distances(e, everyone, 12, "forward").collect()}
    both = {(r.source, r.id): r.d for r in P.distances(e, everyone, 12, "any").collect()}
    assert back == {(b, a): d for (a, b), d in forward.items()}
    assert both == {(b, a): d for (a, b), d in both.items()}
    assert all(both[k] <= d for k, d in back.items())


@pytest.mark.parametrize("mode", P.MODES)
def test_pairs_meet_in_the_middle(spark, monkeypatch, mode):
    rng = random.Random(8)
    links = {(rng.randrange(60), rng.randrange(60)) for _ in range(80)} | {(100 + i, 101 + i) for i in range(5)} | {(200, 201), (5, 5)}
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(150)] + [(100, 105), (105, 100), (102, 104), (200, 3), (7, 7), (999, 999), (999, 1), (1, 999), (100, 105)]
    near = {}
    for a, b in links:
        for x, y in {"back": [(a, b)], "forward": [(b, a)], "any": [(a, b), (b, a)]}[mode]:
            near.setdefault(x, set()).add(y)

    def walk(a):
        dist, level = {a: 0}, [a]
        while level:
            level = sorted({y for x in level for y in near.get(x, ())} - set(dist))
            dist |= dict.fromkeys(level, max(dist.values()) + 1)
        return dist

    expected = {(a, b): walk(a)[b] for a, b in pairs if b in walk(a)}
    asked = []
    monkeypatch.setattr(P, "components", lambda *x: asked.append(1) or components(*x))
    found = P.pair_distances(graph(spark, sorted(links)), spark.createDataFrame(pairs, "a long, b long"), mode).collect()
    assert {(r.a, r.b): r.d for r in found} == expected and len(found) == len(expected)
    assert len(asked) <= 1


def test_pairs_are_not_searched_from_one_end_alone(spark, monkeypatch):
    """Two stars a bridge apart: a search from one end would hold the other star's leaves."""
    links = [(1, k) for k in range(10, 400)] + [(2, k) for k in range(1000, 1400)] + [(1, 2)]
    kept, keep = [], P.Scratch.keep

    def count(self, df):
        kept.append((out := keep(self, df)).count())
        return out

    monkeypatch.setattr(P.Scratch, "keep", count)
    pairs = spark.createDataFrame([(10 + k, 1000 + k) for k in range(20)], "a long, b long")
    found = P.pair_distances(graph(spark, links), pairs).collect()
    assert {r.d for r in found} == {3} and len(found) == 20
    assert max(kept[1:]) < 400 * 20  # of the hops' 1,582 rows and the searches


def test_many_pairs_are_told_apart_before_any_search(spark, monkeypatch):
    links = [(c * 1000 + i, c * 1000 + (i * 7 + 1) % 100) for c in range(3) for i in range(100)]
    pairs = [(i, 1000 + i) for i in range(40)] + [(2000, 2001), (7, 7)]
    kept, asked, keep = [], [], P.Scratch.keep
    monkeypatch.setattr(P.Scratch, "keep", lambda self, df: kept.append(1) or keep(self, df))
    monkeypatch.setattr(P, "components", lambda *x: asked.append(len(kept)) or components(*x))
    found = P.pair_distances(graph(spark, links), spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {(r.a, r.b, r.d) for r in found} == {(2000, 2001, 1), (7, 7, 0)}
    assert asked == [2]  # after the links and the pairs


@pytest.fixture
def copies(spark, tmp_path):
    """Orders and lines of sf0.001 twice, with shifted keys: two graphs that nothing joins."""
    import duckdb

    source = "/root/testdata/sf0.001"
    for name, keys in {"orders": {"o_orderkey": 1500}, "lineitem": {"l_orderkey": 1500, "l_partkey": 200}}.items():
        shifted = ", ".join(f"{k} + i * {n} AS {k}" for k, n in keys.items())
        duckdb.sql(f"COPY (SELECT * REPLACE ({shifted}) FROM '{source}/{name}.parquet', (SELECT unnest([0, 1]) AS i)) TO '{tmp_path}/{name}.parquet'")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["path_length_hist", "path_length_hist_h"])
def test_path_lengths_of_two_graphs(spark, copies, monkeypatch, name):
    searched, search = [], S.pair_distances

    def watch(edges, *rest):
        searched.append(edges.agg(F.max("citing")).first()[0])
        return search(edges, *rest)

    monkeypatch.setattr(S, "pair_distances", watch)
    compare(spark, copies, queries()[name], oracle_sql()[name])
    assert name == "path_length_hist" or searched[0] < 1500  # only the largest component is searched


def shapes():
    rng = random.Random(3)
    zigzag = [x for i in range(200) for x in (i, 400 - i)]
    path = rng.sample(range(10**6), 1000)
    return {
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(120)],
        "zigzag": list(zip(zigzag, zigzag[1:], strict=False)),
        "path": list(zip(path, path[1:], strict=False)),
        "star": [(500, i) for i in range(400)],
        "clique": [(i, j) for i in range(40) for j in range(i)] + [(7, 7)],
        "empty": [],
    }


@pytest.mark.parametrize("shape", list(shapes()))
def test_components_equal_union_find_in_few_rounds(spark, monkeypatch, shape):
    pairs, parent, kept = shapes()[shape], {}, []
    keep = components_module.Scratch.keep
    monkeypatch.setattr(components_module.Scratch, "keep", lambda self, df: kept.append(1) or keep(self, df))

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    found = {r.node: r.label for r in components(graph(spark, pairs), "citing", "cited").collect()}
    assert found == {x: find(x) for x in parent}
    assert len(kept) <= 1 + 3 * 19  # three tables a round, one besides


@pytest.mark.parametrize("shape", list(shapes()))
def test_components_by_rounds_alone(spark, monkeypatch, shape):
    """Without the driver's share at the end."""
    monkeypatch.setattr(components_module, "MAX_LAST", 0)
    test_components_equal_union_find_in_few_rounds(spark, monkeypatch, shape)


def test_fold_keeps_best_connected_then_lowest(spark):
    meta = spark.createDataFrame(
        [(1, 1900, "Smith v. Jones", ""), (2, 1900, "Smith v. Jones", ""), (3, 1900, "Jones v. Smith", ""), (4, None, "Smith v. Jones", ""), (5, 1900, "alpha beta gamma delta", ""), (6, 1900, "alpha beta gamma epsilon", "")],
        "id long, year int, name string, cite string",
    )
    e = graph(spark, [(1, 2), (2, 3), (4, 1), (5, 6), (6, 5)])
    marked = E.with_meta(e, meta)
    # 2 has degree 2 as has 1; jaccard of 5 and 6 is 3/5, which suffices
    assert {(r.id, r.canonical) for r in E.fold_map(marked).collect()} == {(2, 1), (3, 1), (6, 5)}


def test_clean_up_order(spark):
    meta = spark.createDataFrame([(i, y, f"case {w}", "") for i, y, w in [(1, 1950, "ape"), (2, 1940, "bee"), (3, 1960, "cat"), (4, None, "dog"), (5, 1950, "ape eel"), (9, 1900, "hub")]], "id long, year int, name string, cite string")
    e = graph(spark, [(1, 2), (2, 3), (4, 3), (4, 2), (1, 5), (1, 9), (2, 2), (3, 2)])
    kept, fold = E.clean_graph(e, meta, ids(spark, 9))
    assert {(r.citing, r.cited) for r in kept.collect()} == {(1, 2), (4, 3), (4, 2), (3, 2)}  # 1-5 are related names of one year
    assert [(r.id, r.canonical) for r in fold.collect()] == [(5, 1)] or fold.count() == 0


def test_greedy_merge_is_not_transitive(spark):
    nodes = spark.createDataFrame(
        [(1, "1 U.S. 1", "alpha beta", "", "1900", 9), (2, "1 U.S. 1", "alpha gamma", "", "1901", 3), (3, "1 U.S. 1", "beta delta", "", "1902", 2), (4, "1 U.S. 1", "zeta eta", "", "1900", 1), (5, "", "alpha", "", "1900", 4)],
        "id long, cite string, name string, date string, year string, degree long",
    )
    assert {(r.id, r.canonical) for r in E.merge_map(nodes).collect()} == {(2, 1), (3, 1)}


def test_hubs_and_bins(spark):
    e = graph(spark, [(i, 0) for i in range(1, 8)] + [(1, 2), (3, 4)])
    assert {(r.citing, r.cited) for r in S.remove_hubs(e, 1).collect()} == {(1, 2), (3, 4)}
    table = {r.low: r.n for r in S.histogram(E.degrees(e), "indeg", S.BINS_A).collect()}
    assert table == {0: 5, 1: 2, 6: 1}


def test_race_steps_back_from_a_dead_end(spark):
    e = graph(spark, [(1, 2), (1, 3), (3, 4), (4, 5)])
    nodes = spark.createDataFrame([(1, 1, "start"), (2, 9, "wanted words here"), (3, 1, "other"), (4, 1, "thing"), (5, 1, "wanted words here")], "id long, cited_all long, text string")
    found = Z.run_race(e, nodes, 1, 5, "back")
    assert found == {"path": [1, 3, 4, 5], "score": [0.0, 0.0, None], "reached": True}
    assert Z.run_race(e, nodes, 2, 5, "back") == {"path": [2], "score": [], "reached": False}


def test_puzzles_and_opponent_are_seeded(spark):
    pairs = [(i + 1, i) for i in range(9)]
    e, nodes = graph(spark, pairs), spark.range(10).select("id", F.lit(True).alias("is_real"), F.col("id").alias("cited_all"))
    a, b = (Z.draw_puzzle(e, nodes, 7, "back") for _ in range(2))
    assert a == b and 3 <= a["shortest"] <= 5 and a["par"] == a["shortest"] + 2 and a["start"] - a["target"] == a["shortest"]
    assert Z.opponent_move(e, nodes, 1, 5, 4, [6])[0] == 4
    assert Z.opponent_move(e, nodes, 1, 0, 5, [1]) == (None, "no unvisited neighbour")
