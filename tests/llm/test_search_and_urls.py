"""URL rules and exact search against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from casewright.llm import top_k, url_filter

URLS = [
    "https://www.example.com/en/1", "http://example.com/en/", "http://example.com/en", "https://EXAMPLE.com/EN/x", "http://a.b.example.net/fr/x?y=/es/", "http://net/es/", "http://net", "com/x", "", None, "http://",
    "http://www.example.com", "http://example.community/en/", "ftp://x.com//en/", "http://u:p@example.com:80/en/", "a://b.com/?q=://c.net/es/", "http://example.com/en/é#f", "://com/",
]


def brute(url, rules):
    host, path = url_filter.split_url(url)
    fits = [(len(f"{h}{p}"), h.count(".") + bool(h), f"{h}{p}", v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, "allow")


def test_urls(spark):
    df = spark.createDataFrame(list(enumerate(URLS)) + [(None, URLS[0])], "page_id long, url string").withColumn("rule", F.lit(1))
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert got == {i: brute(u, url_filter.RULES) for i, u in [*enumerate(URLS), (None, URLS[0])]}
    assert url_filter.filter_urls(df.limit(0)).collect() == []


def test_trie_equals_brute_force():
    rng = random.Random(1)
    pieces = ["", "a", "ab", "b", "en"]
    for _ in range(200):
        rules = {(h, p): v for v, h, p in [(rng.choice(["allow", "block"]), ".".join(rng.choices("xyz", k=rng.randrange(1, 4))), "/" + "/".join(rng.choices(pieces, k=rng.randrange(3)))) for _ in range(12)]}
        rules = [(v, h, p) for (h, p), v in rules.items()]
        trie = url_filter.UrlTrie(rules)
        for _ in range(30):
            url = f"s://{'.'.join(rng.choices('xyz', k=rng.randrange(1, 5)))}/{'/'.join(rng.choices(pieces, k=rng.randrange(4)))}"
            assert (trie.match(*url_filter.split_url(url)) or (None, "allow")) == brute(url, rules)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)


def brute_top(rows, every, k):
    import math

    v = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if i is not None and e and not any(x is None or not math.isfinite(x) for x in e)]
    out = []
    for n, (i, q) in enumerate(v):
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, e, strict=True)), j) for m, (j, e) in enumerate(v) if m != n and len(e) == len(q))
            out += [(i, r, x, -score) for r, (score, x) in enumerate(s[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("dim", [1, 3, 16, 64])
def test_search_equals_brute_force(spark, dim):
    rng = random.Random(dim)
    draw = lambda: [float(int(rng.gauss(0, 1) * 64)) / 64 for _ in range(dim)]
    rows = [(i, draw()) for i in range(300)] + [(1000 + i, [0.5] * dim) for i in range(40)]
    rows += [(None, draw()), (400, None), (500, []), (600, [float("nan")] * dim), (700, [None] * dim), (800, [1.0] * (dim + 1)), (900, [float("inf")] * dim), (100, draw()), (200, rows[200][1]), (7, draw()), (7, rows[7][1])]
    got = sorted(tuple(r) for r in top_k.search_multiples(vectors(spark, rows)).collect())
    assert got == brute_top(rows, 100, 10)


def test_few_and_no_vectors(spark):
    assert [tuple(r) for r in top_k.search_multiples(vectors(spark, [(0, [1.0]), (1, [2.0])])).collect()] == [(0, 1, 1, 2 * 1024 * 1024)]
    assert top_k.search_multiples(vectors(spark, [])).collect() == []


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [1.0]), (5, [3.0]), (5, [2.0]), (0, [4.0])]
    got = sorted(tuple(r) for r in top_k.search_multiples(vectors(spark, rows)).collect())
    assert got == brute_top(rows, 100, 10) and len(got) == 6


def test_many_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(top_k, "SEED", 20)
    rng = random.Random(3)
    rows = [(i, [rng.random() for _ in range(8)]) for i in range(200)]
    v = top_k.quantised(vectors(spark, rows))
    one, many = (sorted(tuple(r) for r in top_k.top_k(v, F.col("vec_id") % 5 == 0, 4, block).collect()) for block in (1000, 7))
    assert one == many == brute_top(rows, 5, 4)
