"""Trained scorers: held-out accuracy, misspellings, quotation, awkward rows."""

import zlib

import fixtures as X
import numpy as np

from casewright.llm import quality, toxicity
from casewright.llm.toxicity import LexiconAutomaton

BIG = "/root/testdata/sf0.1"


def accuracy(rows, labels, column):
    held = [(r.predicted, labels[r.doc_id][column]) for r in rows if r.held_out and r.doc_id in labels]
    return np.mean([p == y for p, y in held]), len(held)


def labels_of(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    rows = quality.score_quality(docs, labels).collect()
    score, n = accuracy(rows, labels_of(spark), "quality")
    assert n > 500 and score > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)


def test_quality_scores_equal_plain_log_densities():
    """Against inverse covariances and determinants written out."""
    rng = np.random.default_rng(2)
    y = (rng.random(400) < 0.6).astype(int)
    x = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5)) + y[:, None] * 0.7
    model = quality.Discriminant(x, y)
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    groups = [z[y == k] for k in (0, 1)]
    covariance = [np.cov(g.T, bias=True) for g in groups]
    pooled = sum(c * len(g) for c, g in zip(covariance, groups, strict=True)) / len(z)
    density = []
    for g, c in zip(groups, covariance, strict=True):
        weight = 0.1 + 0.9 * 5 / (5 + len(g))
        s = (1 - weight) * c + weight * pooled
        s = 0.98 * s + 0.02 * np.trace(s) / 5 * np.eye(5)
        inverse = np.linalg.inv(s)
        density.append([-0.5 * (v - g.mean(0)) @ inverse @ (v - g.mean(0)) - 0.5 * np.log(np.linalg.det(s)) for v in z])
    want = np.arcsinh((np.array(density[1]) - np.array(density[0])) / 4)
    assert np.allclose(model.difference(x), want)
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(want * model.w[0] + model.w[1]))))


def test_an_id_trains_once(spark):
    from casewright.llm.learning import training_rows

    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1)], X.LABELS)
    rows = training_rows(docs, labels, "quality", 1_000_003, -1).collect()
    assert len(rows) == 3 and sum(r.text in ("a", "b") for r in rows) == 1


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    rows = toxicity.score_toxicity(docs, labels).collect()
    score, n = accuracy(rows, labels_of(spark), "toxic")
    assert n > 500 and score > 0.96
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    import random

    rng = random.Random(6)
    terms = ["scum", "idiot", "stupid", "worthless", "ab"]
    automaton = LexiconAutomaton(terms, ["pre", "stum"])
    words = ["prefix", "pre", "stumble", "stump"]
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(3)
            at = rng.randrange(len(w) + 1)
            w[at : at + (k > 0)] = rng.choice("abistu") if k < 2 else ""
        words.append("".join(w))
    for w in words:
        if not w:
            continue
        near = [(edit_distance(t, w), i) for i, t in enumerate(terms) if edit_distance(t, w) <= toxicity.edits_for(t)]
        near += [(0, len(terms) + i) for i, s in enumerate(["pre", "stum"]) if w.startswith(s)]
        accept = automaton.run(w)[2]
        assert (min(near)[::-1] if near else None) == (divmod(int(accept[0]), 3) if len(accept) else None), w


def plain_score(model, text):
    """The score by words, edit distances and windows, one by one."""
    import math

    text = (text or "").lower()
    automaton, f = model.automaton, [0.0] * toxicity.FEATURES
    n = len(automaton.terms)
    for m in toxicity.WORD.finditer(text):
        near = [(edit_distance(t, m[0]), i) for i, t in enumerate(automaton.terms) if edit_distance(t, m[0]) <= toxicity.edits_for(t)]
        near += [(0, n + i) for i, s in enumerate(automaton.stems) if m[0].startswith(s)]
        if not near:
            continue
        distance, name = min(near)
        # a stem is met where it ends; the hit is the whole word
        quoted, abusive = toxicity.quotation(text, m.start(), m.end())
        weight = model.evidence[name, distance]
        own = weight * (1 - 0.7 * quoted)
        kind = 2 if name >= n else 0
        f[kind] += own
        f[kind + 1] = max(f[kind + 1], own)
        f[4] += weight * quoted
        f[5] += own * abusive
    x = [math.log1p(f[0]), f[1], math.log1p(f[2]), f[3], math.log1p(f[4]), math.log1p(f[5]), math.log1p(len(text)) / 10]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights, strict=False)) - model.weights[-1]))


def test_scores_equal_brute_force():
    import random

    rng = random.Random(4)
    terms, stems = ["idiot", "sh*t", "worthless", "馬鹿"], ["moron", "scu"]
    model = toxicity.ToxicityModel(LexiconAutomaton(terms, stems), np.array([[2.0, 1.5, 1.0]] * 6) * np.arange(1, 7)[:, None], 0.1, np.linspace(-1, 2, toxicity.FEATURES + 1))
    words = ["idiot", "1diot", "you", "said", '"', "sh*t", "sh*", "*sh*t*", "morons", "scum", "w0rthles", "馬鹿", "馬鹿者", "and", "İdiot", "a_b", "don’t", "”", ",", "\n"]
    texts = ["", None, *(rng.choice([" ", ""]).join(rng.choices(words, k=rng.randrange(1, 14))) for _ in range(300))]
    assert np.allclose(model.score(texts), [plain_score(model, t) for t in texts])


def test_large_lexicons_of_any_script_are_quick():
    import random
    import time

    rng = random.Random(3)
    begin = time.monotonic()
    for letters in ("abcdefghijklmnopqrstuvwxyz", "".join(chr(0x4E00 + i) for i in range(400))):
        terms = sorted({"".join(rng.choices(letters, k=rng.randrange(3, 10))) for _ in range(400)})
        automaton = LexiconAutomaton(terms, [])
        assert len(automaton.run(" ".join(terms))[0]) == len(terms)
        assert automaton.run(" ".join(terms))[2].tolist() == [i * 3 for i in range(len(terms))]
    assert time.monotonic() - begin < 20


def test_a_full_table_is_begun_anew(monkeypatch):
    automaton = LexiconAutomaton(["worthless"], [])
    want = [x.tolist() for x in automaton.run("worthless w0rthless worth")]
    monkeypatch.setattr(toxicity, "TABLE_BYTES", 0)
    for _ in range(3):
        assert [x.tolist() for x in automaton.run("worthless w0rthless worth")] == want


def test_automaton_finds_words_in_place():
    text = "an id1ot, a w0rthless!! $cum (st-upid) thing"
    start, end, accept = LexiconAutomaton(["idiot", "worthless", "stupid"], []).run(text)
    assert [(text[a:b], int(x) % 3) for a, b, x in zip(start, end, accept, strict=True)] == [("id1ot", 1), ("w0rthless", 1)]


def test_quotation_is_told_from_abuse():
    quoted, abusive = toxicity.quotation('he said "fool" was the word', 9, 13)
    assert quoted == 1.0 and abusive == 0.0
    assert toxicity.quotation("you are a fool", 10, 14) == (0.0, 1.0)


def test_window_ends_with_the_text():
    """A text's features do not depend on the texts beside it."""
    import numpy as np

    model = toxicity.ToxicityModel(LexiconAutomaton(["idiot"], []), np.ones((1, 3)), 0.0)
    texts = ["idiot", 'you said "', "an idiot", '" they wrote to you', "", "idiot"]
    assert model.features(texts).tolist() == [model.features([t])[0].tolist() for t in texts]


def test_awkward_rows_and_missing_labels(spark):
    docs = X.documents(spark)
    none = spark.createDataFrame([(None, None, None), (1, None, None)], X.LABELS)
    for run, name, base in ((quality.score_quality, "quality", 0.5), (toxicity.score_toxicity, "toxic", 0.0)):
        got = run(docs, none).collect()
        assert len(got) == len(X.ROWS) and {r.score for r in got} == {base}
        some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 14)], X.LABELS)
        got = run(docs, some).collect()
        assert len(got) == len(X.ROWS) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
        assert run(X.empty(spark), some).collect() == []
