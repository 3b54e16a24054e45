"""The registered queries equal their SQL, and the pipeline's stages keep the columns."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from oracle import compare  # noqa: E402

import corpus_pipeline  # noqa: E402
from casewright.llm import queries as llm  # noqa: E402
from casewright.session import table  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_equals_sql(spark, name):
    compare(spark, SMALL, llm.queries()[name], llm.oracle_sql()[name])


def test_names():
    assert [n.split("_")[0] for n in llm.queries()] == [f"op{i}" for i in range(1, 11)]


def test_pipeline(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept


def plain_redaction(text):
    from casewright.llm import secrets

    out, end = [], 0
    for _, a, b in secrets.spans_of(text):
        if a >= end:
            out += [text[end:a], "<SECRET>"]
        end = max(end, b)
    return "".join([*out, text[end:]]) if out else text


def test_pipeline_equals_brute_force(spark):
    """Every stage's decision on its predecessor's rows: the trained one by its own scores, the others by plain code."""
    from test_documents import brute_components, brute_hits

    from casewright.llm import quality

    docs = table(spark, SMALL, "documents")
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    good = {r.doc_id for r in quality.score_quality(docs, table(spark, SMALL, "labels")).collect() if r.predicted}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    found = {d: c for d, _, c in brute_components(rows)}
    rows = [(d, t) for d, t in rows if found[d] == d]
    rows = [(d, plain_redaction(t)) for d, t in rows if not brute_hits(t, items)[-1]]
    kept = {}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert kept == dict(rows) and len(rows) > 20
    packed = corpus_pipeline.run(spark, SMALL).collect()
    sums, bins = {}, {}
    for r in packed:
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.n_tokens
        bins.setdefault(r.bin, []).append((r.bin_offset, r.n_tokens, r.doc_id))
    import re

    assert sums == {d: len(re.findall(r"[^ \t\n\x0b\f\r]+", t or "")) for d, t in rows}
    bins.pop(None, None)
    source = {r.doc_id: r.source for r in table(spark, SMALL, "documents").collect()}
    for placed in bins.values():
        end = 0
        for at, n, _ in sorted(placed):
            assert at == end
            end += n
        held = [source[d] for *_, d in placed if source[d] is not None]
        assert end <= 2048 and len(held) == len(set(held))


def test_stages_take_awkward_documents(spark, tmp_path):
    """Nulls, empty and long texts, repeats, clashing columns, and no rows at all."""
    import fixtures as X

    for name in ("labels", "benchmark"):
        table(spark, SMALL, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    for docs in (X.documents(spark), X.empty(spark)):
        columns, before = docs.columns, docs.count()
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            alone = stage(spark, docs, str(tmp_path))  # each stage on the whole awkward table
            assert alone.columns == columns and alone.count() <= before, name
            if n == 1 and before:
                assert alone.where("text is null or trim(text) = ''").count() == docs.where("text is null or trim(text) = ''").count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
