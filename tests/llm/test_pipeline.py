"""The stages on the given tables and on odd rows, against what each stage is to do."""

import corpus_pipeline as C
import pytest
from llm_cases import SF, documents, frame  # noqa: F401
from test_decontaminate import brute as tainted
from test_minhash_forest import brute as alike

from classlake.llm import queries as Q
from classlake.llm import secret_scan as S


@pytest.fixture(scope="module")
def staged(spark):
    docs, out = Q.table(spark, SF, "documents"), []
    for name, stage in C.STAGES:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        out.append((name, docs.columns, rows))
        docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_stages(spark, staged, documents):
    assert [n for n, _ in C.STAGES] == ["language", "near_copies", "benchmark", "secrets", "mixture"]
    columns = Q.table(spark, SF, "documents").columns
    assert all(c == columns for _, c, _ in staged[:-1])
    by = {n: rows for n, _, rows in staged}
    assert {r.doc_id for r in by["language"]} == {d[0] for d in documents if any(c.isalpha() for c in d[1] or "")}
    groups = alike([(r.doc_id, r.text) for r in by["language"]])
    assert {r.doc_id for r in by["near_copies"]} == {c for _, c, _ in groups}
    items = [(r.item_id, r.text) for r in Q.table(spark, SF, "benchmark").collect()]
    bad = {x[0] for x in tainted([(r.doc_id, r.text) for r in by["near_copies"]], items) if x[4]}
    assert {r.doc_id for r in by["benchmark"]} == {r.doc_id for r in by["near_copies"]} - bad
    before = {r.doc_id: r.text for r in by["benchmark"]}
    encoding = S._encoding(open(S.VOCABULARY, "rb").read())
    assert {r.doc_id: r.text for r in by["secrets"]} == {
        i: S._masked(t, S.spans_of(t, encoding), S.MASK) for i, t in before.items()}
    assert all(r.n_chars == len(r.text) for r in by["secrets"])
    kept = {r.doc_id: r for r in by["secrets"]}
    assert by["mixture"] and all(kept[r.doc_id].text == r.text and r.mix_times >= 1 for r in by["mixture"])


def test_run(spark, staged):
    got = C.run(spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, staged[-1][2])) and C.ORACLE_SQL is None


def test_odd_rows(frame, spark):
    rows = [(1, None), (2, ""), (3, "123"), (4, "a word"), (4, "a word"), (None, "some other words", None, None), (5, "x y " * 20_000)]
    docs = frame(rows)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
    assert {r.doc_id for r in docs.collect()} <= {4, 5, None}
    docs = frame([])
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
