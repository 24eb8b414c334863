import zlib

import numpy as np

from llm_cases import documents, frame  # noqa: F401

from classlake.llm import language_id as L


def test_held_out_accuracy(frame, documents, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(docs, L.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert len(got) == docs.count() and sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in got)


def test_edge_rows(frame, documents):
    rows = [(r[0], r[1], r[2]) for r in documents]
    known = L.fit(frame(rows))
    odd = [(1, None), (1, ""), (2, "123 ...  … 😀"), (3, "中"), (None, "the and of"), (5, rows[0][1] * 200, None), (5, "A")]
    got = L.identify(frame(odd), known).collect()
    assert sorted(r.lang_pred == "und" for r in got) == [False] * 4 + [True] * 3
    assert all((r.score == 0) == (r.lang_pred == "und") for r in got)
    kept = L.keep_identified(frame(odd), known)
    assert kept.columns == frame(odd).columns and kept.count() == 4 and all(r.lang for r in kept.collect())
    assert L.identify(frame([]), known).collect() == []


def test_without_labels_and_with_one_language(frame):
    rows = [(k, "some text", None) for k in range(20)]
    assert {r.lang_pred for r in L.identify(frame(rows), L.fit(frame(rows))).collect()} == {"und"}
    rows = [(k, "some text", "xx") for k in range(20)]
    got = L.identify(frame(rows + [(99, "1")]), L.fit(frame(rows))).collect()
    assert {r.lang_pred for r in got if r.doc_id < 99} == {"xx"} and [r.lang_pred for r in got if r.doc_id == 99] == ["und"]


def test_labels_are_not_read_by_the_prediction(frame, documents):
    rows = [(r[0], r[1], r[2]) for r in documents]
    known = L.fit(frame(rows))
    a = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(frame(rows), known).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(frame([(i, t, "zz") for i, t, _ in rows]), known).collect()}
    assert a == b


def test_families_and_features():
    assert L.family("de-AT") == L.family("en") == "germanic" and L.family("FR") == "romance" and L.family("tlh") == "tlh"
    x = L.features(np.frombuffer(b"abcabc  xabc", np.uint8), np.array([0, 6, 6, 8, 12]))
    assert np.allclose((x**2).sum(axis=1), [1, 0, 0, 1])
