import hashlib
import random

import pytest

from classlake.llm import byte_bpe as B
from classlake.llm import queries as Q
from llm_cases import SF, documents, frame  # noqa: F401



def library(text):
    return B.encoding(B.VOCABULARY, B.SPLIT).encode_ordinary(text)


def test_pattern_and_file():
    import public_tokenizers as P

    assert B.SPLIT == P.PATTERN and B.vocabulary(P.path("byte_bpe_50k.tiktoken")) == B.vocabulary(B.VOCABULARY)


def test_safe_places():
    """Every place that SAFE finds splits a text without a change of its ids."""
    rng = random.Random(5)
    alphabet = ["a", "Z", "é", "ß", "1", "٣", "²", "'", "'s", "'re", "’", ".", ",", "!", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x1c",
                "\x85", "\xa0", " ", "　", "中", "文", "。", "，", "😀", "́", "‍", "_", "-", "[", "~", "\x00"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25)))
        want = library(text)
        for cut in B.SAFE.finditer(text):
            assert library(text[:cut.start()]) + library(text[cut.start():]) == want, (text, cut.start())
        assert B.text_ids(text, size=3).tolist() == want
    long = " ".join(rng.choice(alphabet) * rng.randint(1, 9) for _ in range(60000))
    assert len(list(B.pieces(long, 1 << 12))) > 5 and B.text_ids(long, size=1 << 12).tolist() == library(long)
    assert list(B.pieces("a" * 100, 10)) == ["a" * 100] and list(B.pieces("")) == [""]


def test_whole_table(spark, documents):
    got = {r.doc_id: r for r in Q.QUERIES["op11_byte_bpe"](spark, SF).collect()}
    assert len(got) == len(documents)
    for doc_id, text, *_ in documents:
        ids, row = library(text or ""), got[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_odd_rows(spark, frame):
    texts = [None, "", " ", "<|endoftext|>", "x" * 300000, "word " * 100000, "日本語。" * 5, "\x00\n\t", "same", "same"]
    docs = frame([(k // 2, t) for k, t in enumerate(texts)])  # ids repeat, further columns
    out = B.decode(B.encode(docs)).collect()
    assert set(docs.columns) | {"ids", "decoded"} == set(out[0].asDict())
    assert sorted((r.decoded.decode(), len(r.ids)) for r in out) == sorted((t or "", len(library(t or ""))) for t in texts)
    assert B.decode(B.encode(docs.limit(0))).collect() == []
    only = frame([(None, None)])
    assert [(r.ids, bytes(r.decoded)) for r in B.decode(B.encode(only)).collect()] == [([], b"")]


def test_clashing_names_and_broken_input(spark):
    raw = spark.createDataFrame([(1, bytearray(b"ab\xff c"), [5])], "doc_id long, text binary, ids array<int>")
    row = B.decode(B.encode(raw.selectExpr("doc_id", "cast(text as string) text", "ids")), out="text").first()
    assert bytes(row.text).decode() == "ab� c" and row.ids == library("ab� c")
    odd = spark.createDataFrame([(1, [None, 64, -1, 10**8, 65]), (2, None), (3, [])], "doc_id long, ids array<int>")
    table = B.token_bytes(B.VOCABULARY)
    want = {1: table[64].as_py() + table[65].as_py(), 2: b"", 3: b""}
    assert {r.doc_id: bytes(r.decoded) for r in B.decode(odd).collect()} == want


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_other_rank_files(spark, frame, name):
    docs = frame([(1, "Ein Beispiel, das läuft."), (2, "più città’s")])
    path = f"/opt/tokenizers/{name}.tiktoken"
    got = B.decode(B.encode(docs, path=path), path=path).collect()
    assert sorted(bytes(r.decoded).decode() for r in got) == sorted(["Ein Beispiel, das läuft.", "più città’s"])
    assert all(r.ids == B.encoding(path, B.SPLIT).encode_ordinary(r.text) for r in got)
