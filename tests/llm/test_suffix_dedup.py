import random
import re

import numpy as np
import pytest

from llm_cases import documents, frame  # noqa: F401

from classlake.llm import suffix_dedup as S


def brute(rows, length):
    """Spans per row of rows sorted by document order."""
    seen, out = set(), []
    for text in rows:
        b = (text or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i:i + length] in seen:
                cover[i:i + length] = b"\1" * length
            seen.add(b[i:i + length])
        out.append(([(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(cover))],
                    bytes(x for x, c in zip(b, cover, strict=True) if not c), len(b)))
    return out


def result(df):
    return sorted(((r.doc_id, r.n_bytes, [(x.start, x.end) for x in r.spans], bytes(r.kept)) for r in df.collect()),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], r[3]))


def compare(frame, rows, length=100, **options):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = [(i, n, s, k) for (i, _), (s, k, n) in zip(rows, brute([t for _, t in rows], length), strict=True)]
    got = result(S.remove_repeats(frame(rows), length=length, **options))
    assert got == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], r[3]))


@pytest.mark.parametrize("hot", [1, 256])
def test_random_texts(frame, hot):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcé ") for _ in range(400)) for _ in range(4)]
    rows = []
    for k in range(120):
        cut = [b[rng.randrange(300):][:rng.randrange(150)] for b in rng.choices(base, k=3)]
        rows.append((k * 7 - 50, "".join(x + "".join(rng.choice("xyz") for _ in range(rng.randrange(9))) for x in cut)))
    rows += [(5000, None), (5001, ""), (5002, "a" * 99), (5003, "a" * 1500), (5004, "a" * 100), (None, base[0]),
             (6000, base[0] * 3), (6001, "q" * 101)]
    compare(frame, rows, hot=hot)
    compare(frame, rows[:60], length=33, hot=hot)


def test_given_documents(frame, documents):
    compare(frame, [(r[0], r[1]) for r in documents])


def test_pieces_of_long_texts(frame, monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh") for _ in range(30_000))
    found = S.records(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), 100, 24)
    assert found[3].sum() + len(found[3]) == len(text) - 99  # every window is in one record
    monkeypatch.setattr(S, "PIECE", 1000)
    compare(frame, [(1, text), (2, text[5000:25_000]), (3, "z" + text[:7000])])


def test_repeated_rows(frame):
    a, b = "abcdefghij" * 30, "0123456789klmno" * 20
    got = result(S.remove_repeats(frame([(1, a), (1, a), (1, b), (2, b + a)])))
    assert len(got) == 4 and got[0][:3] == got[1][:3] or got[1][:3] == got[2][:3]
    assert [r for r in got if r[0] == 2][0][3] != b + a


def test_no_rows(frame):
    assert result(S.remove_repeats(frame([]))) == []


def test_longest_previous():
    rng = random.Random(9)
    text = "".join(rng.choice("ab") for _ in range(200))
    order = sorted(range(200), key=lambda i: text[i:])
    common = lambda i, j: next((k for k in range(200) if text[i + k:i + k + 1] != text[j + k:j + k + 1] or i + k >= 200), 0)
    lcp = [0] + [common(a, b) for a, b in zip(order[:-1], order[1:], strict=True)]
    got = S.longest_previous(np.array(order), np.array(lcp))
    for i, v in zip(order, got.tolist(), strict=True):
        assert v == max((common(j, i) for j in range(i)), default=0)
