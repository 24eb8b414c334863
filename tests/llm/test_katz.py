import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import VISIBLE, documents, frame, words  # noqa: F401
from pyspark.sql import functions as F

from classlake.llm import katz as K


def model(texts):
    """(log10 probability of a word after a history, counts, total) straight from the definition."""
    c, b = Counter(), Counter()
    for ws in texts:
        before = "<s>"
        for w in ws:
            c[w] += 1
            b[before, w] += 1
            before = w
    one, two = (K.discounts([sum(x == r for x in t.values()) for r in range(1, K.CUT + 2)]) for t in (c, b))
    factor = lambda d, r: 1.0 if r > K.CUT else d[r]
    total = sum(c.values())
    whole = total if any(x <= K.CUT for x in c.values()) else total + 1
    p1 = {w: factor(one, x) * x / whole for w, x in c.items()}
    unseen = 1 - sum(p1.values())
    after = defaultdict(dict)
    for (h, w), x in b.items():
        after[h][w] = x
    history = {}
    for h, ws in after.items():
        n = sum(ws.values()) + (0 if any(x <= K.CUT for x in ws.values()) else 1)
        left = 1 - sum(factor(two, x) * x for x in ws.values()) / n
        history[h] = (n, left / (1 - sum(p1[w] for w in ws)))

    def p(h, w):
        if w in after.get(h, ()):
            return factor(two, after[h][w]) * after[h][w] / history[h][0]
        return history.get(h, (0, 1))[1] * p1.get(w, unseen)

    for h in list(after)[:50]:  # the words and the unseen rest sum to 1
        assert abs(sum(p(h, w) for w in c) + p(h, None) - 1) < 1e-9
    return p, c, total


def check(got, rows, train):
    texts = {i: words(t, VISIBLE) + ["</s>"] for i, t in rows}
    p, c, total = model([texts[i] for i in texts if train(i)])
    assert len(got) == len(rows)
    for r in got:
        ws = texts[r.doc_id]
        score = sum(math.log10(p(h, w)) for h, w in zip(["<s>", *ws], ws))
        base = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (len(c) + 1))) for w in ws)
        assert (r.train, r.n_tokens, r.train_tokens) == (train(r.doc_id), len(ws), total)
        assert r.n_known == sum(c[w] > 0 for w in ws)
        assert r.score == pytest.approx(score, rel=1e-9) and r.base_score == pytest.approx(base, rel=1e-9)


def in_training(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1


@pytest.mark.parametrize("small", [False, True])
def test_against_definition(frame, documents, monkeypatch, small):
    rows = [(r[0], r[1]) for r in documents]
    rng = random.Random(6)
    rows += [(10_000 + k, " ".join(rng.choice("aA bB c\td é 中 . ...".split()) for _ in range(rng.randrange(9)))) for k in range(60)]
    rows += [(20_000, None), (20_001, ""), (20_002, " \n"), (None, "the the"), (20_003, "again " * 30_000)]
    if small:  # many blocks and partitions, most histories hot
        monkeypatch.setattr(K, "BLOCK_BYTES", 20_000)
        monkeypatch.setattr(K, "DEAL_BYTES", 50_000)
        monkeypatch.setattr(K, "COMMON", 300)
    check(K.katz_scores(frame(rows)).collect(), rows, in_training)


def test_repeated_rows_and_other_training_rows(frame):
    rows = [(1, "a b c"), (1, "a b c"), (2, "a c")]
    got = K.katz_scores(frame(rows), train=F.col("doc_id") == 1).collect()
    assert len(got) == 3 and len({(r.doc_id, r.score) for r in got}) == 2
    assert all(math.isfinite(r.score) and r.score < 0 and r.train_tokens == 8 for r in got)


def test_no_training_and_no_rows(frame):
    got = K.katz_scores(frame([(1, "a b"), (2, None)]), train=F.lit(False)).collect()
    assert [(r.score, r.base_score, r.n_known, r.train_tokens) for r in got] == [(0, 0, 0, 0)] * 2
    assert K.katz_scores(frame([])).collect() == []


def test_discounts():
    d = K.discounts([1000, 300, 150, 90, 60, 45])
    assert d[0] == 0 and all(0 < x < 1 for x in d[1:])
    over = 6 * 45 / 1000
    assert d[1] == pytest.approx((2 * 300 / 1000 - over) / (1 - over))
    assert np.allclose(K.discounts([0] * 6)[1:], [0.5, 0.75, 2.5 / 3, 3.5 / 4, 0.9])
