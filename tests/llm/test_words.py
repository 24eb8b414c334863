import random

import numpy as np
import pyarrow as pa
from llm_cases import ALNUM, VISIBLE, words

from classlake.llm import words as W


def check(texts, kind, pattern):
    raw, off = W.texts(pa.array(texts, pa.string()))
    hashes, first = W.words(raw, off, kind)
    want = [words(t, pattern) for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in want]
    flat = [x for w in want for x in w]
    seen = {}
    for w, h in zip(flat, hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_words_match_the_pattern(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abAB09 .\n-_éßñ　中\x0b\x7f{[") for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += [None, "", " ", "x" * 5000, "ab", "c"]
    for size in (1 << 20, 50):  # blocks that end within words and characters
        monkeypatch.setattr(W, "BLOCK", size)
        check(texts, W.ALNUM, ALNUM)
        check(texts, W.VISIBLE, VISIBLE)


def test_grams():
    raw, off = W.texts(pa.array(["a b c d", "a b", None, "b c d"]))
    g, first = W.grams(*W.words(raw, off), 3, short=True)
    assert first.tolist() == [0, 2, 3, 3, 4] and g[1] == g[3] and len(set(g.tolist())) == 3
    g2, first = W.grams(*W.words(raw, off), 3)
    assert first.tolist() == [0, 2, 2, 2, 3] and g2.tolist() == [g[0], g[1], g[3]]
