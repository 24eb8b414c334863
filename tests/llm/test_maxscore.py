import math
import random

import numpy as np
import pytest

from classlake.llm import maxscore as M


def brute(rows, k=5, step=7):
    vectors = []
    for i, v in rows:
        v = None if v is None else [None if c is None else float(np.float32(c)) for c in v]
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors.append((i, [math.floor(256 * c) for c in v]))
    out = []
    for n, (q, x) in enumerate(vectors):
        if q is not None and q % step == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i is None, i or 0) for m, (i, y) in enumerate(vectors) if m != n)[:k]
            out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(best)]
    return sorted(out, key=str)


def run(spark, rows, k=5, step=7, **options):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rank int, score long")
    v = M.scaled(df)
    return sorted((tuple(r) for r in M.top_k(v, v.filter(f"vec_id % {step} = 0"), k, **options).collect()), key=str)


@pytest.mark.parametrize("kind", ["dense", "sparse", "positive", "negative", "equal"])
def test_against_brute_force(spark, kind, monkeypatch):
    rng = random.Random(kind)
    monkeypatch.setattr(M, "BLOCK_ROWS", 50)

    def component():
        x = rng.gauss(0, 0.3)
        return {"dense": x, "sparse": x if rng.random() < 0.1 else 0.0, "positive": abs(x), "negative": -abs(x),
                "equal": 0.25}[kind]

    rows = [(k * 3 % 1009, [component() for _ in range(12)]) for k in range(600)]
    assert run(spark, rows) == brute(rows)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(M, "PLANS", 2)
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(90)]
    assert run(spark, rows, step=3, per_block=5) == brute(rows, step=3)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (7, [0.5]), (14, []), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]),
            (5, [-1.0, -1.0]), (5, [-2.0, 0.0]), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (None, [9.0, 9.0]), (8, [0.0, 0.0, 100000.0])]
    assert run(spark, rows) == brute(rows)
    again = [(k % 20, [float(k % 3), 1.0 - k % 5]) for k in range(60)] + [(None, [2.0, -3.0]), (None, [2.0, -3.0])]
    assert run(spark, again) == brute(again)  # rows that share an id, and rows without one
    assert run(spark, [(0, [1.0]), (7, [2.0])]) == [(0, 1, 7, 131072), (7, 1, 0, 131072)]
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == []
    big = [(k, [4e6 * (k - 3), 3e-3, 1.0]) for k in range(6)]  # sums that doubles cannot hold
    assert run(spark, big) == brute(big) and max(r[3] for r in brute(big)) > 2**53
