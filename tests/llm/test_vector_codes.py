import hashlib
import math
import random

import numpy as np
import pytest

from classlake.llm import vector_codes as V


def brute(rows, entries=256, rounds=4):
    """Codes from the definition, in Python's integers; (rows, digest)."""
    kept = []
    for i, v, label in rows:
        v = None if v is None else [None if c is None else float(np.float32(c)) for c in v]
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, [max(-(2**62), min(2**62, math.floor(1024 * c))) for c in v], label))
    if not kept:
        return [], None
    width = max(1, -(-max(len(v) for _, v, _ in kept) // 4))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [(i, [*v, *[0] * (4 * width - len(v))], label) for i, v, label in kept]
    parts = [[tuple(v[p * width:(p + 1) * width]) for _, v, _ in kept] for p in range(4)]
    books = [[list(x) for x in ps[:entries]] for ps in parts]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for ps, book in zip(parts, books):
            groups = {}
            for x in ps:
                groups.setdefault(best(x, book)[1], []).append(x)
            for k, xs in groups.items():
                book[k] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [[best(x, book) for x in ps] for ps, book in zip(parts, books)]
    error = [sum(f[n][0] for f in found) for n in range(len(kept))]
    total = {}
    for (_, _, label), e in zip(kept, error):
        total[label] = total.get(label, 0) + e
    top = 2**63 - 1
    out = [(i, "".join(f"{f[n][1]:02x}" for f in found), min(top, error[n]), min(top, total[label]))
           for n, (i, _, label) in enumerate(kept)]
    return sort(out), hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def sort(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 7, 8) for r in rows],
                               "vec_id long, embedding array<float>, label int, code string, error long, part int")
    codes, books = V.compress(df, **options)
    out = sort(tuple(r) for r in codes.select("vec_id", "code", "error", "label_error").collect())
    return out, V.digest(books) if len(books[0]) else None


@pytest.mark.parametrize("kind,entries", [("dense", 256), ("small", 16), ("few values", 8), ("copies", 5), ("equal", 4), ("wide", 16)])
def test_against_definition(spark, kind, entries):
    rng = random.Random(kind)
    pool = [[rng.gauss(0, 0.4) for _ in range(8)] for _ in range(12)]

    def vector():
        if kind == "copies":
            return rng.choice(pool)
        return [{"dense": rng.gauss(0, 0.4), "small": rng.gauss(0, 0.003), "few values": rng.choice((-0.5, 0.0, 0.25)), "equal": 0.5,
                 "wide": rng.gauss(0, 1) * 10 ** rng.randint(-2, 12)}[kind] for _ in range(8)]

    rows = [(k * 7 % 997, vector(), None if k % 3 == 0 else k % 5) for k in range(500)]
    assert run(spark, rows, entries=entries) == brute(rows, entries)


def test_trie_against_all_distances():
    rng = np.random.default_rng(3)
    for m, d, high, kind in [(1, 3, 5, None), (500, 4, 3, None), (5000, 5, 4, None), (3000, 16, 2, None), (300, 6, 10**8, np.int64),
                             (200, 4, 2**61, object), (4, 1, 9, None)]:
        x = rng.integers(-high, high, (m, d))
        rows, n, place = V.distinct(x)
        e = rng.integers(-high, high, (7, d)).astype(object)
        e[3] = e[5]  # a tie
        assert kind is None or V._kind(rows, e) is kind
        code, far = V.nearest(rows, e)
        dist = ((rows.astype(object)[:, None, :] - e[None]) ** 2).sum(axis=2)
        want = [min(zip(r, range(7))) for r in dist.tolist()]
        assert list(zip(far.tolist(), code.tolist())) == want
        assert (rows[place] == x).all() and n.sum() == m and rows.tolist() == sorted(map(list, set(map(tuple, x.tolist()))))
    assert [len(a) for a in V.nearest(np.zeros((0, 4), np.int64), np.zeros((2, 4), object))] == [0, 0]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 2.0, 3.0, 4.0], 1), (5, [1.0, 2.0, 3.0, 3.5], None), (None, [0.5] * 4, None), (1, None, 1), (2, [None, 1.0], 1),
            (3, [nan, 1.0], 2), (4, [inf], 2), (6, [], 2), (7, [0.25, -0.25], 9), (7, [0.25, -0.25], 9), (8, [-1e-4] * 9, 1)]
    assert run(spark, rows, entries=3) == brute(rows, 3)
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == run(spark, [(1, None, 1), (2, [nan], 1)]) == ([], None)
    assert run(spark, [(1, [], 1), (2, [], None)]) == brute([(1, [], 1), (2, [], None)])
    huge = [(k, [3e38, -3e38, 1e19 * k, 0.5], 1) for k in range(4)] + [(9, [-3e38] * 4, 1)]
    assert run(spark, huge, entries=2) == brute(huge, 2)


def test_hot_labels_and_many_labels(spark):
    rows = [(k, [k / 7, -k / 3, 0.5, float(k % 4)], None if k % 2 else k) for k in range(300)]
    assert run(spark, rows, entries=7, rounds=1) == brute(rows, 7, 1)
