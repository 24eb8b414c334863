import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from llm_cases import documents, frame, words  # noqa: F401

from classlake.llm import minhash_forest as M


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """(doc_id, class_id, n_links) of rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    links, parent = Counter(), {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
            links[a] += 1
            links[b] += 1
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return sorted((i, top(i), links[i]) for i in sets)


def near(rng, n, size):
    base = [f"w{rng.randrange(500)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(size)] = f"x{rng.randrange(50)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("square", [4096, 5])
def test_against_brute_force(frame, documents, square):
    rng = random.Random(4)
    rows = [(r[0], r[1]) for r in documents]
    texts = near(rng, 25, 90) + near(rng, 12, 300) + near(rng, 3, 40)
    rows += [(10_000 + 3 * k, t) for k, t in enumerate(texts)] + [(20_000 + k, t.upper()) for k, t in enumerate(texts[:6])]
    rows += [(30_000, None), (30_001, ""), (30_002, "a b"), (30_003, "A, b."), (30_004, "..."), (30_005, "a b c")]
    got = M.similar_classes(frame(rows), square=square).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute(rows)
    if square == 5:
        return
    kept = M.keep_one_each(frame(rows))
    assert kept.columns == frame(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in brute(rows)})


def test_nulls_and_repeated_rows(frame):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long), (1, long), (1, "other words of the same id here"), (5, long + " tail"), (None, long), (None, "x y z q v u")]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in M.similar_classes(frame(rows)).collect()), key=str)
    assert got == sorted([(1, 1, 3), (1, 1, 3), (1, 1, 0), (5, 1, 3), (None, 1, 3), (None, None, 0)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in M.keep_one_each(frame(rows)).collect()), key=str)
    assert kept == sorted([(1, long), (1, "other words of the same id here"), (None, "x y z q v u")], key=str)
    assert M.similar_classes(frame([])).collect() == [] and M.keep_one_each(frame([])).collect() == []


def test_intersections():
    rng = np.random.default_rng(3)
    for n, m, top in ((1, 1, 5), (40, 30, 60), (300, 200, 4000)):
        a, b = ([np.unique(rng.integers(0, top, rng.integers(1, 80))).astype(np.uint64) for _ in range(k)] for k in (n, m))
        want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
        assert M.intersections(a, b).astype(int).tolist() == want


def test_depth_and_recall():
    depth = M.prefix_depth(0.8, M.TARGET)
    assert 1 - (1 - 0.8**depth) ** M.TREES >= M.TARGET > 1 - (1 - 0.8 ** (depth + 1)) ** M.TREES
    rng = np.random.default_rng(0)
    hits = 0
    for k in range(200):  # pairs right at the threshold
        both = rng.integers(0, 2**44, 400, dtype=np.uint64)
        a, b = np.concatenate([both, rng.integers(0, 2**44, 50, dtype=np.uint64)]), np.concatenate(
            [both, rng.integers(0, 2**44, 50, dtype=np.uint64)])
        la, lb = (M.labels(np.sort(x), np.array([0, len(x)]))[0] >> np.uint64(8 * (M.DEEPEST - depth)) for x in (a, b))
        hits += bool((la == lb).any())
    assert hits >= 194
