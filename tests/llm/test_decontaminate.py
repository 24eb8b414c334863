import random

import pytest
from llm_cases import frame, words  # noqa: F401

from classlake.llm import decontaminate as D


def brute(rows, items, window=13, share=20):
    parts = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            parts.setdefault(tuple(w[s:s + window]), set()).add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w = words(t)
        hit, names = set(), set()
        for n in {len(p) for p in parts}:
            for s in range(len(w) - n + 1):
                found = parts.get(tuple(w[s:s + n]))
                if found:
                    names |= found
                    hit |= set(range(s, s + n))
        out.append((i, len(w), len(hit), sorted(names), len(hit) > 0 and share * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.fixture
def bench(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, "x") for r in rows], "item_id long, text string, n_words long, hits string")


def cases():
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(8)] + ["É", "ñ9"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 5, 12, 13, 14, 30]) if k < 3 else rng.choice([13, 20, 40]))) for k in range(12)]
    items += [(90, None), (91, ""), (92, "..."), (None, items[5][1]), (5, items[5][1]), (93, items[6][1].upper())]
    rows = []
    for k in range(80):
        _, t = rng.choice(items)
        cut = (t or "").split()
        a = rng.randrange(len(cut) + 1)
        rows.append((k, f"{text(rng.randrange(40))} {' , '.join(cut[a:a + rng.randrange(30)])}; {text(rng.randrange(9))}"))
    rows += [(100, None), (101, ""), (102, "-"), (None, items[7][1]), (103, items[7][1] + " " + text(400)), (103, items[8][1]),
             (104, (items[9][1] + "\n") * 300)]
    return rows, items


@pytest.mark.parametrize("block", [32 << 20, 300])
def test_against_brute_force(frame, bench, block, monkeypatch):
    monkeypatch.setattr(D, "SHARD_BYTES", 2000)
    rows, items = cases()
    for part in (items, items[3:12]):
        df = D.contamination(frame(rows), bench(part), block_bytes=block)
        got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in df.collect()), key=str)
        assert got == brute(rows, part)
    kept = D.remove_contaminated(frame(rows), bench(items), block_bytes=block)
    assert kept.columns == frame(rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((x[0] for x in brute(rows, items) if not x[4]), key=str)


def test_empty_tables(frame, bench):
    assert D.contamination(frame([]), bench([(1, "a b")])).collect() == []
    for none in ([], [(1, None), (2, "!")]):
        got = D.contamination(frame([(1, "a b a"), (2, None)]), bench(none)).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got) == [(1, 3, 0, False), (2, 0, 0, False)]
    assert D.longest_matches(frame([(1, "a")]), bench([])).collect() == []


def test_longest_matches(frame, bench):
    item = " ".join(f"v{k}" for k in range(30))
    rows = [(3, "x " + " ".join(item.split()[:20]) + " y"), (2, " ".join(item.split()[2:22]) + " v7"), (9, "a " + item), (8, item)]
    got = {(r.item_id, r.item_word): (r.n_words, r.doc_id, r.doc_word) for r in D.longest_matches(frame(rows), bench([(7, item)])).collect()}
    assert got[("7", 0)] == (30, 8, 0) and got[("7", 5)] == (25, 8, 5) and len(got) == 18
    got = {r.item_word: (r.n_words, r.doc_id, r.doc_word) for r in D.longest_matches(frame(rows[:2]), bench([(7, item)])).collect()}
    assert got[0] == (20, 3, 1) and got[2] == (20, 2, 0) and 10 not in got
