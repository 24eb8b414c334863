import random
import re
from collections import Counter

import pytest
from llm_cases import LOWER, documents, frame  # noqa: F401

from classlake.llm import collocation as C


def phrases(rows, longest=4):
    """Counts of all phrases by language and length, from the definition."""
    counts = {}
    for _, text, lang, *_ in rows:
        f = counts.setdefault("und" if lang is None else lang, [Counter() for _ in range(longest + 1)])
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f[k].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return counts


def brute(rows, top=2000, least=30, longest=4):
    out = []
    for lang, f in phrases(rows, longest).items():
        count = Counter()
        for c in f:
            count.update(c)
        n = f[1].total()
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        drop = {q[i:j] for q, a in cand.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1)
                if j - i < len(q) and 100 * a >= 80 * cand[q[i:j]]}
        rows_ = []
        for p, a in cand.items():
            if p not in drop:
                score, cut = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((-score, -a, " ".join(p).encode(), count[p[:cut]], count[p[cut:]], cut))
        for rank, (s, a, p, l, r, cut) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s, cut))
    return sorted(out)


def run(docs, **options):
    return sorted(tuple(r) for r in C.collocations(docs, **options).collect())


def made(seed, n, vocabulary, langs=("en", "de", None)):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)] + ["Zürich", "É", "O'k", "#", "😀"]
    seps = [" "] * 12 + ["  ", "\t", " \t ", ". ", ",", "\n", "!?", "\x0b", " - ", "\x1c"]
    fixed = ["new york city hall", "a b c d e", "x y", "to be or not to be"]

    def text():
        return "".join((rng.choice(fixed) if rng.random() < 0.15 else rng.choice(words[:rng.randint(1, len(words))]))
                       + rng.choice(seps) for _ in range(rng.randint(0, 60)))

    return [(k // 2, text() if rng.random() > 0.05 else None, rng.choice(langs)) for k in range(n)]


@pytest.mark.parametrize("seed,least,options", [
    (1, 5, {}), (2, 3, {"sample": 50, "sample_least": 3}), (3, 12, {"sample": 2, "sample_least": 1}),
    (4, 4, {"bits": 6}), (5, 5, {"top": 7})])
def test_against_definition(frame, seed, least, options):
    rows = made(seed, 300, 40)
    top = options.get("top", 2000)
    want = brute(rows, top, least)
    assert len(want) > 10 and run(frame(rows), least=least, **options) == want


def test_failures_of_the_border(frame, monkeypatch):
    """A sample that proposes nothing leaves all to the expansion passes, one for each length."""
    rows = made(6, 300, 30)
    passes = []
    real = C._failures
    monkeypatch.setattr(C, "_failures", lambda *a: passes.append(1) or real(*a))
    assert run(frame(rows), least=5, sample_least=10**6) == brute(rows, least=5) and len(passes) == 4


def test_small_blocks_and_tallies(frame, monkeypatch):
    rows = made(7, 60, 30)
    monkeypatch.setattr(C, "BLOCK_BYTES", 64)
    batch = C._read
    import pyarrow as pa

    def texts(rows):
        return pa.RecordBatch.from_pydict({
            "lang": [x or "und" for _, _, x in rows], "text": [(t or "") + "\n" for _, t, _ in rows]})

    names, found = batch(texts(rows))
    got = {n: [Counter() for _ in range(5)] for n in names}
    monkeypatch.setattr(C, "HELD", 80)
    tally, out = C.Tally(), []
    for words in found:
        for k, at, g in C.opened(words, C._seeds(names), None, None, 4):
            some, n = C._distinct(g, None)
            out += tally.add(g[:, some], pa.table({
                "lang": pa.array([names[x] for x in words.lang[at[some]]], pa.string()), "k": pa.array([k] * len(some), pa.int32()),
                "phrase": words.phrases(C.np.full(len(some), k), at[some]).cast(pa.string()), "n": n}))
    out += tally.let_go()
    assert all(t.num_rows <= 300 for t in out)
    for t in out:
        for r in t.to_pylist():
            got[r["lang"]][r["k"]][tuple(r["phrase"].split(" "))] += r["n"]
    assert len(out) > 3 and got == phrases(rows)


def test_tally_of_hashes(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(C, "HELD", 40)
    rng, tally, want, out = random.Random(3), C.Tally("g"), Counter(), []
    for _ in range(60):
        g = sorted(set(rng.choices(range(35 if rng.random() < 0.8 else 900), k=9)))
        want.update(g)
        out += tally.add(np.array([g], np.uint64), pa.table({"n": np.ones(len(g), np.int64)}))
    out += tally.let_go()
    got = Counter()
    for b in out:
        got.update(dict(zip(b["g"].to_pylist(), b["n"].to_pylist())))
    assert got == want and sum(b.num_rows for b in out) < want.total()


def test_two_phrases_under_one_hash():
    import numpy as np

    h = np.array([[7, 3, 7, 7, 3], [1, 1, 2, 1, 1]], np.uint64)
    at, n = C._distinct(h, None)
    assert sorted(zip(*h[:, at].tolist(), n.tolist())) == [(3, 1, 2), (7, 1, 2), (7, 2, 1)]
    at, n = C._distinct(h, np.array([5, 1, 1, 1, 1]))
    assert sorted(n.tolist()) == [1, 2, 6]


def test_odd_rows(frame):
    assert run(frame([])) == [] and run(frame([(1, None), (2, ""), (3, " \t.,")])) == []
    rows = [(None, "a b " * 40, None)] + [(k, "A B. c d", "en") for k in range(30)] + [(5, "long" * 30000 + " tail", "en")] * 31
    rows += [(9, "word " * 50000, "x")]
    assert run(frame(rows)) == brute(rows)
    assert run(frame([(k, "tie one tie two tie", "en") for k in range(30)])) == brute(
        [(k, "tie one tie two tie", "en") for k in range(30)])


def test_whole_table(spark, documents):
    from classlake.llm import queries as Q
    from llm_cases import SF

    got = sorted(tuple(r) for r in Q.QUERIES["op12_collocations"](spark, SF).collect())
    assert got == [r[:-1] for r in brute([r[:3] for r in documents])]
