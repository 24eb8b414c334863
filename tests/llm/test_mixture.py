import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from llm_cases import frame  # noqa: F401

from classlake.llm import mixture as M

WEIGHTS = {"domain": {"web": 4, "books": 2, "other": 1}, "lang": {"en": 3, "xx": 0}, "source": {"s1": 2}}


def fill(children, budget):
    """Shares of (name, weight, capacity) by raising the level until the budget is used."""
    given, open_ = {}, [c for c in children if c[1] > 0 and c[2] > 0]
    while open_:
        level = Fraction(budget - sum(given.values()), sum(w for _, w, _ in open_))
        dry = [c for c in open_ if c[2] <= level * c[1]]
        if not dry:
            given.update({n: int(level * w) for n, w, _ in open_})
            break
        given.update({n: cap for n, _, cap in dry})
        open_ = [c for c in open_ if c not in dry]
    return given


def brute(rows, share, epochs):
    leaves, tokens = defaultdict(int), []
    for i, t, lang, source, domain in rows:
        n = len([x for x in (t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x])
        key = (domain or "none", lang or "none", source or "none")
        if n:
            leaves[key] += n
            tokens.append((i, key, n))
    weight = lambda level, n: WEIGHTS[level].get(n, WEIGHTS[level].get("other", 1))

    def split(prefix, budget):
        depth = len(prefix)
        if depth == 3:
            return {prefix: budget}
        sums = defaultdict(int)
        for k, n in leaves.items():
            if k[:depth] == prefix:
                sums[k[depth]] += n * epochs
        out = {}
        for name, b in fill([(n, weight(M.LEVELS[depth], n), c) for n, c in sums.items()], budget).items():
            out.update(split((*prefix, name), b))
        return out

    given = split((), int(sum(leaves.values()) * share))
    out = []
    for key, budget in given.items():
        full, left = divmod(budget, leaves[key])
        own = sorted((hashlib.md5(f"{M.SEED}:{full}:{'' if i is None else i}".encode()).hexdigest(), n, i)
                     for i, k, n in tokens if k == key) if all(i is not None for i, _, _ in tokens) else []
        total = 0
        for _, n, i in own:
            total += n
            times = full + (total <= left)
            if times:
                out.append((i, *key, n, times))
    return sorted(out), given, leaves


@pytest.mark.parametrize("share,epochs", [(0.5, 2), (0.05, 1), (3.0, 2), (1.3, 4)])
def test_against_brute_force(frame, share, epochs, monkeypatch):
    rng = random.Random(11)
    rows = []
    for k in range(500):
        d = rng.choices(["web", "books", "code", None], [6, 2, 1, 1])[0]
        rows.append((k, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(30))) or None,
                     rng.choice(["en", "de", "xx", None]), rng.choice(["s1", "s2", "s3", None]), d))
    monkeypatch.setattr(M, "DIGITS", 1)
    domain = F.create_map(*[F.lit(x) for r in rows for x in (r[0], r[4])])[F.col("doc_id")]
    want, given, leaves = brute(rows, share, epochs)
    got = M.choose(frame([r[:4] for r in rows]), domain, WEIGHTS, share, epochs).collect()
    assert sorted(tuple(r) for r in got) == want
    spent = defaultdict(int)
    for r in got:
        spent[r.domain, r.lang, r.source] += r.n_tokens * r.times
    assert all(n <= given[k] <= leaves[k] * epochs for k, n in spent.items())
    monkeypatch.setattr(M, "SMALL", 0)  # leaves that are not broadcast
    assert sorted(tuple(r) for r in M.choose(frame([r[:4] for r in rows]), domain, WEIGHTS, share, epochs).collect()) == want


def test_shortage_stays_within_the_parent(frame):
    rows = [(k, "a b c d e f g h i j", "en" if k < 30 else "de", "s1" if k % 10 else "s2") for k in range(60)]
    domain = F.when(F.col("doc_id") < 40, "web").otherwise("books")
    got = M.mix(frame(rows), domain, {}, 0.5, 1)
    assert got.select("row.*").columns == frame(rows).columns
    by = {tuple(r)[:2]: r.n for r in got.groupBy("domain", "lang").agg(F.sum("n_tokens").alias("n")).collect()}
    # 300 tokens: 150 for each domain, web's 150 as 75 and 75, in whole texts of 10
    assert by[("books", "de")] in range(130, 151) and by[("web", "en")] in range(60, 76) and by[("web", "de")] in range(60, 76)


def test_repeated_rows_nulls_and_no_rows(frame):
    rows = [(1, "a b"), (1, "a b"), (None, "a b"), (2, None), (3, ""), (4, " \n")]
    got = M.choose(frame(rows), F.lit("d"), {}, 1.0, 1).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.times) for r in got) == [(0, 2, 1), (1, 2, 1), (1, 2, 1)]
    assert M.choose(frame([]), F.lit("d"), {}, 1.0, 1).collect() == []


def test_no_python_on_rows(frame):
    plan = M.choose(frame([(1, "a")]), F.lit("d"), {}, 0.5)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
