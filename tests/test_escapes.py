import random

from conftest import rows

from classlake.operators import effects as E


def test_caught_types_are_not_spelled_out_for_each_site(spark, monkeypatch):
    sizes = []
    old = E.cut

    def write(df):
        written = old(df)
        sizes.append(written.count())
        return written

    monkeypatch.setattr(E, "cut", write)
    below = [f"X{i}" for i in range(1, 9)]
    closed = spark.createDataFrame([(e, a) for e in below for a in (e, "X0")] + [("X0", "X0")], "node string, anc string")
    calls = spark.createDataFrame([(f"s{i}", i, 100) for i in range(40)], "site string, src int, dst int")
    catches = spark.createDataFrame([(f"s{i}", "X0") for i in range(1, 40)], "site string, exc string")
    raised = spark.createDataFrame([(100, e) for e in below], "node int, exc string")
    got = rows(E.propagate(raised, calls, catches, closed), "node", "exc")
    assert got == [(0, e) for e in below] + [(100, e) for e in below]
    assert max(sizes) <= 40


def test_rules_of_methods_against_brute_force(spark):
    rng = random.Random(5)
    up = {"X0": {"X0"}, "X1": {"X1", "X0"}, "X2": {"X2", "X1", "X0"}, "X3": {"X3", "X0"}}
    types = [*up, "Y"]  # nobody knows Y
    methods = range(9)
    raised = {(rng.choice(methods), rng.choice(types)) for _ in range(9)}
    calls = [(f"s{i % 11}", rng.choice(methods), rng.choice(methods)) for i in range(16)]
    catches = [(f"s{rng.randrange(11)}", rng.choice([*up, None])) for _ in range(5)]
    declared = {(rng.choice(methods), rng.choice(types)) for _ in range(2)}
    limits = [(1, 0, "X0"), (1, 1, "X1"), (1, 1, "X3"), (2, 0, None), (3, None, "X1"), (None, 0, "X1")]
    silent = [(7,), (None,)]

    def admitted(n, e):
        above = up.get(e, set())
        if n == 7 or any(m == n and d in above for m, d in declared):
            return False
        mine = [(d, t) for m, d, t in limits if m == n]
        fits = [d for d, t in mine if t in above]
        return not mine or bool(fits) and {d for d in fits if d is not None} == {d for d, _ in mine if d is not None}

    state = {(n, e) for n, e in raised if admitted(n, e)} | declared
    while True:
        new = {(a, e) for s, a, b in calls for n, e in state if n == b and admitted(a, e)
               and not any(t == s and c in up.get(e, set()) for t, c in catches)} - state
        if not new:
            break
        state |= new
    frame = lambda r, schema: spark.createDataFrame([tuple(x) for x in r], schema)
    got = E.propagate(
        frame(raised, "node int, exc string"), frame(calls, "site string, src int, dst int"), frame(catches, "site string, exc string"),
        frame([(e, a) for e, s in up.items() for a in s], "node string, anc string"), frame(declared, "node int, exc string"),
        frame(limits, "node int, decl int, exc string"), frame(silent, "node int"))
    assert set(rows(got, "node", "exc")) == state - declared
