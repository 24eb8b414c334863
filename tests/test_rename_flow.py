"""Names that flow down the hierarchy, and field names, against plain loops."""

import random
import re

import pytest

from classlake.iterate import wavefront
from classlake.operators import hierarchy as H
from classlake.operators import rename as R
from conftest import rows

KEYS = ["class", "name", "params", "ret"]


def flow(methods, parents):
    """Class by class from the top, one method after the other."""
    up = {}
    for node, parent, pos in sorted(parents, key=lambda r: r[2]):
        up.setdefault(node, []).append(parent)
    classes = sorted({m[0] for m in methods} | {n for p in parents for n in p[:2]})
    handed, out = {}, []

    def visit(c):
        if c in handed:
            return handed[c]
        seen = {}
        for p in up.get(c, []):
            seen.update(visit(p))
        mine = [m for m in methods if m[0] == c]

        def first(m):
            _, name, params, ret, proposed, fixed, overridable, ord_ = m
            if fixed:
                return 0, name
            if overridable and (name, params, ret) in seen:
                return 1, seen[name, params, ret]
            return 2, proposed

        want = {m: first(m) for m in mine}
        above = {(n, key[1]) for key, n in seen.items()}
        order = sorted(mine, key=lambda m: (want[m][0], m[7], m[1], m[3]))
        loses, used = [], set()
        for m in order:
            turn, name = want[m]
            if turn and ((name, m[2]) in used or (turn == 2 and (name, m[2]) in above)):
                loses.append(m)
            used.add((name, m[2]))
        final = {m: (want[m][1], "inherited" if want[m][0] == 1 else "kept") for m in mine if m not in loses}
        taken = above | used
        for m in loses:
            k = 1
            while (f"{want[m][1]}_{k}", m[2]) in taken:
                k += 1
            final[m] = f"{want[m][1]}_{k}", "renamed"
            taken = taken | {(final[m][0], m[2])}
        out.extend((*m[:4], *final[m]) for m in mine)
        handed[c] = seen | {m[1:4]: final[m][0] for m in mine if m[6]}
        return handed[c]

    for c in classes:
        visit(c)
    return sorted(out)


def made(seed, n=14):
    rng = random.Random(seed)
    parents = [(k, rng.randrange(max(0, k - 5), k), 0) for k in range(1, n)]
    parents += [(k, q, 1) for k in range(3, n) if rng.random() < 0.5 for q in [rng.randrange(k)] if (k, q, 0) not in parents]
    methods, used = [], set()
    for c in range(n):
        for _ in range(rng.randint(0, 7)):
            key = c, rng.choice(["a", "b", "a_1", "a_2", "b_1"]), rng.choice(["()", "(I)"]), rng.choice("VIJ")
            if key not in used:
                used.add(key)
                methods.append((*key, rng.choice([key[1], "a", "c", "a_1"]), rng.random() < 0.2, rng.random() < 0.8, rng.randrange(9)))
    return methods, parents


@pytest.mark.parametrize("seed", range(2))
def test_names_flow_down(spark, seed):
    methods, parents = made(seed)
    m = spark.createDataFrame(methods, "class long, name string, params string, ret string, proposed string, fixed boolean, overridable boolean, ord long")
    p = spark.createDataFrame(parents, "node long, parent long, pos int")
    nodes = spark.createDataFrame([(k,) for k in range(14)], "node long")
    out = R.flowing_names(m, p, H.inheritance_levels(p, nodes))
    got = rows(out, *KEYS, "new_name", "how")
    assert got == flow(methods, parents) and {r[5] for r in got} == {"kept", "inherited", "renamed"}
    fixed = {r[:4] for r in methods if r[5]}
    spots = [(r[0], r[4], r[2]) for r in got if r[:4] not in fixed]
    assert len(set(spots)) == len(spots)


def test_no_classes(spark):
    m = spark.createDataFrame([], "class long, name string, params string, ret string, proposed string, fixed boolean, overridable boolean, ord long")
    p = spark.createDataFrame([], "node long, parent long, pos int")
    levels = spark.createDataFrame([], "node long, level long")
    assert R.flowing_names(m, p, levels).collect() == []


def test_wavefront_sums(spark):
    """Number of ways from the roots, each row sent once."""
    edges = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (0, 4), (5, 4)]
    e = spark.createDataFrame(edges, "src long, dst long")
    level = spark.createDataFrame([(0, 0), (5, 0), (1, 1), (2, 1), (3, 2), (4, 3)], "node long, level long")

    def step(k, sent):
        roots = level.filter(f"level = {k} and {k} = 0").selectExpr("node", "1L as ways")
        done = sent.groupBy("node").agg({"ways": "sum"}).toDF("node", "ways").unionByName(roots)
        to = level.selectExpr("node as dst", "level")
        return done, done.join(e, done["node"] == e["src"]).join(to, "dst").selectExpr("dst as node", "ways", "level")

    assert rows(wavefront(level, step, "node long, ways long, level long"), "node", "ways") == [
        (0, 1), (1, 1), (2, 1), (3, 2), (4, 4), (5, 1)]


def test_fields_give_way(spark):
    # 0 <- 1 <- 2, interface 3 above 2; classes 0 and 3 are library
    closure = spark.createDataFrame(
        [(0, 0, 0), (1, 1, 0), (1, 0, 1), (2, 2, 0), (2, 1, 1), (2, 0, 2), (2, 3, 3), (3, 3, 0)], "node long, anc long, rank int")
    fields = [(0, "f", 5, False, False), (1, "f", 1, False, True), (2, "f", 2, False, True), (2, "f_1", 9, False, True),
              (3, "g", 3, True, False), (2, "g", 4, False, True), (1, "x", 7, False, True)]
    f = spark.createDataFrame(fields, "class long, name string, ord long, in_iface boolean, own boolean")
    got = {r[:2]: r[2] for r in rows(R.rename_fields(f, closure), "class", "name", "new_name")}
    # class 2 sees f of 2, 1 and 0 and keeps its own; f of class 1 keeps its place in class 1 but gives way in class 2
    assert got[2, "f"] == "f" and got[0, "f"] == "f" and got[3, "g"] == got[2, "g"] == "g" and got[1, "x"] == "x"
    assert re.fullmatch(r"f(_\d+)+", got[1, "f"]) and len({got[1, "f"], got[2, "f"], got[2, "f_1"]}) == 3
