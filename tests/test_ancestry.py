"""Nested classes and override ancestry against plain loops."""

import random

from classlake import iterate
from classlake.operators import hierarchy as H
from classlake.operators import members as M
from conftest import rows


def nest(claims, roots):
    """One class after the other, from the roots."""
    parent = {}
    for inner, encloser, recorded, ord_, *rest in sorted(claims, key=lambda c: (c[3], c[1])):
        if inner != encloser and encloser == recorded and inner not in parent and inner not in roots:
            parent[inner] = (encloser, *rest)
    out, todo = [], [(r, r, None, 0, "root", f, f & 0x1002 | 8) for r, f in roots.items()]
    while todo:
        row = todo.pop()
        out.append(row)
        root, node, _, depth, _, _, context = row
        for inner, (encloser, kind, flags, shape, named, outer) in parent.items():
            if encloser != node:
                continue
            kind = "local" if kind == "anonymous" and not shape else kind
            if kind == "anonymous" and named:
                kind = "member" if outer else "local"
                flags = flags | 8 if outer else flags
            flags = flags & ~8 if kind == "anonymous" else flags & 0x410 if kind == "local" else flags
            seen = context if kind != "member" else context | 8 if flags & 8 else context & ~8
            todo.append((root, inner, encloser, depth + 1, kind, flags, seen | flags & 0x1002))
    return sorted(out)


def test_nested_classes(spark):
    rng = random.Random(4)
    roots = {0: 0x1011, 1: 2, 2: 0}
    claims = []
    for n in range(3, 60):
        near = [rng.randrange(max(0, n - 6), n) for _ in range(2)]
        claims += [(n, e, rng.choice(near), k, rng.choice(["member", "local", "anonymous"]), rng.randrange(1 << 13),
                    rng.random() < 0.7, rng.random() < 0.4, rng.random() < 0.5) for k, e in enumerate(near)]
    more = ("member", 1, True, False, False)
    claims += [(70, 71, 71, 0, *more), (71, 70, 70, 0, *more), (72, 71, 71, 0, *more), (73, 99, 99, 0, *more), (2, 1, 1, 0, *more), (80, 80, 80, 0, *more)]
    claims += [(100 + k, 100 + k - 1 if k else 0, 100 + k - 1 if k else 0, 0, "member", 8 if k % 9 == 0 else 0, True, False, False) for k in range(40)]
    c = spark.createDataFrame(claims, "inner long, encloser long, recorded long, ord int, kind string, flags long, anonymous_shape boolean, named boolean, outer_named boolean")
    r = spark.createDataFrame(list(roots.items()), "node long, flags long")
    got = rows(H.nested_classes(c, r), "root", "node", "parent", "depth", "kind", "flags", "context")
    want = nest(claims, roots)
    assert sorted(got, key=lambda x: (x[0], x[1])) == sorted(want, key=lambda x: (x[0], x[1])) and max(x[3] for x in got) == 40
    assert not {70, 71, 72, 73, 80} & {x[1] for x in got}
    assert rows(H.nested_classes(c.limit(0), r), "node", "kind") == [(k, "root") for k in roots]


def test_values_merge_on_arrival(spark):
    """Greatest value that reaches a node, round a cycle too; bits are gathered likewise."""
    from pyspark.sql import functions as F

    arcs = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (4, 3), (5, 5)], "src long, dst long")
    seed = spark.createDataFrame([(0, 1), (1, 4), (3, 2), (4, 8), (5, 1)], "node long, v long")
    step = lambda f: f.join(arcs, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "v")
    assert rows(iterate.merged(seed, step, ["node"], "v"), "node", "v") == [(0, 4), (1, 4), (2, 4), (3, 8), (4, 8), (5, 1)]
    assert rows(iterate.merged(seed, step, ["node"], "v", F.bit_or), "node", "v") == [(0, 5), (1, 5), (2, 5), (3, 15), (4, 8), (5, 1)]
    assert rows(iterate.merged(seed.limit(0), step, ["node"], "v"), "node") == []


def test_unknown_ancestors(spark):
    # 1 -> 10 (super), 20 (interface); 10 -> 11? unknown; 20 -> 21? unknown, 22; 22 -> 11?; 2 knows all; 3 -> 20 as interface
    parents = [(1, 10, 0), (1, 20, 1), (10, 11, 0), (20, 21, 0), (20, 22, 1), (22, 11, 0), (2, 30, 0), (3, 30, 0), (3, 20, 1), (11, 40, 0)]
    known = [1, 2, 3, 10, 20, 22, 30, 40]
    m = lambda c, name="f", ret="V", able=True, seen=True, package=0: (c, name, "()", ret, able, seen, package)
    methods = [m(1), m(1, "g"), m(2), m(3, "h"), m(10), m(22, seen=False, package=9), m(30, "f", "W"), m(40), m(20, able=False), m(11), m(30, "h", seen=False)]
    p = spark.createDataFrame(parents, "node long, parent long, pos int")
    k = spark.createDataFrame([(x,) for x in known], "node long")
    ms = spark.createDataFrame(methods, "class long, name string, params string, ret string, overridable boolean, visible boolean, package int")
    returns = spark.createDataFrame([("V", "W")], "child string, parent string")
    assert rows(M.hierarchy_gaps(p, k), "node", "gap") == [(1, 2), (2, 0), (3, 1), (10, 2), (20, 2), (22, 2), (30, 0), (40, 0)]
    got = rows(M.override_ancestry(ms, p, k, returns), "class", "name", "pos", "sup", "sup_ret", "resolved", "gap")
    assert [r for r in got if r[0] == 1] == [
        (1, "f", 1, 10, "V", True, 2), (1, "f", 2, 11, None, False, 2), (1, "f", 3, 21, None, False, 2),
        (1, "g", 1, 11, None, False, 2), (1, "g", 2, 21, None, False, 2)]
    assert [r for r in got if r[0] == 2] == [(2, "f", 1, 30, "W", True, 0)]
    assert [r for r in got if r[0] == 3] == [(3, "h", 1, 30, "V", True, 1), (3, "h", 2, 21, None, False, 1), (3, "h", 3, 11, None, False, 1)]
    assert [r for r in got if r[0] in (30, 40)] == [(30, "f", None, None, None, None, 0), (30, "h", None, None, None, None, 0), (40, "f", None, None, None, None, 0)]
    assert not [r for r in got if r[0] == 11]
