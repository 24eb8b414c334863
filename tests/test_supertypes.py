"""Ordered supertypes, the search along them and class pairs, against plain loops."""

from classlake.operators import hierarchy as H
from classlake.operators import members as M
from conftest import rows


def paths_from(up, node):
    """Every path of ordinals upward: (path, supertype)."""
    out, todo = [], [((), node)]
    while todo:
        path, n = todo.pop()
        out.append((path, n))
        todo += [((*path, pos), p) for pos, p in up.get(n, [])]
    return out


def visit(up, node, breadth_first):
    order = sorted(paths_from(up, node), key=lambda x: (len(x[0]) if breadth_first else 0, x[0]))
    return list(dict.fromkeys(n for _, n in order))


def hierarchy(spark, rng, size=40):
    arcs = [(n, p, pos) for n in range(1, size) for pos, p in enumerate(rng.sample(range(max(0, n - 9), n), min(n, rng.randrange(4))))]
    up = {}
    for n, p, pos in arcs:
        up.setdefault(n, []).append((pos, p))
    df = spark.createDataFrame(arcs + arcs[:5], "node long, parent long, pos int")
    return up, df, spark.createDataFrame([(n,) for n in range(size)], "node long")


def test_places_in_visit_order(spark, rng):
    up, arcs, nodes = hierarchy(spark, rng)
    for breadth_first in (False, True):
        got = rows(H.ranked_closure(arcs, nodes, breadth_first), "node", "rank", "anc")
        assert got == [(n, i, a) for n in range(40) for i, a in enumerate(visit(up, n, breadth_first))]
    some = nodes.filter("node = 39")
    assert {n for n, _ in rows(H.ranked_closure(arcs, some), "node", "anc")} == {39}
    assert rows(H.ranked_closure(arcs, nodes.limit(0)), "node") == []


def test_places_on_a_cycle(spark):
    p = spark.createDataFrame([("A", "B", 0), ("B", "C", 0), ("C", "A", 0), ("A", "I", 1)], "node string, parent string, pos int")
    start = spark.createDataFrame([("A",), ("I",)], "node string")
    assert rows(H.ranked_closure(p, start), "node", "rank", "anc") == [("A", 0, "A"), ("A", 1, "B"), ("A", 2, "C"), ("A", 3, "I"), ("I", 0, "I")]
    wide = H.ranked_closure(p, start, breadth_first=True).filter("node = 'A'")
    assert rows(wide, "rank", "anc") == [(0, "A"), (1, "B"), (2, "I"), (3, "C")]


def test_first_common_supertype(spark, rng):
    up, arcs, nodes = hierarchy(spark, rng)
    seen = {n: visit(up, n, False) for n in range(40)}
    asked = [(rng.randrange(40), rng.randrange(44)) for _ in range(80)] + [(0, 0), (None, 3)]
    got = rows(H.common_ancestor(spark.createDataFrame(asked, "a long, b long"), H.ranked_closure(arcs, nodes), 0), "a", "b", "common")
    want = [(a, b, next((x for x in seen.get(a, []) if x in seen.get(b, []) and (x != 0 or a == 0)), None)) for a, b in asked]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_answered_keys_leave_the_search(spark):
    """Only what the first places leave open meets the later ones."""
    chain = spark.createDataFrame([("n", f"a{k:02}", k) for k in range(12)] + [("m", "m", 0)], "node string, anc string, rank int")
    keys = spark.createDataFrame([("n", "near"), ("n", "far"), ("n", "none"), ("m", "far")], "owner string, name string")
    holds = spark.createDataFrame([("a00", "near"), ("a09", "far"), ("a11", "far")], "anc string, name string")
    met = []

    def look(wanted, places):
        met.append((rows(wanted, "owner", "name"), rows(places, "rank")[-1][0]))
        return (wanted.join(places.withColumnRenamed("node", "owner"), "owner").join(holds, ["anc", "name"])
                .groupBy("owner", "name").agg({"anc": "min"}).withColumnRenamed("min(anc)", "found"))

    assert rows(M.in_slices(keys, chain, look, ["owner", "name"]), "name", "found") == [("far", "a09"), ("near", "a00")]
    assert [top for _, top in met] == [0, 2, 6, 11] and all(w == [("n", "far"), ("n", "none")] for w, _ in met[1:])


def test_inherited_by_an_own_class(spark, rng):
    """Class and interface methods that one own class sees, with more rows than pairs of classes."""
    up, arcs, nodes = hierarchy(spark, rng, 24)
    seen = {n: set(visit(up, n, False)) for n in range(24)}
    methods = [(n, f"m{k}", "()", rng.choice("VW"), rng.random() < 0.8, rng.random() < 0.3, rng.random() < 0.5, n % 3 == 0)
               for n in range(24) for k in range(3) if rng.random() < 0.6]
    ms = spark.createDataFrame(methods, "class long, name string, params string, ret string, overridable boolean, final boolean, public boolean, in_iface boolean")
    own = spark.createDataFrame([(n,) for n in range(24) if n % 3 and n % 4], "node long")
    fits = lambda a, b: a == b or (a, b) == ("V", "W")
    want = set()
    for c, name, _, ret, able, final, public, iface in methods:
        for s, sname, _, sret, sable, *_, siface in methods:
            if able and sable and not iface and siface and name == sname and s not in seen[c] and c not in seen[s] \
                    and any(c in seen[n] and s in seen[n] for n in range(24) if n % 3 and n % 4) \
                    and ((public and fits(ret, sret)) or (not final and (fits(ret, sret) or fits(sret, ret)))):
                want.add((c, name, ret, s, sret))
    returns = spark.createDataFrame([("V", "W")], "child string, parent string")
    got = rows(M.inherited_implementations(ms.unionByName(ms.limit(9)), H.closure(arcs, nodes), returns, own), "class", "name", "ret", "sup", "sup_ret")
    assert want and got == sorted(want)
