"""What flows down the hierarchy against all pairs of a class and its supertypes."""

import random

from classlake.operators import hierarchy as H
from classlake.operators import members as M
from classlake.operators import rename as R
from conftest import rows

SIX = "class long, name string, params string, ret string, ord long, in_iface boolean, overridable boolean, final boolean, abstract boolean, public boolean, own boolean"


def hierarchy(spark, rng, n):
    """Classes with up to three parents, in any order of numbers."""
    ids = rng.sample(range(100, 200), n)
    arcs = []
    for k in range(1, n):
        for pos, p in enumerate(rng.sample(ids[:k], min(k, rng.choice([0, 1, 1, 2, 3])))):
            arcs.append((ids[k], p, pos))
    p = spark.createDataFrame(arcs, "node long, parent long, pos int")
    nodes = spark.createDataFrame([(i,) for i in ids], "node long")
    return ids, p, nodes, H.inheritance_levels(p, nodes)


def methods_of(spark, rng, ids):
    out = []
    for c in ids:
        for name in "ab":
            for ret in "FOX":
                if rng.random() < 0.4:
                    out.append((c, name, "()", ret, rng.randrange(9), c % 3 == 0, rng.random() < 0.8, rng.random() < 0.2,
                                rng.random() < 0.5, rng.random() < 0.5, c % 5 != 0))
    return spark.createDataFrame(out + out[:2], SIX)


def fits(spark):
    return spark.createDataFrame([("F", "O"), ("X", "F")], "child string, parent string")  # not transitive


def test_families_and_names(spark):
    rng = random.Random(1)
    ids, p, nodes, levels = hierarchy(spark, rng, 10)
    m, closed, returns = methods_of(spark, rng, ids), H.closure(p, nodes), fits(spark)
    own = nodes.filter("node % 3 <> 0 and node % 5 <> 0")
    also = M.inherited_implementations(m, closed, returns, own)
    want = M.families(m, M.override_pairs(m, closed, returns).unionByName(also))
    fam = M.flowing_families(m, p, levels, returns, also)
    assert rows(fam, *fam.columns) == rows(want, *want.columns)

    ranks = R.keeper_ranks(fam, m)
    rendered = fam.withColumn("new_name", fam["name"]).localCheckpoint()
    pairs, flow = R.visible_conflicts(rendered, closed, ranks), R.visible_conflicts(rendered, None, ranks, (p, levels))
    assert rows(flow, *flow.columns) == rows(pairs, *flow.columns) != []

    mapping = spark.createDataFrame(
        [(c, n, "()", rng.choice(["a", "b", "a_1", "c"])) for c in ids for n in "ab" if rng.random() < 0.5],
        "owner long, name string, params string, target string")
    out = R.rename_members(m, rendered.drop("new_name"), None, mapping, (p, levels))
    assert rows(out, *out.columns) == rows(R.rename_members(m, rendered.drop("new_name"), closed, mapping), *out.columns)


def test_fields(spark):
    rng = random.Random(2)
    ids, p, nodes, levels = hierarchy(spark, rng, 10)
    f = spark.createDataFrame(
        [(c, n, rng.randrange(9), c % 3 == 0, c % 5 != 0) for c in ids for n in ("f", "g", "f_1", "f_1_1") if rng.random() < 0.5],
        "class long, name string, ord long, in_iface boolean, own boolean")
    want = R.rename_fields(f, H.ranked_closure(p, nodes))
    got = R.rename_fields(f, None, (p, levels))
    assert rows(got, *got.columns) == rows(want, *got.columns)


def test_queries_take_the_descent(spark, monkeypatch):
    """The registered queries neither list override pairs nor spread members over all supertypes."""
    from types import SimpleNamespace

    from classlake.plans import member_queries, name_queries

    def pairs(*_, **__):
        raise AssertionError("all pairs")

    monkeypatch.setattr(M, "override_pairs", pairs)
    monkeypatch.setattr(M, "inherited_implementations", lambda *_: None)
    monkeypatch.setattr(M, "flowing_families", lambda *_: spark.range(1))
    monkeypatch.setattr(member_queries, "own_classes", lambda _: None)
    f = SimpleNamespace(method=None, parent="p", levels="l", returns=None, up=None, depth_first=None)
    assert member_queries.family_table(f).count() == 1
    monkeypatch.setattr(name_queries, "all_fields", lambda _: None)
    monkeypatch.setattr(R, "rename_fields", lambda fields, closure, descent: (closure, descent))
    assert name_queries.field_renaming(f) == (None, ("p", "l"))


def test_obligations_handed_down(spark):
    rng = random.Random(11)
    for n in (9,):
        ids, p, nodes, levels = hierarchy(spark, rng, n)
        made = [(c, name, "()", ret, rng.randrange(9), rng.random() < 0.8, rng.random() < 0.7, rng.random() < 0.4, c % 3 == 0,
                 rng.choice([0, 1, None]), rng.choice([1, 2, 3])) for c in ids for name in ("a", "b", None) for ret in "FOX" if rng.random() < 0.5]
        methods = spark.createDataFrame(
            made + made[:2], "class long, name string, params string, ret string, ord long, overridable boolean, abstract boolean, "
            "visible boolean, in_iface boolean, package int, access_rank int")
        targets = spark.createDataFrame([(c, rng.choice([0, 1])) for c in ids], "node long, package int")
        closed = M.abstract_obligations(targets, H.ranked_closure(p, targets, breadth_first=True), methods)
        flowing = M.abstract_obligations(targets, None, methods, p, levels)
        kind = ["node", "name", "params", "ret"]
        assert rows(flowing.select(kind).distinct(), *kind) == rows(closed.select(kind).distinct(), *kind)
        for found in (M.most_specific_return, lambda o, _: o.groupBy("node", "name", "params").agg({"access_rank": "max"})):
            was, now = found(closed, fits(spark)), found(flowing, fits(spark))
            assert rows(now, *was.columns) == rows(was, *was.columns)
