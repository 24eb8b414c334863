from conftest import order, rows
from pyspark.sql import functions as F

from classlake import iterate
from classlake.operators import blocks as B
from classlake.operators import graph as G
from classlake.operators import ranges as R


def random_graph(rng, n, m):
    data = {(i, rng.randrange(i)) for i in range(1, n)}
    data = {(b, a) for a, b in data} | {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
    return sorted(data)


def reach(data, start, without=None):
    if start == without:
        return set()
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for a, b in data:
            if a == x and b != without and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def graphs(spark, rng, units=5, n=11, m=5):
    g = {u: random_graph(rng, n, m) for u in range(units)}
    edges = spark.createDataFrame([(u, a, b, 0) for u, d in g.items() for a, b in d], "unit long, src long, dst long, ord int")
    nodes = spark.createDataFrame([(u, i) for u in g for i in range(n)], "unit long, node long")
    return g, nodes, edges


def test_small_block_graph(spark):
    instr = spark.createDataFrame([("u", 0, "general"), ("u", 1, "return"), ("u", 2, "return")], "unit string, idx long, op string")
    ranges = spark.createDataFrame([("u", 0, 1, 2, "E")], "unit string, from_idx long, to_idx long, handler_idx long, exc_type string")
    jumps = instr.select("unit", "idx", F.col("idx").alias("dest")).filter("false")
    blocks = B.block_ids(instr, jumps, ranges)
    assert rows(blocks, "idx", "block") == [(0, 1), (1, 2), (2, 3)]
    assert rows(R.members(blocks, ranges), "block") == [(1,)]
    assert rows(R.exception_edges(blocks, ranges), "src", "dst", "exc_type") == [(1, 3, "E")]
    assert rows(B.block_edges(blocks, jumps), "src", "dst", "ord") == [(1, 2, 1)]


def test_dominators_match_removal(spark, rng):
    g, nodes, edges = graphs(spark, rng)
    got = rows(G.dominators(nodes, edges), "unit", "n", "d")
    want = []
    for u, d in g.items():
        live = reach(d, 0)
        want += [(u, n, x) for n in live for x in live if n == x or x == 0 or n not in reach(d, 0, x)]
    assert got == sorted(want, key=order)


def test_graph_text(spark):
    nodes = spark.createDataFrame([("u", 1), ("u", 2), ("u", 3)], "unit string, node long")
    edges = spark.createDataFrame([("u", 1, 2), ("u", 1, 2), ("u", 1, 3)], "unit string, src long, dst long")
    held = [("u", 0, 4, 6, 3, 1), ("u", 0, 4, 6, 3, 2), ("u", 0, 2, 6, 3, 1), ("u", 0, 2, 6, 3, 1)]
    ranges = spark.createDataFrame(held, "unit string, from_idx long, to_idx long, handler_idx long, handler long, block long")
    caught = spark.createDataFrame([("u", 1, 3), ("u", 2, 3)], "unit string, src long, dst long")
    text = [r[-1] for r in rows(G.dot_lines(nodes, edges, caught, ranges), "unit", "part", "a", "b", "c", "line")]
    assert text == [
        "digraph uu {", '1 [shape=box,label="Block 1"];', "1 -> 2;", "1 -> 3;", "1 -> 3 [style=dotted];", '2 [shape=box,label="Block 2"];',
        "2 -> 3 [style=dotted];", '3 [shape=box,label="Block 3"];', "subgraph cluster_ex_0 {", '\tlabel="Exception range for Block 3 ";',
        "\t1;", "\t}", "subgraph cluster_ex_1 {", '\tlabel="Exception range for Block 3 ";', "\t1;", "\t2;", "\t}", "}"]
    assert len(rows(G.dot_lines(nodes, edges), "line")) == 7


def test_tree_intervals_and_common_ancestors(spark, rng):
    """The tree's interval test tells dominators apart, and the tour finds common ancestors."""
    parent = {n: rng.randrange(max(0, n - 4), n) for n in range(1, 40)} | {50: 0, 51: 50}
    tree = spark.createDataFrame([("u", n, p) for n, p in parent.items()] + [("v", 7, 3)], "unit string, n long, p long")
    places = G.tour(tree, 7)

    def up(n):
        return [n] + (up(parent[n]) if n in parent else [])

    groups = {g: rng.sample(sorted(parent), rng.randint(1, 4)) for g in range(60)} | {60: [0, 5], 61: [0]}
    asked = spark.createDataFrame([("u", g, p) for g, ps in groups.items() for p in ps], "unit string, n long, p long")
    want = [(g, max(set.intersection(*(set(up(p)) for p in ps)), key=lambda x: len(up(x)))) for g, ps in groups.items()]
    assert rows(G.nearest_common(asked, places, 7), "n", "common") == sorted(want)
    spans = G._placed(tree, places)
    pairs = spark.createDataFrame([("u", n, d) for n in parent for d in parent], "unit string, n long, d long")
    assert rows(G.dominated(pairs, spans, "n", "d"), "n", "d") == sorted((n, d) for n in parent for d in up(n) if d in parent)


def test_dominators_of_a_long_line(spark):
    """Blocks in a row with side exits: no row for a block and each of its ancestors."""
    n = 600
    edges = [("u", k, k + 1) for k in range(n)] + [("u", k, n + 1 + k % 3) for k in range(0, n, 5)]
    e = spark.createDataFrame(edges, "unit string, src long, dst long")
    nodes = spark.createDataFrame([("u", k) for k in range(n + 4)], "unit string, node long")
    tree = rows(G.dominator_tree(nodes, e), "node", "idom", "depth")
    assert tree[0] == (0, G.TOP, 0) and tree[1:n + 1] == [(k, k - 1, k) for k in range(1, n + 1)]
    assert tree[n + 1:] == [(n + 1 + k, d, d + 1) for k, d in enumerate((0, 10, 5))]


def test_dominators_with_two_roots(spark):
    edges = spark.createDataFrame([(1, 0, 2, 0), (1, 1, 2, 0), (1, 2, 3, 0)], "unit long, src long, dst long, ord int")
    nodes = spark.createDataFrame([(1, i) for i in range(4)], "unit long, node long")
    roots = nodes.filter("node < 2")
    assert rows(G.dominators(nodes, edges, roots), "n", "d") == [(0, 0), (1, 1), (2, 2), (3, 2), (3, 3)]
    assert rows(G.immediate_dominators(nodes, edges, roots), "node", "idom") == [(3, 2)]


def test_post_dominators_with_endless_loop(spark):
    data = [(0, 1), (1, 2), (2, 1), (0, 3), (3, 4), (4, 5), (3, 5)]
    edges = spark.createDataFrame([(1, a, b, 0) for a, b in data], "unit long, src long, dst long, ord int")
    nodes = spark.createDataFrame([(1, i) for i in range(6)], "unit long, node long")
    got = {}
    for n, d in rows(G.post_dominators(nodes, edges), "n", "d"):
        got.setdefault(n, set()).add(d)
    assert got == {0: {0}, 1: {1, 2}, 2: {1, 2}, 3: {3, 5}, 4: {4, 5}, 5: {5}}


def test_exits_look_for_components_in_endless_loops_alone(spark, monkeypatch):
    data = [(0, 1), (1, 0), (1, 2), (2, 3), (3, 2), (3, 4), (0, 5), (5, 6), (6, 5), (6, 7), (7, 8), (8, 7), (9, 9)]
    edges = spark.createDataFrame([(1, a, b, 0) for a, b in data], "unit long, src long, dst long, ord int")
    nodes = spark.createDataFrame([(1, i) for i in range(10)], "unit long, node long")
    searched, search = [], G.unit_components
    monkeypatch.setattr(G, "unit_components", lambda n, e: searched.append(rows(n, "node")) or search(n, e))
    assert rows(G.exit_components(nodes, edges), "node", "component") == [(4, 4), (7, 7), (8, 7), (9, 9)]
    assert searched == [[(5,), (6,), (7,), (8,)]]  # all others reach 4 or 9


def test_common_ancestors_of_a_deep_tree(spark, rng, monkeypatch):
    n = 150
    up = {k: max(0, k - rng.choice([1, 1, 1, 7])) for k in range(1, n)}
    tree = spark.createDataFrame([(1, k, p) for k, p in up.items()], "unit long, n long, p long")
    steps = (2 * n + 2).bit_length()
    places = G.tour(tree, steps)
    above = {0: [0]}
    for k, p in up.items():
        above[k] = [k, *above[p]]
    asked = {k: rng.sample(range(n), rng.choice([1, 2, 3])) for k in range(n)}
    written, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: written.append(cut(df)) or written[-1])
    got = rows(G.nearest_common(spark.createDataFrame(
        [(1, k, p) for k, ps in asked.items() for p in ps], "unit long, n long, p long"), places, steps), "n", "common")
    assert got == [(k, max(set.intersection(*(set(above[p]) for p in ps)))) for k, ps in asked.items()]
    assert sum(df.count() for df in written) <= 2 * n  # no table of n log n minima


def irreducible(data, nodes):
    """Collapse self loops and single predecessors until stuck."""
    succ = {n: set() for n in nodes}
    for a, b in data:
        succ[a].add(b)
    while True:
        for n in list(succ):
            succ[n].discard(n)
        preds = {n: [p for p in succ if n in succ[p]] for n in succ}
        pick = next((n for n in succ if len(preds[n]) == 1), None)
        if pick is None:
            return len(succ) > 1
        p = preds[pick][0]
        succ[p] |= succ[pick]
        succ[p].discard(pick)
        del succ[pick]


def test_reducibility_and_splitting(spark, rng):
    g, nodes, edges = graphs(spark, rng, units=8, n=6, m=4)
    live, kept = G.drop_dead(nodes, edges)
    bad = G.irreducible_units(kept)
    want = sorted((u,) for u, d in g.items() if irreducible([e for e in d if e[0] in reach(d, 0)], reach(d, 0)))
    assert rows(bad, "unit") == want and want
    size = live.withColumn("size", F.lit(1))
    more, split = G.split_irreducible(live, kept, size)
    after = {}
    for u, a, b in rows(split, "unit", "src", "dst"):
        after.setdefault(u, []).append((a, b))
    spread = {}
    for u, n in rows(more, "unit", "node"):
        spread.setdefault(u, []).append(n)
    assert not any(irreducible(d, spread[u]) for u, d in after.items())


def limit(data, nodes):
    """What a graph collapses to: {least node of a part: its nodes}, and the edges among parts."""
    parts = {n: {n} for n in nodes}
    while True:
        at = {n: p for p, members in parts.items() for n in members}
        left = {(at[a], at[b]) for a, b in data if at[a] != at[b]}
        one = next(((b, preds[0]) for b in sorted(parts) if len(preds := [a for a, c in left if c == b]) == 1), None)
        if one is None:
            return parts, left
        both = parts.pop(one[0]) | parts.pop(one[1])
        parts[min(both)] = both


def split_until_reducible(data, size):
    """The edges after copying one part at a time for all its predecessors but the last."""
    data, size = set(data), dict(size)
    while True:
        parts, left = limit(data, size)
        if not left:
            return data
        preds = {p: sorted(a for a, b in left if b == p) for p in parts}
        cost = lambda p: (sum(a == p for a, b in left), sum(size[n] for n in parts[p]) * (len(preds[p]) - 1), p)
        pick = min((p for p in parts if len(preds[p]) > 1), key=cost)
        inside, at = parts[pick], {n: p for p, members in parts.items() for n in members}
        before, top = set(data), max(size)
        for pred in preds[pick][:-1]:
            copy = {n: top + k for k, n in enumerate(sorted(inside), 1)}
            top += len(inside)
            size.update((copy[n], size[n]) for n in inside)
            data = {(a, copy[b] if b in inside and at.get(a) == pred else b) for a, b in data}
            data |= {(copy[a], copy.get(b, b)) for a, b in before if a in inside}


def test_splitting_goes_on_in_open_units_alone(spark, rng):
    g, nodes, edges = graphs(spark, rng, units=9, n=7, m=4)
    live, kept = G.drop_dead(nodes, edges)
    size = live.withColumn("size", F.col("node") % 3 + 1)
    kept, live = kept.unionByName(kept.limit(3)), live.unionByName(live.limit(2))  # repeated rows
    got = {}
    for u, a, b in rows(G.split_irreducible(live, kept, size)[1], "unit", "src", "dst"):
        got.setdefault(u, set()).add((a, b))
    for u, d in g.items():
        there = reach(d, 0)
        assert got.get(u, set()) == split_until_reducible([e for e in d if e[0] in there], {n: n % 3 + 1 for n in there})
    held = spark.createDataFrame([(u,) for u in g], "unit long")
    assert rows(G.split_irreducible(live, kept, size, held)[1], "unit", "src", "dst") == rows(
        kept.select("unit", "src", "dst").distinct(), "unit", "src", "dst")
    none = G.split_irreducible(live.limit(0), kept.limit(0), size.limit(0))
    assert none[0].isEmpty() and none[1].isEmpty()


def test_bypass_leaves_circles_alone(spark):
    u = "unit long, src long, dst long, ord int"
    edges = spark.createDataFrame([(1, 0, 1, 0), (1, 1, 2, 0), (1, 2, 3, 0), (1, 0, 4, 1), (1, 4, 5, 0), (1, 5, 4, 0)], u)
    gotos = edges.filter("src in (1, 2, 4, 5)").select("unit", F.col("src").alias("node"), F.col("dst").alias("target"))
    only = gotos.select("unit", "node")
    assert rows(G.bypass(edges, gotos, only), "src", "dst") == [(0, 3), (0, 4), (4, 5), (5, 4)]


def test_audit_reports_each_rule(spark):
    nodes = spark.createDataFrame([(1, 1), (1, 2)], "unit long, node long")
    succ = spark.createDataFrame([(1, 1, 7), (1, 8, 2)], "unit long, src long, dst long")
    pred = spark.createDataFrame([(1, 2, 1)], "unit long, src long, dst long")
    expr = spark.createDataFrame([(1, 1, 5), (1, 2, 5)], "unit long, node long, expr long")
    found = {r[0] for r in rows(G.audit(nodes, succ, pred, expr), "rule")}
    assert found == {"source missing", "target missing", "not seen from target", "not seen from source",
                     "unreachable", "expression in two nodes"}


def test_split_ranges_merge_only_with_one_entry(spark):
    u = "unit long, handler_idx long, types string, from_idx long, to_idx long, block long"
    logical = spark.createDataFrame([(1, 9, "E", 0, 2, 2), (1, 9, "E", 4, 6, 4), (2, 9, "E", 0, 2, 2), (2, 9, "E", 4, 6, 4)], u)
    # unit 1: 1 -> 2 -> 3 -> 4 -> 5; unit 2 enters 4 from outside as well
    edges = spark.createDataFrame(
        [(x, a, a + 1, 0) for x in (1, 2) for a in range(1, 5)] + [(2, 1, 4, 1)], "unit long, src long, dst long, ord int")
    nodes = spark.createDataFrame([(x, i) for x in (1, 2) for i in range(1, 6)], "unit long, node long")
    safe = nodes.filter("node = 3")
    assert rows(R.merge_split(logical, nodes, edges, safe), "unit", "block") == [(1, 3)]


def test_results_do_not_depend_on_row_order(spark, rng):
    _, nodes, edges = graphs(spark, rng, units=3)
    plain = rows(G.immediate_dominators(nodes, edges), "unit", "node", "idom")
    mixed = rows(G.immediate_dominators(nodes.orderBy(F.rand(1)).repartition(7), edges.orderBy(F.rand(2)).repartition(3)), "unit", "node", "idom")
    assert plain == mixed


def test_reachable_matches_search(spark, rng):
    g, nodes, edges = graphs(spark, rng, units=8, n=14, m=3)
    loose = spark.createDataFrame([(9, 1, 2, 0), (9, 3, 4, 0), (9, 4, 5, 0), (9, 5, 3, 0), (9, 4, 2, 0)], edges.schema)
    alone = spark.createDataFrame([(9, k) for k in range(1, 6)], nodes.schema)
    got = rows(G.reachable(nodes.unionByName(alone), edges.unionByName(loose)), "unit", "node")
    assert got == sorted([(u, n) for u, d in g.items() for n in reach(d, 0)] + [(9, 1), (9, 2)])


def test_a_long_line_takes_few_rounds(spark, monkeypatch):
    written = []
    keep = iterate._write
    monkeypatch.setattr(iterate, "_write", lambda df: written.append(1) or keep(df))
    n = 4096
    edges = spark.range(n - 1).select(F.lit(1).alias("unit"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    nodes = spark.range(n).select(F.lit(1).alias("unit"), F.col("id").alias("node"))
    assert G.reachable(nodes, edges).count() == n
    assert len(written) <= n.bit_length() + 12


def test_handlers_are_live(spark):
    """0 -> 1, and an exception edge from 1 to 2, which goes on to 3."""
    edges = spark.createDataFrame([(1, 0, 1, 0), (1, 2, 3, 0)], "unit long, src long, dst long, ord int")
    thrown = spark.createDataFrame([(1, 1, 2, "E")], "unit long, src long, dst long, exc_type string")
    nodes = spark.createDataFrame([(1, k) for k in range(5)], "unit long, node long")
    flow = R.all_edges(edges, thrown).select("unit", "src", "dst").distinct()
    live, kept = G.drop_dead(nodes, edges, flow)
    assert rows(live, "node") == [(0,), (1,), (2,), (3,)] and rows(kept, "src", "dst") == [(0, 1), (2, 3)]
    assert rows(G.immediate_dominators(live, flow), "node", "idom") == [(1, 0), (2, 1), (3, 2)]


def test_switch_targets_in_order(spark):
    instr = spark.createDataFrame([("u", k, op) for k, op in enumerate(["switch", "general", "return", "return"])],
                                  "unit string, idx long, op string")
    jumps = spark.createDataFrame([("u", 0, 0, 3), ("u", 0, 1, 2), ("u", 0, 2, 1), ("u", 0, 3, 2)],
                                  "unit string, idx long, ord int, dest long")
    ranges = spark.createDataFrame([], "unit string, from_idx long, to_idx long, handler_idx long, exc_type string")
    blocks = B.block_ids(instr, jumps, ranges)
    assert rows(B.block_edges(blocks, jumps), "src", "ord", "dst") == [(1, 0, 4), (1, 1, 3), (1, 2, 2), (1, 3, 3), (2, 1, 3)]
