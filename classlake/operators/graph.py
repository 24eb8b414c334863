"""Analyses of per-unit graphs: nodes(unit, node), edges(unit, src, dst, ord)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classlake import iterate
from classlake.iterate import cut, fixpoint
from classlake.scan import ranked


def arcs(edges: DataFrame) -> DataFrame:
    """Distinct (unit, node, _to) with names that never clash with a frontier."""
    return edges.select("unit", F.col("src").alias("node"), F.col("dst").alias("_to")).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select("unit", F.col("dst").alias("src"), F.col("src").alias("dst"))


def entries_of(nodes: DataFrame) -> DataFrame:
    """Entry node of each unit: its least node."""
    return nodes.groupBy("unit").agg(F.min("node").alias("node"))


# ---------------------------------------------------------------- reachability


def reachable(nodes: DataFrame, edges: DataFrame, entries: DataFrame | None = None,
              depth: str | None = None) -> DataFrame:
    """(unit, node) reachable from the entries of the unit.

    Nodes with one predecessor are folded into the node where their chain of
    only predecessors begins, in logarithmically many rounds, so the search
    itself walks over the other nodes alone.  With ``depth`` the distance is
    wanted and every step is walked.
    """
    out = cut(arcs(edges))
    seed = (entries_of(nodes) if entries is None else entries).select("unit", "node")
    walk = lambda to: lambda f: f.join(to, ["unit", "node"]).select("unit", F.col("_to").alias("node"))
    if depth is not None:
        return fixpoint(seed, walk(out), depth=depth)
    single = (
        out.filter("node <> _to").groupBy("unit", F.col("_to").alias("n"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("p")).filter("_n = 1").select("unit", "n", "p")
        .join(seed.withColumnRenamed("node", "n"), ["unit", "n"], "left_anti"))
    folds = iterate.chain_starts(cut(single), ["unit"], "n", "p")
    start = folds.select("unit", F.col("n").alias("node"), F.col("p").alias("_start"))
    folded = (
        out.join(single.select("unit", F.col("n").alias("_to")), ["unit", "_to"], "left_anti")
        .join(start, ["unit", "node"], "left")
        .select("unit", F.coalesce("_start", "node").alias("node"), "_to").filter("node <> _to").distinct())
    found = cut(fixpoint(seed, walk(cut(folded))))
    inner = folds.select("unit", "n", F.col("p").alias("node")).join(found, ["unit", "node"]).select(
        "unit", F.col("n").alias("node"))
    return found.unionByName(inner)


def drop_dead(nodes: DataFrame, edges: DataFrame, flow: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges left after removing everything that ``flow`` (or ``edges``) does not reach."""
    live = cut(reachable(nodes, edges if flow is None else flow))
    kept = edges.join(live.withColumnRenamed("node", "src"), ["unit", "src"], "left_semi")
    return live, cut(kept)


def unreachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(reachable(nodes, edges), ["unit", "node"], "left_anti")


# ---------------------------------------------------------------- contraction


def bypass(edges: DataFrame, gotos: DataFrame, removable: DataFrame) -> DataFrame:
    """Edges after dropping jump-only nodes: predecessors go to the final target.

    ``gotos(unit, node, target)`` links every node that ends in an
    unconditional jump; nodes whose jumps lead round a circle are left alone.
    ``removable(unit, node)`` are the nodes that hold nothing but the jump.
    """
    circular = iterate.looping(gotos, ["unit"], "node", "target")
    links = gotos.join(removable, ["unit", "node"], "left_semi").join(
        circular, ["unit", "node"], "left_anti")
    final = iterate.pointer_double(links, ["unit"], "node", "target")
    gone = final.select("unit", F.col("node").alias("src"))
    moved = final.select("unit", F.col("node").alias("dst"), F.col("target").alias("_t"))
    return (
        edges.join(gone, ["unit", "src"], "left_anti")
        .join(moved, ["unit", "dst"], "left")
        .select("unit", "src", F.coalesce("_t", "dst").alias("dst"), "ord")
    )


def chains(nodes: DataFrame, edges: DataFrame, blocked: DataFrame | None = None,
           split: DataFrame | None = None) -> DataFrame:
    """Straight-line chains of a graph without dead nodes: (unit, head, pos, node).

    A node joins its predecessor when that has no other successor, it has no
    other predecessor and is not an entry.  ``blocked(unit, node)`` nodes
    (exception handlers) never join; ``split(unit, src, dst)`` edges connect
    nodes of different protected ranges and never merge.
    """
    outs = edges.groupBy("unit", "src").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1")
    ins = edges.groupBy("unit", "dst").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1")
    ok = (
        edges.select("unit", "src", "dst")
        .join(outs.select("unit", "src"), ["unit", "src"], "left_semi")
        .join(ins.select("unit", "dst"), ["unit", "dst"], "left_semi")
        .join(entries_of(nodes).withColumnRenamed("node", "dst"), ["unit", "dst"], "left_anti")
    )
    if blocked is not None:
        ok = ok.join(blocked.select("unit", F.col("node").alias("dst")), ["unit", "dst"], "left_anti")
    if split is not None:
        ok = ok.join(split, ["unit", "src", "dst"], "left_anti")
    links = ok.select("unit", F.col("dst").alias("node"), F.col("src").alias("head"))
    heads = iterate.pointer_double(links, ["unit"], "node", "head")
    found = heads.select("unit", "head", F.col("steps").alias("pos"), "node")
    rest = nodes.join(found.select("unit", "node"), ["unit", "node"], "left_anti")
    return found.unionByName(
        rest.select("unit", F.col("node").alias("head"), F.lit(0).cast("long").alias("pos"), "node"))


# ---------------------------------------------------------------- dominance


#: Stands above all entries of a unit; a node of its own, so a graph may have several.
TOP = -(2**62)


def dominator_tree(nodes: DataFrame, edges: DataFrame, entries: DataFrame | None = None,
                   live: DataFrame | None = None) -> DataFrame:
    """Dominator tree of live nodes: (unit, node, idom, pre, post, depth).

    ``idom`` is ``TOP`` where no node dominates, as for entries.  ``d`` dominates
    ``n`` if and only if ``pre(d) <= pre(n) <= post(d)``; see :func:`dominated`.

    A node with one predecessor hangs below it for good.  The others start below
    a predecessor that a breadth-first search met first; then each moves up to the
    nearest common ancestor of its predecessors and its place, all at once, until
    none moves: every tree on the way holds all dominators of a node above it.
    Units in which nothing moved are done and leave the loop.
    Ancestors are looked up in the tree's Euler tour (:func:`tour`) as the least
    depth between two positions, from minima of blocks of 4 ** j positions.
    So a tree takes rows in the order of its nodes, a look-up in that of their
    logarithm, however deep it is; no node is paired with all its ancestors.  ``live``
    nodes may be given if they are known.
    """
    if live is None:
        live = cut(reachable(nodes, edges, entries))
    top = F.lit(TOP).cast("long")
    seed = (entries_of(nodes) if entries is None else entries).select("unit", F.col("node").alias("n")).distinct()
    preds = cut(
        edges.select("unit", F.col("src").alias("p"), F.col("dst").alias("n")).filter("p <> n").distinct()
        .join(live.withColumnRenamed("node", "p"), ["unit", "p"], "left_semi")
        .unionByName(seed.withColumn("p", top)))
    single = cut(
        preds.groupBy("unit", "n").agg(F.count(F.lit(1)).alias("_n"), F.min("p").alias("p")).filter("_n = 1").select("unit", "n", "p"))
    several = cut(preds.join(single.select("unit", "n"), ["unit", "n"], "left_anti"))
    size = live.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    steps = (2 * size + 2).bit_length()  # doublings that reach over a unit's tour
    if several.isEmpty():
        return _placed(single, tour(single, steps))
    starts = iterate.chain_starts(single, ["unit"], "n", "p")
    folded = cut(
        several.join(starts.select("unit", F.col("n").alias("p"), F.col("p").alias("_s")), ["unit", "p"], "left")
        .select("unit", "p", "n", F.coalesce("_s", "p").alias("node")))
    roots = seed.select("unit").distinct().withColumn("node", top)
    hops = cut(folded.select("unit", "node", F.col("n").alias("_to")).distinct())
    dist = cut(fixpoint(
        roots, lambda f: f.join(hops, ["unit", "node"]).select("unit", F.col("_to").alias("node")), depth="depth"))
    of = lambda c, d: dist.select("unit", F.col("node").alias(c), F.col("depth").alias(d))
    above = cut(
        folded.join(of("node", "_dp"), ["unit", "node"]).join(of("n", "_dn"), ["unit", "n"]).filter("_dn = _dp + 1")
        .groupBy("unit", "n").agg(F.min("p").alias("p")))
    settled: list[DataFrame] = []
    while True:
        tree = cut(single.unionByName(above))
        places = tour(tree, steps)
        asked = several.unionByName(above.select("unit", "p", "n"))
        common = cut(nearest_common(asked, places, steps))
        moving = cut(common.join(above, ["unit", "n"]).filter("common <> p").select("unit").distinct())
        placed = _placed(tree, places)
        if moving.isEmpty():
            return iterate._union([*settled, placed])
        settled.append(placed.join(moving, "unit", "left_anti"))
        single, several = (x.join(moving, "unit", "left_semi") for x in (single, several))
        above = cut(common.join(moving, "unit", "left_semi").select("unit", "n", F.col("common").alias("p")))


def tour(tree: DataFrame, steps: int) -> DataFrame:
    """Euler tour of each unit's tree of (unit, n, p): (unit, at, depth, node, side, n).

    Every node is opened (side 0) before and closed (side 1) behind its
    children, which come in order; a closing row carries the parent that the
    tour is back at, and the parent's depth.  Positions come from list ranking:
    each step doubles the reach of every link, three in a job, so ``steps`` is
    the logarithm of the longest tour.
    """
    child = cut(ranked(tree, ["unit", "p"], ["n"], "_i", F.floor(F.col("n") / 65536)))
    nodes = tree.select("unit", "n").unionByName(tree.select("unit", F.col("p").alias("n"))).distinct()
    first = child.filter("_i = 0").select("unit", F.col("p").alias("n"), F.col("n").alias("_first"))
    later = child.select("unit", "p", (F.col("_i") - 1).alias("_i"), F.col("n").alias("_next"))
    opened = nodes.join(first, ["unit", "n"], "left").select(
        "unit", "n", F.lit(0).alias("side"), F.coalesce("_first", "n").alias("m"),
        F.when(F.col("_first").isNull(), 1).otherwise(0).alias("mside"))
    closed = child.join(later, ["unit", "p", "_i"], "left").select(
        "unit", "n", F.lit(1).alias("side"), F.coalesce("_next", "p").alias("m"),
        F.when(F.col("_next").isNull(), 1).otherwise(0).alias("mside"))
    ends = nodes.join(tree.select("unit", "n"), ["unit", "n"], "left_anti").select(
        "unit", "n", F.lit(1).alias("side"), F.lit(None).cast("long").alias("m"), F.lit(None).cast("int").alias("mside"))
    # what lies behind a row up to its link: rows, and openings less closings
    links = opened.unionByName(closed).withColumn("far", F.lit(1).cast("long")).withColumn(
        "rise", (1 - 2 * F.col("mside")).cast("long")).unionByName(
        ends.withColumn("far", F.lit(0).cast("long")).withColumn("rise", F.lit(0).cast("long")))
    current = cut(links)

    def doubled(df: DataFrame) -> DataFrame:
        ahead = df.select("unit", F.col("n").alias("m"), F.col("side").alias("mside"), F.col("m").alias("_m"),
                          F.col("mside").alias("_ms"), F.col("far").alias("_f"), F.col("rise").alias("_r"))
        return df.join(ahead, ["unit", "m", "mside"], "left").select(
            "unit", "n", "side", F.col("_m").alias("m"), F.col("_ms").alias("mside"),
            (F.col("far") + F.coalesce("_f", F.lit(0))).alias("far"), (F.col("rise") + F.coalesce("_r", F.lit(0))).alias("rise"))

    for step in range(1, steps + 1):
        current = doubled(current)
        if step % 3 == 0 or step == steps:
            current = cut(current)
    parent = tree.select("unit", "n", "p", F.lit(1).alias("side"))
    return cut(
        current.join(parent, ["unit", "n", "side"], "left")
        .select("unit", (-F.col("far")).alias("at"), (-F.col("rise") - 1).alias("depth"), F.coalesce("p", "n").alias("node"), "side", "n"))


def nearest_common(asked: DataFrame, places: DataFrame, steps: int) -> DataFrame:
    """(unit, n, common): nearest common ancestor of all p of ``asked(unit, n, p)``, by the tour ``places``.

    Minima of blocks of 4 ** j positions are a third of the tour's rows; a span
    is cut into whole blocks, at most six of a size.
    """
    at = places.filter("side = 0").select("unit", F.col("node").alias("p"), "at")
    spans = asked.join(at, ["unit", "p"]).groupBy("unit", "n").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    level = places.filter("depth >= 0").select("unit", F.col("at").alias("b"), F.struct("depth", "node").alias("low"))
    tables, pieces = [], []
    for j in range((steps + 1) // 2):
        if j:
            level = cut(level.groupBy("unit", F.shiftright("b", 2).alias("b")).agg(F.min("low").alias("low")))
        tables.append(level.withColumn("j", F.lit(j)))
        # blocks from l to before r lie in the span; those from up to before down go as larger ones
        l, r = f"shiftright(lo + {4**j - 1}, {2 * j})", f"shiftright(hi + 1, {2 * j})"
        up, down = f"4 * shiftright(lo + {4**(j + 1) - 1}, {2 * j + 2})", f"4 * shiftright(hi + 1, {2 * j + 2})"
        for a, b in ((l, f"least({up}, {r})"), (f"greatest({down}, least({up}, {r}))", r)):
            pieces.append(f"if({a} < {b}, transform(sequence({a}, {b} - 1), b -> struct({j} as j, b as b)), array())")
    blocks = spans.select("unit", "n", F.explode(F.expr(f"concat({', '.join(pieces)})")).alias("_b")).select(
        "unit", "n", "_b.j", "_b.b")
    return (
        blocks.join(iterate._union(tables), ["unit", "j", "b"]).groupBy("unit", "n").agg(F.min("low").alias("low"))
        .select("unit", "n", F.col("low.node").alias("common")))


def _placed(tree: DataFrame, places: DataFrame) -> DataFrame:
    spans = places.groupBy("unit", "n").agg(
        F.min("at").alias("pre"), F.max("at").alias("post"), F.max(F.when(F.col("side") == 0, F.col("depth"))).alias("depth"))
    return tree.join(spans, ["unit", "n"]).select(
        "unit", F.col("n").alias("node"), F.col("p").alias("idom"), "pre", "post", (F.col("depth") - 1).alias("depth"))


def dominated(pairs: DataFrame, tree: DataFrame, n: str, d: str) -> DataFrame:
    """``pairs`` whose ``d`` dominates ``n``: an interval test, two rows of the tree for each pair."""
    inner = tree.select("unit", F.col("node").alias(n), F.col("pre").alias("_at"))
    outer = tree.select("unit", F.col("node").alias(d), F.col("pre").alias("_pre"), F.col("post").alias("_post"))
    return pairs.join(inner, ["unit", n]).join(outer, ["unit", d]).filter("_at between _pre and _post").select(*pairs.columns)


def tree_pairs(tree: DataFrame) -> DataFrame:
    """The tree spelled out, for who wants all pairs: reflexive (unit, n, d)."""
    tree = cut(tree.select("unit", "node", "idom"))
    links = tree.filter(F.col("idom") != TOP).select("unit", F.col("node").alias("n"), F.col("idom").alias("p"))
    return iterate.ancestors(links, ["unit"], "n", "p", "d").unionByName(
        tree.select("unit", F.col("node").alias("n"), F.col("node").alias("d")))


def dominators(nodes: DataFrame, edges: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Reflexive dominator pairs of live nodes: (unit, n, d).  Several entries act as several roots."""
    return tree_pairs(dominator_tree(nodes, edges, entries))


def immediate_dominators(nodes: DataFrame, edges: DataFrame,
                         entries: DataFrame | None = None) -> DataFrame:
    """(unit, node, idom): the strict dominator nearest to the node; roots have none."""
    return nearest_dominators(dominator_tree(nodes, edges, entries))


def nearest_dominators(tree: DataFrame) -> DataFrame:
    return tree.filter(F.col("idom") != TOP).select("unit", "node", "idom")


def unit_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Strongly connected components inside each unit: (unit, node, component)."""
    key = lambda c: F.struct(F.col("unit").alias("unit"), F.col(c).alias("node"))
    scc = iterate.strong_components(
        edges.select(key("src").alias("src"), key("dst").alias("dst")),
        nodes.select(key("node").alias("node")))
    return scc.select("node.unit", "node.node", F.col("component.node").alias("component"))


def exit_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Members of components that no edge leaves: (unit, node, component).

    A node without a way on is such a component, and what reaches one is in no
    other.  Components are looked for among the nodes that are left, which all
    successors of such a node are among: they lead into endless loops alone.
    """
    nodes = nodes.select("unit", "node").distinct()
    ways = cut(
        edges.select("unit", "src", "dst").filter("src <> dst").distinct()
        .join(nodes.withColumnRenamed("node", "dst"), ["unit", "dst"], "left_semi"))
    ends = cut(nodes.join(ways.select("unit", F.col("src").alias("node")), ["unit", "node"], "left_anti"))
    rest = cut(nodes.join(reachable(nodes, reverse(ways), ends), ["unit", "node"], "left_anti"))
    single = ends.withColumn("component", F.col("node"))
    if rest.isEmpty():
        return single
    inner = cut(ways.join(rest.withColumnRenamed("node", "src"), ["unit", "src"], "left_semi"))
    comp = cut(unit_components(rest, inner))
    s = comp.select("unit", F.col("node").alias("src"), F.col("component").alias("cs"))
    d = comp.select("unit", F.col("node").alias("dst"), F.col("component").alias("cd"))
    left = (
        inner.select("unit", "src", "dst").join(s, ["unit", "src"]).join(d, ["unit", "dst"])
        .filter("cs <> cd").select("unit", F.col("cs").alias("component")).distinct())
    return single.unionByName(comp.join(left, ["unit", "component"], "left_anti").select("unit", "node", "component"))


def post_dominator_tree(nodes: DataFrame, edges: DataFrame, exit_node: int = -1) -> tuple[DataFrame, DataFrame]:
    """Dominator tree of the reversed graph below a virtual exit, and (unit, node, component) of what was folded.

    A component without a way out counts as an exit even when it loops: it is
    folded to one node with an edge to the virtual exit.
    """
    ends = cut(exit_components(nodes, edges))
    fold = lambda c: (ends.select("unit", F.col("node").alias(c), F.col("component").alias("_r" + c)))
    folded = (
        edges.select("unit", "src", "dst")
        .join(fold("src"), ["unit", "src"], "left").join(fold("dst"), ["unit", "dst"], "left")
        .select("unit", F.coalesce("_rsrc", "src").alias("src"), F.coalesce("_rdst", "dst").alias("dst"))
        .filter("src <> dst").distinct())
    out = F.lit(exit_node).cast("long")
    reps = ends.select("unit", F.col("component").alias("src")).distinct().withColumn("dst", out)
    backward = cut(reverse(folded.unionByName(reps)))
    roots = nodes.select("unit").distinct().withColumn("node", out)
    return dominator_tree(nodes, backward, roots), ends


def post_dominators(nodes: DataFrame, edges: DataFrame, exit_node: int = -1) -> DataFrame:
    """Reflexive post-dominator pairs: (unit, n, d).

    A node that cannot avoid a component without a way out is post-dominated by
    all of its members.
    """
    tree, ends = post_dominator_tree(nodes, edges, exit_node)
    out = F.lit(exit_node).cast("long")
    dom = tree_pairs(tree).filter((F.col("d") != out) & (F.col("n") != out))
    who = ends.select("unit", F.col("component").alias("d"), F.col("node").alias("_m"))
    inside = ends.select("unit", F.col("component").alias("n"), F.col("node").alias("_n"))
    return (
        dom.join(who, ["unit", "d"], "left").join(inside, ["unit", "n"], "left")
        .select("unit", F.coalesce("_n", "n").alias("n"), F.coalesce("_m", "d").alias("d")).distinct())


# ---------------------------------------------------------------- loops


def back_edges(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """Edges to a dominator of their source, by the dominator tree: (unit, src, dst)."""
    return dominated(edges.select("unit", "src", "dst").distinct(), tree, "src", "dst")


def natural_loops(edges: DataFrame, back: DataFrame) -> DataFrame:
    """Loop bodies, one loop per head: (unit, head, node)."""
    prev = cut(edges.select("unit", F.col("dst").alias("node"), F.col("src").alias("_from")).distinct())
    seed = back.select("unit", F.col("dst").alias("head"), F.col("src").alias("node")).unionByName(
        back.select("unit", F.col("dst").alias("head"), F.col("dst").alias("node")))
    return fixpoint(
        seed,
        lambda f: f.filter("node <> head").join(prev, ["unit", "node"])
        .select("unit", "head", F.col("_from").alias("node")))


def loop_depth(loops: DataFrame) -> DataFrame:
    """(unit, node, depth): number of loops around each looped node."""
    return loops.groupBy("unit", "node").agg(F.count(F.lit(1)).alias("depth"))


def irreducible_units(edges: DataFrame, with_exceptions: DataFrame | None = None) -> DataFrame:
    """Units whose graph (without dead nodes) does not collapse to one node: (unit).

    Dropping self-loops and folding every node with one predecessor into it
    are applied everywhere at once until neither is possible; the order does
    not matter.  An entry with one predecessor folds like any other node.
    Units with exception edges are reported reducible.
    """
    return collapsed(edges, with_exceptions)[0].select("unit").distinct()


def collapsed(edges: DataFrame, with_exceptions: DataFrame | None = None,
              nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """What is left of each graph that does not collapse: edges among its parts, and with ``nodes`` (unit, node, part)."""
    plain = edges.select("unit", "src", "dst").filter("src <> dst").distinct()
    if with_exceptions is not None:
        plain = plain.join(with_exceptions.select("unit").distinct(), "unit", "left_anti")
    live = cut(plain)
    parts = nodes and nodes.select("unit", "node", F.col("node").alias("part"))
    key = lambda c: F.struct(F.col("unit").alias("unit"), F.col(c).alias("node"))
    while True:
        folds = cut(
            live.groupBy("unit", F.col("dst").alias("node"))
            .agg(F.count(F.lit(1)).alias("_n"), F.min("src").alias("pred"))
            .filter("_n = 1").select(key("node").alias("a"), key("pred").alias("b")))
        if folds.isEmpty():
            return live, parts and parts.join(live.select("unit").distinct(), "unit", "left_semi")
        groups = iterate.components(folds, "a", "b").select(
            "node.unit", "node.node", F.col("component.node").alias("_g"))
        groups = cut(groups)
        at = lambda c: groups.select("unit", F.col("node").alias(c), F.col("_g").alias("_" + c))
        live = cut(
            live.join(at("src"), ["unit", "src"], "left").join(at("dst"), ["unit", "dst"], "left")
            .select("unit", F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst"))
            .filter("src <> dst").distinct())
        if parts is not None:
            parts = cut(parts.join(at("part"), ["unit", "part"], "left").select(
                "unit", "node", F.coalesce("_part", "part").alias("part")))


def split_candidate(nodes: DataFrame, edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Node to copy per unit: (unit, node, succs, cost).

    Among nodes with several predecessors: fewest successors, then least size
    times (predecessors - 1), then first in node order.
    ``sizes(unit, node, size)``.
    """
    plain = edges.select("unit", "src", "dst").distinct()
    preds = plain.groupBy("unit", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("_p"))
    succs = plain.groupBy("unit", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("_s"))
    ranked = (
        preds.filter("_p > 1").join(nodes, ["unit", "node"], "left_semi")
        .join(succs, ["unit", "node"], "left").join(sizes, ["unit", "node"])
        .select("unit", "node", F.coalesce("_s", F.lit(0)).cast("long").alias("succs"),
                (F.col("size") * (F.col("_p") - 1)).cast("long").alias("cost")))
    best = ranked.groupBy("unit").agg(
        F.min(F.struct("succs", "cost", "node")).alias("b"))
    return best.select("unit", "b.node", "b.succs", "b.cost")


def split_once(nodes: DataFrame, edges: DataFrame, sizes: DataFrame,
               units: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Copy the split candidate of each unit in ``units``: (nodes, edges, sizes).

    The copy takes over the edges from the least predecessor and repeats the
    out-edges of the original; copies get the next free node number.
    """
    pick = split_candidate(
        nodes.join(units, "unit", "left_semi"), edges.join(units, "unit", "left_semi"), sizes)
    top = nodes.groupBy("unit").agg((F.max("node") + 1).alias("copy"))
    pick = pick.select("unit", "node").join(top, "unit")
    first = (
        edges.select("unit", "src", F.col("dst").alias("node")).join(pick, ["unit", "node"])
        .groupBy("unit", "node", "copy").agg(F.min("src").alias("first")))
    pick = cut(first)
    moved = pick.select("unit", F.col("node").alias("dst"), F.col("first").alias("src"), "copy")
    into = edges.join(moved, ["unit", "src", "dst"], "left").select(
        "unit", "src", F.coalesce("copy", "dst").alias("dst"))
    outof = (
        into.join(pick.select("unit", F.col("node").alias("src"), "copy"), ["unit", "src"])
        .select("unit", F.col("copy").alias("src"), "dst"))
    more = pick.select("unit", F.col("copy").alias("node"))
    size = sizes.join(pick.select("unit", "node", "copy"), ["unit", "node"]).select(
        "unit", F.col("copy").alias("node"), "size")
    return (nodes.unionByName(more), into.unionByName(outof).distinct(), sizes.unionByName(size))


def split_parts(nodes: DataFrame, edges: DataFrame, sizes: DataFrame) -> list[DataFrame]:
    """Copy a part of each irreducible unit for its predecessors but the last: [nodes, edges, sizes].

    Parts are what the nodes of a unit collapse to, so a part is entered at one
    node.  The part is chosen like a node (:func:`split_candidate`) and copied
    whole, once for each predecessor part in order; a copy repeats the edges
    inside and out of the part and takes over those from its predecessor.
    Copies are numbered behind the greatest node by predecessor, then node.
    """
    left, parts = collapsed(edges, nodes=nodes)
    parts = cut(parts)
    weight = parts.join(sizes, ["unit", "node"]).groupBy("unit", F.col("part").alias("node")).agg(F.sum("size").alias("size"))
    pick = split_candidate(parts.select("unit", F.col("part").alias("node")).distinct(), left, weight)
    pick = cut(pick.select("unit", F.col("node").alias("part")))
    into = left.join(pick.withColumnRenamed("part", "dst"), ["unit", "dst"]).select("unit", F.col("src").alias("pred"))
    pred = cut(into.join(into.groupBy("unit").agg(F.max("pred").alias("_last")), "unit").filter("pred <> _last")
               .select("unit", "pred"))
    inside = cut(parts.join(pick, ["unit", "part"], "left_semi").select("unit", "node"))
    number = ranked(inside.join(pred, "unit"), ["unit"], ["pred", "node"], "_i",
                    F.struct("pred", F.floor(F.col("node") / 65536)))
    top = nodes.groupBy("unit").agg(F.max("node").alias("_top"))
    copies = cut(number.join(top, "unit").select("unit", "pred", "node", (F.col("_top") + 1 + F.col("_i")).alias("copy")))
    at = lambda c: copies.select("unit", "pred", F.col("node").alias(c), F.col("copy").alias("_" + c))
    of = parts.select("unit", F.col("node").alias("src"), F.col("part").alias("pred"))
    moved = edges.join(of, ["unit", "src"]).join(at("dst"), ["unit", "pred", "dst"], "left")
    kept = moved.select("unit", "src", F.coalesce("_dst", "dst").alias("dst"))
    outof = edges.join(at("src"), ["unit", "src"]).join(at("dst"), ["unit", "pred", "dst"], "left").select(
        "unit", F.col("_src").alias("src"), F.coalesce("_dst", "dst").alias("dst"))
    return [nodes.unionByName(copies.select("unit", F.col("copy").alias("node"))),
            kept.unionByName(outof).distinct(),
            sizes.unionByName(copies.join(sizes, ["unit", "node"]).select("unit", F.col("copy").alias("node"), "size"))]


def split_irreducible(nodes: DataFrame, edges: DataFrame, sizes: DataFrame,
                      with_exceptions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Split parts until every unit is reducible: (nodes, edges).

    Expects a graph without dead nodes.  A part that has been split folds into
    its predecessors, so a unit is through after as many rounds as it had parts.
    A round tests and rewrites only the units that the round before left
    irreducible.  Units with exception edges count as reducible and stay.
    """
    plain = edges.select("unit", "src", "dst").distinct()
    if with_exceptions is not None:
        with_exceptions = cut(with_exceptions.select("unit").distinct())
    more, split, _ = iterate.until_settled(
        [nodes.select("unit", "node").distinct(), plain, sizes.select("unit", "node", "size").distinct()], ["unit"],
        lambda nodes, edges, sizes: irreducible_units(edges, with_exceptions), split_parts)
    return more, split


# ---------------------------------------------------------------- export, audit


def dot_lines(nodes: DataFrame, edges: DataFrame, exceptions: DataFrame | None = None,
              ranges: DataFrame | None = None) -> DataFrame:
    """Graph text, one row per line: (unit, part, a, b, c, line); the lines' wording is a fixed format.

    Lines sort by (unit, part, a, b, c); keeping them as rows lets a unit of any
    size be written without gathering it.  ``exceptions(unit, src, dst)`` become
    dotted edges behind the regular ones.  ``ranges(unit, from_idx, to_idx,
    handler_idx, handler, block)``, a row for each protected block, become
    clusters: an opening row and a label, a row for each member and a closing row,
    numbered inside the unit by where they begin and end.
    """
    none, text = F.lit(0).cast("long"), lambda *parts: F.concat(*[
        F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])

    def lines(df: DataFrame, part: int, a, b, c: int, line) -> DataFrame:
        return df.select("unit", F.lit(part).alias("part"), a.cast("long").alias("a"), b.cast("long").alias("b"),
                         F.lit(c).alias("c"), line.alias("line"))

    units, col = nodes.select("unit").distinct(), F.col
    out = [
        lines(units, 0, none, none, 0, text("digraph u", col("unit"), " {")),
        lines(nodes, 1, col("node"), F.lit(-1), 0, text(col("node"), ' [shape=box,label="Block ', col("node"), '"];')),
        lines(edges.select("unit", "src", "dst").distinct(), 1, col("src"), col("dst"), 0,
              text(col("src"), " -> ", col("dst"), ";"))]
    if exceptions is not None:
        out.append(lines(exceptions.select("unit", "src", "dst").distinct(), 1, col("src"), col("dst"), 1,
                         text(col("src"), " -> ", col("dst"), " [style=dotted];")))
    if ranges is not None:
        spot = ["from_idx", "to_idx", "handler_idx"]
        held = cut(ranges.select("unit", *spot, "handler", "block").distinct())
        spans = held.select("unit", *spot, "handler").distinct()
        number = cut(ranked(spans, ["unit"], spot, "i", F.floor(F.col("from_idx") / 65536)))
        last = F.lit(2**62)
        out += [
            lines(number, 2, col("i"), F.lit(-1), 0, text("subgraph cluster_ex_", col("i"), " {")),
            lines(number, 2, col("i"), F.lit(-1), 1, text('\tlabel="Exception range for Block ', col("handler"), ' ";')),
            lines(held.join(number, ["unit", *spot, "handler"]), 2, col("i"), col("block"), 0, text("\t", col("block"), ";")),
            lines(number, 2, col("i"), last, 0, text("\t}"))]
    out.append(lines(units, 3, none, none, 0, text("}")))
    return iterate._union(out)


def audit(nodes: DataFrame, successors: DataFrame, predecessors: DataFrame,
          expressions: DataFrame) -> DataFrame:
    """Integrity violations: (unit, rule, a, b).

    ``successors`` and ``predecessors`` list the same edges (unit, src, dst)
    as seen from either end; ``expressions(unit, node, expr)`` places rows.
    """
    def rule(df: DataFrame, name: str, a: str, b: str) -> DataFrame:
        return df.select("unit", F.lit(name).alias("rule"), F.col(a).cast("long").alias("a"),
                         F.col(b).cast("long").alias("b"))

    ends = lambda c: nodes.select("unit", F.col("node").alias(c))
    both = successors.select("unit", "src", "dst").distinct()
    back = predecessors.select("unit", "src", "dst").distinct()
    found = rule(both.join(ends("src"), ["unit", "src"], "left_anti"), "source missing", "src", "dst")
    found = found.unionByName(
        rule(both.join(ends("dst"), ["unit", "dst"], "left_anti"), "target missing", "src", "dst"))
    found = found.unionByName(
        rule(both.join(back, ["unit", "src", "dst"], "left_anti"), "not seen from target", "src", "dst"))
    found = found.unionByName(
        rule(back.join(both, ["unit", "src", "dst"], "left_anti"), "not seen from source", "src", "dst"))
    dead = unreachable(nodes, both)
    found = found.unionByName(rule(dead, "unreachable", "node", "node"))
    twice = (
        expressions.select("unit", "node", "expr").distinct().groupBy("unit", "expr")
        .agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b"))
    return found.unionByName(rule(twice, "expression in two nodes", "a", "b"))
