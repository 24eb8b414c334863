"""Protected ranges: membership, handlers, range repair.

ranges(unit, from_idx, to_idx, handler_idx, exc_type) are half-open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classlake import iterate
from classlake.iterate import cut
from classlake.operators.graph import dominated, entries_of
from classlake.scan import first_by, interval_join

SPAN = ["unit", "from_idx", "to_idx", "handler_idx"]


def merged_handlers(ranges: DataFrame) -> DataFrame:
    """One row per (from, to, handler) with its sorted set of types.

    Types are made distinct first, so only the few types of one span meet.
    """
    return (
        ranges.select(*SPAN, "exc_type").distinct().groupBy(*SPAN)
        .agg(F.array_sort(F.collect_set("exc_type")).alias("exc_types")))


def block_starts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("unit", "block").agg(F.min("idx").alias("idx"))


def members(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Blocks inside each range: (unit, from_idx, to_idx, handler_idx, block).

    Range bounds start blocks, so a block lies wholly inside or outside.
    """
    spans = ranges.select(*SPAN).distinct()
    return interval_join(block_starts(blocks), spans, ["unit"], "idx", "from_idx", "to_idx").select(
        *SPAN, "block")


def exception_edges(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """(unit, src, dst, exc_type): from each protected block to its handler block."""
    at = blocks.select("unit", F.col("idx").alias("handler_idx"), F.col("block").alias("dst"))
    typed = ranges.select(*SPAN, "exc_type").distinct()
    return (
        members(blocks, ranges).join(at, ["unit", "handler_idx"])
        .join(typed, SPAN)
        .select("unit", F.col("block").alias("src"), "dst", "exc_type").distinct())


def logical_ranges(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Ranges with one handler and one set of types taken together.

    (unit, handler_idx, types, from_idx, to_idx, block): one row per block and
    table entry.
    """
    kinds = merged_handlers(ranges).withColumn("types", F.array_join("exc_types", ",")).drop("exc_types")
    return members(blocks, ranges).join(kinds, SPAN)


def logical_summary(logical: DataFrame) -> DataFrame:
    """(unit, handler_idx, types, parts, blocks) per logical range."""
    return logical.groupBy("unit", "handler_idx", "types").agg(
        F.countDistinct("from_idx", "to_idx").alias("parts"),
        F.countDistinct("block").alias("blocks"))


def sets_equal(a: Column, b: Column) -> Column:
    """Order does not matter; sizes are compared first, duplicates counted."""
    return (F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0)


def range_entries(logical: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Entry blocks: (unit, handler_idx, types, block).

    A member with a regular predecessor outside, or the graph entry itself.
    """
    key = ["unit", "handler_idx", "types"]
    inside = cut(logical.select(*key, "block").distinct())
    src = inside.withColumnRenamed("block", "src")
    outer = (
        inside.join(edges.select("unit", "src", F.col("dst").alias("block")).distinct(), ["unit", "block"])
        .join(src, [*key, "src"], "left_anti").select(*key, "block"))
    first = inside.join(entries_of(nodes).withColumnRenamed("node", "block"), ["unit", "block"], "left_semi")
    return outer.unionByName(first.select(*key, "block")).distinct()


def malformed_ranges(entries: DataFrame) -> DataFrame:
    """Logical ranges with more than one entry."""
    return (
        entries.groupBy("unit", "handler_idx", "types").agg(F.count(F.lit(1)).alias("entries"))
        .filter("entries > 1"))


def merge_split(logical: DataFrame, nodes: DataFrame, edges: DataFrame, safe: DataFrame) -> DataFrame:
    """Connector blocks absorbed by split ranges: (unit, handler_idx, types, block).

    Only logical ranges of several table entries are touched.  A connected
    group of ``safe(unit, node)`` blocks outside the range is absorbed when
    every block has predecessors and successors, some lie outside the group,
    and all of those are protected (groups absorbed earlier never border on
    another one); the range then must have at most one entry.
    """
    key = ["unit", "handler_idx", "types"]
    inside = cut(logical.select(*key, "block").distinct())
    several = logical_summary(logical).filter("parts > 1").select(*key)
    flow = edges.select("unit", "src", "dst").distinct()
    # only connectors next to a member can be absorbed, so candidates are found
    # from the members outward and not as range x block pairs
    split = inside.join(several, key, "left_semi")
    ring = flow.unionByName(flow.select("unit", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    ring = cut(ring.join(safe.select("unit", F.col("node").alias("dst")), ["unit", "dst"], "left_semi"))
    step = ring.select("unit", F.col("src").alias("block"), F.col("dst").alias("_to"))
    blocked = inside.withColumnRenamed("block", "_to")

    def outward(f: DataFrame) -> DataFrame:
        return (f.join(step, ["unit", "block"]).join(blocked, [*key, "_to"], "left_anti")
                .select(*key, F.col("_to").alias("block")))

    near = cut(iterate.fixpoint(outward(split).distinct(), outward))
    links = (
        near.join(flow.select("unit", F.col("src").alias("block"), F.col("dst").alias("_to")), ["unit", "block"])
        .join(near.select(*key, F.col("block").alias("_to")), [*key, "_to"], "left_semi"))
    ident = lambda c: F.struct(*key, F.col(c).alias("block"))
    comp = iterate.components(
        links.select(ident("block").alias("a"), ident("_to").alias("b")), "a", "b",
        near.select(ident("block").alias("node")))
    comp = cut(comp.select("node.*", F.col("component.block").alias("group")))
    group = [*key, "group"]
    other = comp.select(*key, F.col("block").alias("_o"), F.col("group").alias("_g"))
    around = flow.select("unit", F.col("src").alias("block"), F.col("dst").alias("_o"), F.lit("out").alias("way"))
    around = around.unionByName(
        flow.select("unit", F.col("dst").alias("block"), F.col("src").alias("_o"), F.lit("in").alias("way")))
    beside = comp.join(around, ["unit", "block"], "left").join(other, [*key, "_o"], "left")
    held = inside.select(*key, F.col("block").alias("_o"), F.lit(1).alias("_held"))
    beside = beside.join(held, [*key, "_o"], "left").withColumn(
        "outer", F.col("_o").isNotNull() & (F.col("_g").isNull() | (F.col("_g") != F.col("group"))))
    ends = beside.groupBy(*group, "block").agg(
        F.coalesce(F.max(F.col("way") == "in"), F.lit(False)).alias("i"),
        F.coalesce(F.max(F.col("way") == "out"), F.lit(False)).alias("o"))
    closed = ends.groupBy(*group).agg(F.min(F.col("i") & F.col("o")).alias("closed"))
    sides = beside.groupBy(*group).agg(
        F.max(F.col("outer") & (F.col("way") == "in")).alias("i"),
        F.max(F.col("outer") & (F.col("way") == "out")).alias("o"),
        F.min(~F.col("outer") | F.col("_held").isNotNull()).alias("safe"))
    good = closed.join(sides, group).filter("closed and i and o and safe").select(*group)
    gained = cut(comp.join(good, group, "left_semi").select(*key, "block"))
    grown = inside.join(gained.select(*key).distinct(), key, "left_semi").unionByName(gained)
    entries = range_entries(grown, nodes, edges).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    wild = entries.filter("n > 1").select(*key)
    return gained.join(wild, key, "left_anti")


def circular_parts(blocks: DataFrame, ranges: DataFrame, edges: DataFrame, tree: DataFrame) -> DataFrame:
    """Blocks taken out of ranges that protect their own handler; ``tree`` is the dominator tree.

    (from_idx, to_idx, handler_idx, block): members reached from the handler
    through members it dominates, unless that is the whole of a larger range.
    """
    inside = cut(members(blocks, ranges))
    at = blocks.select("unit", F.col("idx").alias("handler_idx"), F.col("block").alias("hb"))
    held = inside.join(at, ["unit", "handler_idx"])
    allowed = cut(dominated(held, tree, "block", "hb"))
    seed = allowed.filter("block = hb").select(*SPAN, "block")
    step = edges.select("unit", F.col("src").alias("block"), F.col("dst").alias("_to")).distinct()
    ok = allowed.select(*SPAN, F.col("block").alias("_to"))
    found = iterate.fixpoint(
        seed,
        lambda f: f.join(step, ["unit", "block"]).join(ok, [*SPAN, "_to"], "left_semi")
        .select(*SPAN, F.col("_to").alias("block")))
    found = cut(found)
    size = inside.groupBy(*SPAN).agg(F.count(F.lit(1)).alias("_n"))
    taken = found.groupBy(*SPAN).agg(F.count(F.lit(1)).alias("_t"))
    fit = size.join(taken, SPAN).filter("_t < _n or _n = 1").select(*SPAN)
    return found.join(fit, SPAN, "left_semi")


def empty_ranges(inside: DataFrame, filled: DataFrame) -> DataFrame:
    """Ranges none of whose blocks holds a row: ``filled(unit, block)``."""
    kept = inside.join(filled, ["unit", "block"], "left_semi").select(*SPAN).distinct()
    return inside.select(*SPAN).distinct().join(kept, SPAN, "left_anti")


def inert_clones(instr: DataFrame, ranges: DataFrame, group: str, throwing: list[str]) -> DataFrame:
    """Ranges to drop from clone groups: they have rows, none of which can throw,
    while the group has several handlers and another range that can throw.
    """
    spans = ranges.select(*SPAN, group).distinct()
    rows = interval_join(instr, spans, ["unit"], "idx", "from_idx", "to_idx")
    state = rows.groupBy(*SPAN, group).agg(F.max(F.col("op").isin(throwing)).alias("can_throw"))
    groups = spans.join(state, [*SPAN, group], "left").groupBy("unit", group).agg(
        F.countDistinct("handler_idx").alias("_h"), F.max("can_throw").alias("_any"))
    live = groups.filter("_h >= 2 and _any").select("unit", group)
    return state.filter(~F.col("can_throw")).join(live, ["unit", group], "left_semi").select(*SPAN, group)


# ---------------------------------------------------------------- set operations over handlers


def all_edges(edges: DataFrame, exceptional: DataFrame) -> DataFrame:
    """Regular and exception edges as one list: (unit, src, dst, etype)."""
    return edges.select("unit", "src", "dst", F.lit("regular").alias("etype")).unionByName(
        exceptional.select("unit", "src", "dst", F.lit("exception").alias("etype"))).distinct()


def common_handlers(nodes: DataFrame, edges: DataFrame, exceptional: DataFrame) -> DataFrame:
    """Handlers shared by every neighbour of a node: (unit, node, handler)."""
    flow = edges.select("unit", "src", "dst").distinct()
    around = flow.select("unit", F.col("src").alias("node"), F.col("dst").alias("nb")).unionByName(
        flow.select("unit", F.col("dst").alias("node"), F.col("src").alias("nb"))).distinct()
    around = around.join(nodes, ["unit", "node"], "left_semi")
    size = around.groupBy("unit", "node").agg(F.count(F.lit(1)).alias("_n"))
    held = exceptional.select("unit", F.col("src").alias("nb"), F.col("dst").alias("handler")).distinct()
    shared = around.join(held, ["unit", "nb"]).groupBy("unit", "node", "handler").agg(
        F.count(F.lit(1)).alias("_k"))
    return shared.join(size, ["unit", "node"]).filter("_k = _n").select("unit", "node", "handler")


def split_pairs(pairs: DataFrame, inside: DataFrame) -> DataFrame:
    """Pairs (unit, src, dst) that do not lie in exactly the same ranges."""
    a = pairs.join(inside.withColumnRenamed("block", "src"), ["unit", "src"]).select("unit", "src", "dst", *SPAN[1:])
    b = pairs.join(inside.withColumnRenamed("block", "dst"), ["unit", "dst"]).select("unit", "src", "dst", *SPAN[1:])
    key = ["unit", "src", "dst", *SPAN[1:]]
    only = a.join(b, key, "left_anti").unionByName(b.join(a, key, "left_anti"))
    return only.select("unit", "src", "dst").distinct()


def overlapping_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (unit, src, dst) whose sets share an element: ``sets(unit, node, item)``."""
    a = sets.select("unit", F.col("node").alias("src"), "item")
    b = sets.select("unit", F.col("node").alias("dst"), "item")
    return (
        pairs.join(a, ["unit", "src"]).join(b, ["unit", "dst", "item"], "left_semi")
        .select("unit", "src", "dst").distinct())


def align_returns(returns: DataFrame, edges: DataFrame, exceptional: DataFrame) -> DataFrame:
    """Handler changes for return nodes: (unit, node, handler, change).

    A node gains handlers that all its predecessors have and loses those none
    of them has; the last block of a handler's range in node order is kept
    when the range would otherwise lose all its blocks.
    """
    preds = (
        edges.select("unit", F.col("dst").alias("node"), F.col("src").alias("p")).distinct()
        .join(returns, ["unit", "node"], "left_semi"))
    count = preds.groupBy("unit", "node").agg(F.count(F.lit(1)).alias("_n"))
    held = exceptional.select("unit", F.col("src").alias("node"), F.col("dst").alias("handler")).distinct()
    of_pred = preds.join(held.withColumnRenamed("node", "p"), ["unit", "p"]).groupBy(
        "unit", "node", "handler").agg(F.count(F.lit(1)).alias("_k"))
    gain = of_pred.join(count, ["unit", "node"]).filter("_k = _n").select("unit", "node", "handler").join(
        held, ["unit", "node", "handler"], "left_anti")
    lose = (
        held.join(count.select("unit", "node"), ["unit", "node"], "left_semi")
        .join(of_pred.select("unit", "node", "handler"), ["unit", "node", "handler"], "left_anti"))
    size = held.unionByName(gain).groupBy("unit", "handler").agg(F.count(F.lit(1)).alias("_all"))
    drop = lose.groupBy("unit", "handler").agg(F.count(F.lit(1)).alias("_gone"), F.max("node").alias("_last"))
    kept = size.join(drop, ["unit", "handler"]).filter("_all = _gone").select(
        "unit", "handler", F.col("_last").alias("node"))
    lose = lose.join(kept, ["unit", "handler", "node"], "left_anti")
    return gain.withColumn("change", F.lit("add")).unionByName(
        lose.select("unit", "node", "handler").withColumn("change", F.lit("drop")))


def first_type_set(handlers: DataFrame) -> DataFrame:
    """Whether each range catches the same types as the first range of its handler."""
    first = first_by(handlers, ["unit", "handler_idx"], ["from_idx", "to_idx"]).select(
        "unit", "handler_idx", F.col("exc_types").alias("_f"))
    return handlers.join(first, ["unit", "handler_idx"]).select(
        *SPAN, sets_equal(F.col("exc_types"), F.col("_f")).alias("same"))
