"""Duplicate regions, imports, append chains, parameter agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classlake.iterate import cut, fixpoint
from classlake.operators.ranges import SPAN, members
from classlake.scan import first_by, running_sum


def normalised(blocks: DataFrame) -> DataFrame:
    """Instructions with position and renumbered slot: (unit, block, pos, op, nslot).

    Slots count by first use in the block; instructions without a slot have -1.
    The ranking sees one row per slot of a block, a number the format bounds.
    """
    from pyspark.sql.window import Window

    start = blocks.groupBy("unit", "block").agg(F.min("idx").alias("_lo"))
    uses = blocks.filter("op in ('store', 'load')").groupBy("unit", "block", "slot").agg(F.min("idx").alias("_at"))
    order = Window.partitionBy("unit", "block").orderBy("_at")
    numbers = uses.withColumn("nslot", F.dense_rank().over(order)).drop("_at")
    slotted = F.col("op").isin("store", "load")
    return (
        blocks.join(start, ["unit", "block"])
        .join(numbers.withColumn("_s", F.lit(True)), ["unit", "block", "slot"], "left")
        .select("unit", "block", (F.col("idx") - F.col("_lo")).alias("pos"), "op",
                F.when(slotted, F.col("nslot")).otherwise(-1).cast("long").alias("nslot")))


def fingerprints(rows: DataFrame) -> DataFrame:
    """(unit, block, size, h1, h2): order-aware sums of row hashes.

    Position is part of each row's hash, so the sum stands for the sequence
    and a block of any length is combined before the shuffle instead of being
    collected.
    """
    mod = F.lit(1 << 40)
    h1 = F.pmod(F.xxhash64("pos", "op", "nslot"), mod)
    h2 = F.pmod(F.xxhash64(F.lit("second"), "nslot", "pos", "op"), mod)
    return rows.groupBy("unit", "block").agg(
        F.count(F.lit(1)).alias("size"), F.sum(h1).alias("h1"), F.sum(h2).alias("h2"))


def duplicate_blocks(rows: DataFrame) -> DataFrame:
    """Blocks equal to another one: (unit, block, size, copies, rep_unit, rep_block).

    The least block of a group stands for it; members are checked against it
    row by row, so a chance hash match never reports a copy.
    """
    marks = cut(fingerprints(rows))
    key = ["size", "h1", "h2"]
    groups = marks.groupBy(*key).agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("unit", "block")).alias("r")).filter("copies > 1")
    found = marks.join(groups, key).select(
        "unit", "block", "size", "copies", F.col("r.unit").alias("rep_unit"), F.col("r.block").alias("rep_block"))
    found = cut(found)
    mine = found.join(rows, ["unit", "block"])
    theirs = rows.join(
        found.select(F.col("rep_unit").alias("unit"), F.col("rep_block").alias("block")).distinct(),
        ["unit", "block"], "left_semi").select(
        F.col("unit").alias("rep_unit"), F.col("block").alias("rep_block"), "pos",
        F.col("op").alias("_op"), F.col("nslot").alias("_slot"))
    differs = (
        mine.join(theirs, ["rep_unit", "rep_block", "pos"], "left")
        .filter("_op is null or op <> _op or nslot <> _slot").select("unit", "block").distinct())
    return found.join(differs, ["unit", "block"], "left_anti")


def block_classes(blocks: DataFrame) -> DataFrame:
    """(unit, node, cls): blocks have one class if and only if their normalised instructions are equal."""
    alike = duplicate_blocks(cut(normalised(blocks))).select(
        "unit", F.col("block").alias("node"), F.struct("rep_unit", "rep_block").alias("_rep"))
    nodes = blocks.select("unit", F.col("block").alias("node")).distinct()
    return nodes.join(alike, ["unit", "node"], "left").select(
        "unit", "node", F.coalesce("_rep", F.struct(F.col("unit").alias("rep_unit"), F.col("node").alias("rep_block"))).alias("cls"))


def successors(blocks: DataFrame, edges: DataFrame, ranges: DataFrame) -> DataFrame:
    """All successors with their place: (unit, src, place, dst).

    Regular ones are placed by ``ord``; exception ones by their handler's first
    range over the block, with the set of types.
    """
    from pyspark.sql.window import Window

    at = blocks.select("unit", F.col("idx").alias("handler_idx"), F.col("block").alias("dst"))
    typed = ranges.select(*SPAN, F.coalesce("exc_type", F.lit("")).alias("exc_type")).distinct()
    caught = (
        members(blocks, ranges).withColumnRenamed("block", "src").join(at, ["unit", "handler_idx"]).join(typed, SPAN)
        .groupBy("unit", "src", "dst").agg(
            F.min(F.struct("from_idx", "to_idx", "handler_idx")).alias("_at"),
            F.array_join(F.array_sort(F.collect_set("exc_type")), ",").alias("_types")))
    rank = F.row_number().over(Window.partitionBy("unit", "src").orderBy("_at"))
    return edges.select("unit", "src", F.concat(F.lit("r"), F.col("ord").cast("string")).alias("place"), "dst").unionByName(
        caught.select("unit", "src", F.concat(F.lit("e"), rank.cast("string"), F.lit(":"), "_types").alias("place"), "dst")
    ).distinct()


def equal_subgraphs(classes: DataFrame, outs: DataFrame) -> DataFrame:
    """Blocks whose whole subgraph equals that of another block of the unit: (unit, a, b), a the least such block.

    Blocks are equal if their ``classes(unit, node, cls)`` are, their successors
    ``outs(unit, src, place, dst)`` have equal places, and successors in one
    place are equal again.  Classes are refined by the places and classes of
    successors until their number is stable; there is no list of pairs.  Equal
    blocks are never parted.  A chance hash match could only join unequal ones:
    members are checked against the least block of their class, and refined
    anew with other hashes if one differs.
    """
    nodes = cut(classes.select("unit", "node", "cls"))
    outs = cut(outs.select("unit", "src", "place", "dst").distinct())
    mod, salt = F.lit(1 << 40), 0
    while True:
        labels = cut(nodes.select("unit", "node", F.xxhash64(F.lit(salt), "cls").alias("l1"), F.xxhash64(F.lit(~salt), "cls").alias("l2")))
        number = 0
        while True:
            for _ in range(3):
                ahead = labels.withColumnRenamed("node", "dst")
                following = outs.join(ahead, ["unit", "dst"], "left").groupBy("unit", F.col("src").alias("node")).agg(
                    F.count(F.lit(1)).alias("_n"),
                    F.sum(F.pmod(F.xxhash64(F.lit(salt), "place", "l1", "l2"), mod)).alias("_s1"),
                    F.sum(F.pmod(F.xxhash64("l2", F.lit(salt), "l1", "place"), mod)).alias("_s2"))
                labels = labels.join(following, ["unit", "node"], "left").select(
                    "unit", "node", F.xxhash64("l1", "_n", "_s1", "_s2").alias("l1"), F.xxhash64("_s2", "_n", "l2", "_s1").alias("l2"))
            labels = cut(labels)
            before, number = number, labels.select("unit", "l1", "l2").distinct().count()
            if number == before:
                break
        least = labels.groupBy("unit", "l1", "l2").agg(F.min("node").alias("a"))
        members_of = cut(labels.join(least, ["unit", "l1", "l2"]).select("unit", "node", "a"))
        found = cut(members_of.filter("node <> a").select("unit", "a", F.col("node").alias("b")))
        own = nodes.select("unit", "node", "cls")
        unlike = (
            found.join(own.withColumnsRenamed({"node": "a", "cls": "_ca"}), ["unit", "a"])
            .join(own.withColumnsRenamed({"node": "b", "cls": "_cb"}), ["unit", "b"]).filter(~F.col("_ca").eqNullSafe(F.col("_cb"))))
        classed = outs.join(members_of.withColumnsRenamed({"node": "dst", "a": "to"}), ["unit", "dst"], "left").groupBy(
            "unit", "src", "place", "to").agg(F.count(F.lit(1)).alias("n"))
        of_a = found.join(classed.withColumnRenamed("src", "a"), ["unit", "a"])
        of_b = found.join(classed.withColumnRenamed("src", "b"), ["unit", "b"])
        lone = of_a.select(*of_b.columns).exceptAll(of_b).unionByName(of_b.exceptAll(of_a.select(*of_b.columns)))
        if unlike.select("unit").unionByName(lone.select("unit")).isEmpty():
            return found
        salt += 1


def local_slots(blocks: DataFrame) -> DataFrame:
    """(unit, node, nslot, slot): the slot behind each number of :func:`normalised`."""
    from pyspark.sql.window import Window

    uses = blocks.filter("op in ('store', 'load')").groupBy("unit", F.col("block").alias("node"), "slot").agg(F.min("idx").alias("_at"))
    return uses.select("unit", "node", F.row_number().over(Window.partitionBy("unit", "node").orderBy("_at")).alias("nslot"), "slot")


def analogous_subgraphs(found: DataFrame, outs: DataFrame, slots: DataFrame) -> DataFrame:
    """Equal subgraphs whose slots correspond one to one throughout: (unit, a, b), a the least such block.

    ``found(unit, a, b)`` are equal subgraphs by :func:`equal_subgraphs`, whose
    blocks agree in slots only inside each block; ``slots(unit, node, nslot,
    slot)`` tells the slots behind the numbers.  A class's blocks are walked in
    step with its least one, place by place; a pair fails if the walk maps a
    slot to two, or two to one.  Composition keeps such maps one to one, so
    being analogous is an equivalence: what fails forms a class of its own, and
    is walked with its least block in the next round.  Each round settles a
    block of every class.
    """
    outs = cut(outs.select("unit", "src", "place", "dst").distinct())
    slots = cut(slots)
    cls = F.col("a").alias("cls")
    pending = cut(
        found.select("unit", cls, F.col("b").alias("node"))
        .unionByName(found.select("unit", cls, F.col("a").alias("node")).distinct()))
    settled: list[DataFrame] = []

    def step(f: DataFrame) -> DataFrame:
        of = lambda c: outs.select("unit", F.col("src").alias(c), "place", F.col("dst").alias("_" + c))
        return f.join(of("x"), ["unit", "x"]).join(of("y"), ["unit", "y", "place"]).select(
            "unit", "a", "b", F.col("_x").alias("x"), F.col("_y").alias("y"))

    while True:
        least = pending.groupBy("unit", "cls").agg(F.min("node").alias("a"))
        pairs = cut(
            pending.join(least, ["unit", "cls"]).filter("node <> a").select("unit", "cls", "a", F.col("node").alias("b")))
        if pairs.isEmpty():
            break
        walk = fixpoint(pairs.select("unit", "a", "b", F.col("a").alias("x"), F.col("b").alias("y")), step)
        side = lambda c, s: slots.select("unit", F.col("node").alias(c), "nslot", F.col("slot").alias(s))
        maps = cut(
            walk.join(side("x", "s"), ["unit", "x"]).join(side("y", "t"), ["unit", "y", "nslot"])
            .select("unit", "a", "b", "s", "t").distinct())
        pair = ["unit", "a", "b"]
        twice = lambda c: maps.groupBy(*pair, c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*pair)
        failed = cut(twice("s").unionByName(twice("t")).distinct())
        settled.append(pairs.join(failed, pair, "left_anti").select(*pair))
        pending = cut(pairs.join(failed, pair, "left_semi").select("unit", "cls", F.col("b").alias("node")))
    if not settled:
        return found.select("unit", "a", "b").limit(0)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


# ---------------------------------------------------------------- imports


def simple_names(uses: DataFrame) -> DataFrame:
    """First package per (class, simple): the one that may be named shortly.

    ``uses(class, package, simple, ord)``.
    """
    return first_by(uses.select("class", "simple", "ord", "package"), ["class", "simple"], ["ord", "package"]).select(
        "class", "simple", "package")


def import_table(uses: DataFrame, own: DataFrame, lang: str, hidden: DataFrame | None = None) -> DataFrame:
    """Import lines (class, package, simple) in order of package and simple name.

    Dropped: the empty package, ``lang``, the class's own package
    (``own(class, own_package)``) and names marked as not imported.
    """
    kept = simple_names(uses).filter((F.col("package") != "") & (F.col("package") != lang)).join(own, "class", "left")
    kept = kept.filter("own_package is null or package <> own_package").select("class", "package", "simple")
    if hidden is not None:
        kept = kept.join(hidden.select("class", "simple"), ["class", "simple"], "left_anti")
    return kept.orderBy("class", "package", "simple")


def qualified_uses(uses: DataFrame) -> DataFrame:
    """Uses (class, package, simple) whose simple name belongs to another package."""
    mine = simple_names(uses).withColumnRenamed("package", "_first")
    return uses.join(mine, ["class", "simple"]).filter("package <> _first").select(
        "class", "package", "simple").distinct()


# ---------------------------------------------------------------- chains and lists


def append_chains(rows: DataFrame, start: str, operand: str, end: str) -> DataFrame:
    """Operands between a chain start and its end, in order: (unit, chain, pos, value).

    ``rows(unit, idx, op, value)``.  A chain is a start followed by operands
    only and closed by an end; anything else breaks it.  Chains are numbered
    by a running count of breaks, operands stay one row each.
    """
    breaks = F.when(F.col("op") == operand, 0).otherwise(1)
    numbered = running_sum(rows, ["unit"], "idx", breaks, "_island")
    first = numbered.filter(F.col("op") != operand).select("unit", "_island", F.col("idx").alias("chain"), F.col("op").alias("_op"))
    opened = first.filter(F.col("_op") == start).select("unit", "_island", "chain")
    closed = first.filter(F.col("_op") == end).select("unit", (F.col("_island") - 1).alias("_island"))
    good = opened.join(closed, ["unit", "_island"], "left_semi")
    return (
        numbered.filter(F.col("op") == operand).join(good, ["unit", "_island"])
        .select("unit", "chain", (F.col("idx") - F.col("chain")).alias("pos"), "value"))


def agreeing_positions(lists: DataFrame, group: str) -> DataFrame:
    """The first list of each group with disagreeing positions set to null.

    ``lists(group, list, pos, size, value)``.  Positions after the first are
    aligned from the end; the first one is compared with the other firsts.
    """
    at = F.when(F.col("pos") == 0, -1).otherwise(F.col("size") - F.col("pos")).cast("long")
    rows = lists.withColumn("_at", at)
    total = lists.select(group, "list").distinct().groupBy(group).agg(
        F.count(F.lit(1)).alias("_lists"), F.min("list").alias("list"))
    state = rows.groupBy(group, "_at").agg(
        F.count(F.lit(1)).alias("_n"), F.min("value").alias("_lo"), F.max("value").alias("_hi"),
        F.count("value").alias("_filled"))
    first = rows.join(total, [group, "list"]).join(state, [group, "_at"])
    alike = (F.col("_n") == F.col("_lists")) & (
        (F.col("_filled") == 0) | ((F.col("_filled") == F.col("_n")) & (F.col("_lo") == F.col("_hi"))))
    return first.select(group, "pos", F.when(alike, F.col("value")).alias("value"))
