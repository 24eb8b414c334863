"""Instruction streams to basic blocks and block graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classlake.scan import running_sum

BLOCK_ENDS = ["jump", "goto", "return", "switch"]
NO_FALL_THROUGH = ["return", "goto", "switch"]


def leaders(instr: DataFrame, jumps: DataFrame, ranges: DataFrame) -> DataFrame:
    """Positions that start a block: (unit, idx).

    Position 0, jump targets, range starts, ends and handlers, and whatever
    follows an instruction that ends a block.
    """
    after = instr.filter(F.col("op").isin(BLOCK_ENDS)).select("unit", (F.col("idx") + 1).alias("idx"))
    bounds = ranges.select(
        "unit", F.explode(F.array("from_idx", "to_idx", "handler_idx")).alias("idx"))
    return (
        instr.filter("idx = 0").select("unit", "idx")
        .unionByName(after)
        .unionByName(bounds)
        .unionByName(jumps.select("unit", F.col("dest").alias("idx")))
        .distinct()
    )


def block_ids(instr: DataFrame, jumps: DataFrame, ranges: DataFrame) -> DataFrame:
    """Instructions with their 1-based block number."""
    flagged = instr.join(
        leaders(instr, jumps, ranges).withColumn("_lead", F.lit(1)), ["unit", "idx"], "left")
    return running_sum(flagged, ["unit"], "idx", F.coalesce("_lead", F.lit(0)), "block").drop("_lead")


def last_instructions(blocks: DataFrame) -> DataFrame:
    """The instruction that ends each block: (unit, block, idx, op)."""
    return (
        blocks.groupBy("unit", "block")
        .agg(F.max_by(F.struct("idx", "op"), "idx").alias("l"))
        .select("unit", "block", "l.idx", "l.op")
    )


def block_edges(blocks: DataFrame, jumps: DataFrame) -> DataFrame:
    """Successors of each block: jump target (ord 0) before fall-through (ord 1); the targets of a
    switch by the ``ord`` of ``jumps``, its default first, and no fall-through."""
    order = F.col("ord") if "ord" in jumps.columns else F.lit(0)
    last = last_instructions(blocks)
    at = blocks.select("unit", F.col("idx").alias("_at"), F.col("block").alias("dst"))
    jumped = (
        last.join(jumps.select("unit", "idx", F.col("dest").alias("_at"), order.alias("ord")), ["unit", "idx"])
        .join(at, ["unit", "_at"])
        .select("unit", F.col("block").alias("src"), "dst", "ord")
    )
    fallen = (
        last.filter(~F.col("op").isin(NO_FALL_THROUGH))
        .withColumn("_at", F.col("idx") + 1)
        .join(at, ["unit", "_at"])
        .select("unit", F.col("block").alias("src"), "dst", F.lit(1).alias("ord"))
    )
    return jumped.unionByName(fallen).distinct()


def nodes_of(blocks: DataFrame) -> DataFrame:
    """Block graph nodes: (unit, node)."""
    return blocks.select("unit", F.col("block").alias("node")).distinct()


def exit_edges(nodes: DataFrame, edges: DataFrame, exit_node: int = -1) -> DataFrame:
    """Edge from each node without a successor to one virtual exit per unit."""
    ends = edges.select("unit", F.col("src").alias("node")).distinct()
    return (
        nodes.join(ends, ["unit", "node"], "left_anti")
        .select("unit", F.col("node").alias("src"),
                F.lit(exit_node).cast("long").alias("dst"), F.lit(0).alias("ord"))
    )
