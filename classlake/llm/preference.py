"""Preference pairs for chat training: a shared prompt and two masked completions.

Input are the turns of a chosen and a rejected conversation for each pair.  The
longest common prefix of turns (equal role and text) ends before the first place
where the sides differ: that place is an aggregate over a join by place, so turns are
never compared in a loop.  The prefix is rendered once; what follows is rendered for
each side, with the spans to train on: the text and end mark of assistant turns.
Spans are code points in the completion, the end exclusive.

All of it is DataFrame work.  Turns are numbered by a window over one conversation,
which streams; a pair's texts are put together in one row, as they are one value.

Defined results: a null role or text is empty; turns without a pair id are left out;
turns of one number are ordered by role, then text, and all kept; equal sides give
empty completions; a side without turns gives an empty prompt and completion; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Marks around a turn.
START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def numbered(turns: DataFrame, pair: str = "pair_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """(pair_id, at, role, text): the turns of one side by their place from 0."""
    rows = turns.select(
        F.col(pair).alias("pair_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).filter("pair_id is not null")
    order = Window.partitionBy("pair_id").orderBy("turn", "role", "text")
    return rows.withColumn("at", F.row_number().over(order) - 1).drop("turn")


def _completion(rest: DataFrame, side: str) -> DataFrame:
    head = F.concat(F.lit(START), "role", F.lit("\n"))
    body = F.concat("text", F.lit(END))
    size = F.length(head) + F.length(body) + 1
    before = Window.partitionBy("pair_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rest.withColumn("from", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length(head))
    span = F.when(F.col("role") == TRAINED, F.concat_ws(
        "-", F.col("from").cast("string"), (F.col("from") + F.length(body)).cast("string")))
    piece = F.struct("at", F.concat(head, body, F.lit("\n")).alias("t"), span.alias("s"))
    got = F.array_sort(F.collect_list(piece))
    return rows.groupBy("pair_id").agg(got.alias("p")).select(
        "pair_id", F.array_join("p.t", "").alias(side), F.array_join("p.s", ",").alias(f"{side}_spans"))


def preference_pairs(chosen: DataFrame, rejected: DataFrame, **columns: str) -> DataFrame:
    """Per pair: pair_id, n_common, prompt, chosen, chosen_spans, rejected, rejected_spans."""
    a, b = numbered(chosen, **columns), numbered(rejected, **columns)
    both = a.join(b.select("pair_id", "at", F.col("role").alias("r"), F.col("text").alias("t")), ["pair_id", "at"], "full")
    same = F.col("role").eqNullSafe(F.col("r")) & F.col("text").eqNullSafe(F.col("t"))
    common = both.groupBy("pair_id").agg(
        F.coalesce(F.min(F.when(~same, F.col("at"))), F.max("at") + 1).cast("long").alias("n_common"))
    head = F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END + "\n"))
    prompt = a.join(common, "pair_id").filter("at < n_common").groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.struct("at", head.alias("t")))).alias("p")).select(
        "pair_id", F.array_join("p.t", "").alias("prompt"))
    out = common.join(prompt, "pair_id", "left")
    for side, rows in (("chosen", a), ("rejected", b)):
        rest = rows.join(common, "pair_id").filter("at >= n_common").drop("n_common")
        out = out.join(_completion(rest, side), "pair_id", "left")
    texts = ["prompt", "chosen", "chosen_spans", "rejected", "rejected_spans"]
    return out.select("pair_id", "n_common", *[F.coalesce(c, F.lit("")).alias(c) for c in texts])


def contrasted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
               text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) turns for conversations that have no rejected side of their own.

    Conversations 2k and 2k + 1 are partners.  The rejected side is the conversation up to its last assistant turn,
    which is answered with the partner's last assistant turn; without one the turn is missing.  Conversations without
    an assistant turn are left out.
    """
    rows = turns.select(F.col(conv).cast("long").alias("pair_id"), F.col(turn).cast("long").alias("turn"),
                        F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    last = rows.filter((F.col("role") == TRAINED) & F.col("turn").isNotNull()).groupBy("pair_id").agg(
        F.max(F.struct("turn", "text")).alias("l")).select("pair_id", F.col("l.turn").alias("end"), F.col("l.text").alias("answer"))
    chosen = rows.join(last.select("pair_id", "end"), "pair_id").filter("turn <= end").drop("end")
    partner = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("answer").alias("text"))
    changed = last.select("pair_id", "end").join(partner, "pair_id").select(
        "pair_id", F.col("end").alias("turn"), F.lit(TRAINED).alias("role"), "text")
    kept = rows.join(last.select("pair_id", "end"), "pair_id").filter("turn < end").drop("end")
    return chosen, kept.unionByName(changed)
