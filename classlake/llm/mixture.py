"""Mixing sources to target weights over a domain - language - source tree.

A budget of tokens goes down the tree.  At each node the children share it by their
weights; a child whose documents cannot fill its share (its tokens times
``max_epochs``) takes what it has, and its siblings share the rest, again by weight.
What all children of a node together cannot take is never given to the node: its
capacity is theirs, so it falls to the node's own siblings, then to its parent's.

A leaf's share is met by whole epochs and, in one more epoch, the longest prefix of
its documents in that epoch's seeded order that fits.  The order is a hash of seed,
epoch and doc_id.  Its first characters put the documents into ``16 ** DIGITS``
parts whose token sums are added up first; documents of parts before the cut are in,
behind it out, and only the part with the cut is sorted, so that a leaf with a third
of all rows is never sorted in one task.

All of it is DataFrame work: no Python runs on rows.

Defined results: a null text has no token; documents without a token are never
taken; a null domain, language or source is the child named ``none``; a child whose
name has no weight gets the weight of ``other``, or 1; weights are integers, 0
leaves a child out; ties in the order go to the fewer tokens, and rows that are
equal in that as well are taken one by one; an empty table gives no rows; columns
beside those named in the result do not appear in :func:`choose` and are all kept,
with ``times``, by :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from classlake.llm.shared import written

SEED = 17
DIGITS = 3
SMALL = 100_000  # leaves up to here are broadcast

LEVELS = ("domain", "lang", "source")
#: Tokens: runs of anything but blank, tab, line feed and carriage return.
TOKEN = r"[^ \t\n\r]+"


def _weight(name: str, weights: dict[str, int]) -> F.Column:
    out = F.lit(weights.get("other", 1))
    for k, v in weights.items():
        out = F.when(F.col(name) == k, v).otherwise(out)
    return out.cast("long")


def share(nodes: DataFrame, parent: list[str], name: str, weights: dict[str, int]) -> DataFrame:
    """Adds ``given`` to (parent..., name, capacity, budget): the parent's budget by weight, shortages to siblings."""
    ratio = F.col("capacity") / F.col("w")
    order = Window.partitionBy(*parent).orderBy("ratio", name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    # children in the order in which they run dry; the level is highest at the first that does not
    rows = nodes.withColumn("w", _weight(name, weights)).filter("w > 0 and capacity > 0").withColumn("ratio", ratio)
    level = (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))) / F.sum("w").over(after)
    rows = rows.withColumn("level", level)
    top = F.max("level").over(Window.partitionBy(*parent))
    return rows.withColumn("given", F.least(F.col("capacity"), F.floor(F.col("w") * top)).cast("long")).drop(
        "ratio", "level", "w")


def budgets(leaves: DataFrame, share_of_tokens: float, weights: dict[str, dict[str, int]], max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, given) from (domain, lang, source, tokens)."""
    cap = F.sum("tokens") * max_epochs
    # one row for each domain: the total is a window over those few rows
    total = F.sum("t").over(Window.partitionBy("root"))
    tops = leaves.groupBy("domain").agg(F.sum("tokens").alias("t"), F.lit(0).alias("root")).select(
        "domain", "root", (F.col("t") * max_epochs).alias("capacity"),
        F.floor(total * F.lit(share_of_tokens)).cast("long").alias("budget"))
    first = share(tops, ["root"], "domain", weights.get("domain", {}))
    langs = leaves.groupBy("domain", "lang").agg(cap.alias("capacity"))
    second = share(langs.join(first.select("domain", F.col("given").alias("budget")), "domain"),
                   ["domain"], "lang", weights.get("lang", {}))
    ends = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    third = share(ends.join(second.select("domain", "lang", F.col("given").alias("budget")), ["domain", "lang"]),
                  ["domain", "lang"], "source", weights.get("source", {}))
    return third.select(*LEVELS, "tokens", "given")


def mix(docs: DataFrame, domain: F.Column, weights: dict[str, dict[str, int]], share_of_tokens: float,
        max_epochs: int = 2, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        source: str = "source") -> DataFrame:
    """All columns of ``docs`` as ``row``, and domain, lang, source, n_tokens, times (epochs that hold the row)."""
    child = [F.coalesce(c.cast("string"), F.lit("none")).alias(n) for c, n in zip(
        (domain, F.col(lang), F.col(source)), LEVELS, strict=True)]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *child, F.col(doc_id).cast("string").alias("id"),
        F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(TOKEN)), F.lit(0)).cast("long").alias("n_tokens"),
    ).filter("n_tokens > 0")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    plan = budgets(leaves, share_of_tokens, weights, max_epochs).withColumn(
        "full", F.floor(F.col("given") / F.col("tokens")).cast("long")).withColumn(
        "left", F.col("given") - F.col("full") * F.col("tokens")).drop("tokens", "given")

    def placed(plan: DataFrame, rows: DataFrame = rows) -> DataFrame:
        key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce("id", F.lit(""))))
        return rows.join(plan, list(LEVELS)).withColumn("key", key).withColumn("part", F.substring("key", 1, DIGITS))

    plan = _few(plan)
    sums = placed(plan).groupBy(*LEVELS, "left", "part").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("part"))
    # the first part that does not fit as a whole; null if all fit
    cut = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("left")).groupBy(*LEVELS).agg(
        F.min(F.struct("part", F.col("upto").alias("_upto"), "n")).alias("c")).select(
        *LEVELS, F.col("c.part").alias("cut"), (F.col("c._upto") - F.col("c.n")).alias("used"))
    ready = placed(_few(plan.join(cut, list(LEVELS), "left")))
    whole = ready.filter("cut is null or part <> cut").withColumn(
        "times", F.col("full") + F.when(F.col("cut").isNull() | (F.col("part") < F.col("cut")), 1).otherwise(0))
    order = Window.partitionBy(*LEVELS).orderBy("key", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    at = ready.filter("part = cut").withColumn("sum", F.col("used") + F.sum("n_tokens").over(order)).withColumn(
        "times", F.col("full") + F.when(F.col("sum") <= F.col("left"), 1).otherwise(0)).drop("sum")
    return whole.unionByName(at).filter("times > 0").select("row", *LEVELS, "n_tokens", "times")


def _few(plan: DataFrame) -> DataFrame:
    """The leaves, read back from the shared folder; broadcast if their number is small."""
    plan = written(plan)
    return F.broadcast(plan) if plan.count() <= SMALL else plan


def choose(docs: DataFrame, domain: F.Column, weights: dict[str, dict[str, int]], share_of_tokens: float,
           max_epochs: int = 2, seed: int = SEED, doc_id: str = "doc_id", **columns: str) -> DataFrame:
    """Per chosen document row: doc_id, domain, lang, source, n_tokens, times."""
    return mix(docs, domain, weights, share_of_tokens, max_epochs, seed, doc_id, **columns).select(
        F.col(f"row.`{doc_id}`").alias("doc_id"), *LEVELS, "n_tokens", F.col("times").cast("long").alias("times"))
