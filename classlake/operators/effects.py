"""Exception types: coverage, ordering, propagation over calls.

``closed(node, anc)`` is the reflexive closure of the exception type tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classlake.iterate import cut, fixpoint


def is_checked(types: DataFrame, closed: DataFrame, roots: list[str], unchecked: list[str]) -> DataFrame:
    """``types(exc)`` with ``checked``.

    Not below an unchecked root; a type not known to be throwable (below one
    of ``roots``) is judged by hierarchy when it has one, else by its name.
    """
    known = closed.groupBy(F.col("node").alias("exc")).agg(
        F.max(F.col("anc").isin(unchecked)).alias("_un"), F.max(F.col("anc").isin(roots)).alias("_th"))
    simple = F.substring_index("exc", "/", -1)
    by_name = ~simple.endswith("RuntimeException") & ~simple.endswith("Error") & simple.endswith("Exception")
    return (
        types.select("exc").distinct().join(known, "exc", "left")
        .select("exc", F.when(F.col("_un"), False).otherwise(F.coalesce("_th", by_name)).alias("checked")))


def covered(rows: DataFrame, declared: DataFrame, closed: DataFrame) -> DataFrame:
    """Rows (node, exc) with a declared type at or above: ``declared(node, exc)``."""
    up = closed.select(F.col("node").alias("exc"), "anc")
    held = declared.select("node", F.col("exc").alias("anc"))
    return rows.join(up, "exc").join(held, ["node", "anc"], "left_semi").select(rows.columns).distinct()


def shadowed(catches: DataFrame, closed: DataFrame) -> DataFrame:
    """Catches (site, ord, exc) that an earlier catch of the site already covers."""
    first = catches.groupBy("site", F.col("exc").alias("anc")).agg(F.min("ord").alias("_first"))
    up = closed.select(F.col("node").alias("exc"), "anc")
    return (
        catches.join(up, "exc").join(first, ["site", "anc"]).filter("_first < ord")
        .select("site", "ord", "exc").distinct())


def drop_redundant(rows: DataFrame, closed: DataFrame) -> DataFrame:
    """Rows (node, exc) without another type of the same node strictly above."""
    up = closed.filter("node <> anc").select(F.col("node").alias("exc"), "anc")
    held = rows.select("node", F.col("exc").alias("anc")).distinct()
    lower = rows.select("node", "exc").join(up, "exc").join(held, ["node", "anc"], "left_semi").select("node", "exc")
    return rows.join(lower.distinct(), ["node", "exc"], "left_anti")


def type_sets(rows: DataFrame) -> DataFrame:
    """(node, types): distinct types in order; made distinct before they meet."""
    return rows.select("node", "exc").distinct().groupBy("node").agg(
        F.array_sort(F.collect_list("exc")).alias("types"))


def specific_first(rows: DataFrame, closed: DataFrame) -> DataFrame:
    """``rows(node, exc, ord)`` with ``place``: repeatedly the first type that
    has no remaining subtype.  One pick per node and round."""
    left = cut(rows.groupBy("node", "exc").agg(F.min("ord").alias("ord")))
    below = cut(closed.filter("node <> anc").select(F.col("anc").alias("exc"), F.col("node").alias("_low")))
    parts = []
    place = 0
    while not left.isEmpty():
        lows = left.select("node", F.col("exc").alias("_low"))
        waits = left.join(below, "exc").join(lows, ["node", "_low"], "left_semi").select("node", "exc").distinct()
        pick = cut(
            left.join(waits, ["node", "exc"], "left_anti").groupBy("node")
            .agg(F.min_by(F.struct("exc", "ord"), F.struct("ord", "exc")).alias("p"))
            .select("node", "p.exc", "p.ord", F.lit(place).cast("long").alias("place")))
        parts.append(pick)
        left = cut(left.join(pick, ["node", "exc"], "left_anti"))
        place += 1
    if not parts:
        return left.withColumn("place", F.lit(0).cast("long"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def propagate(raised: DataFrame, calls: DataFrame, catches: DataFrame, closed: DataFrame,
              declared: DataFrame | None = None, limits: DataFrame | None = None,
              silent: DataFrame | None = None) -> DataFrame:
    """Exception types that escape each method beyond its declaration: (node, exc).

    ``raised(node, exc)`` are types a body or its handlers raise,
    ``calls(site, src, dst)`` call sites, ``catches(site, exc)`` the types
    caught around a site.  ``declared(node, exc)`` types are passed to callers
    and cover their subtypes.  ``limits(node, decl, exc)`` lists, per
    overridden declaration, what it allows (a null ``exc`` row keeps an empty
    declaration); a type must fit every one.  ``silent(node)`` methods infer
    nothing.  The state only grows, so no component order is needed.

    Whether a site catches a type, or a method admits it, is told from the
    type's own supertypes: a call carries the types caught around it, a method
    has one row of rules, and rows are distinct before they meet the rules.
    """
    above = cut(
        closed.select(F.col("node").alias("exc"), "anc").filter("exc is not null and anc is not null")
        .groupBy("exc").agg(F.collect_set("anc").alias("_up")))
    kind = dict(closed.dtypes)["anc"]
    lift = lambda df: df.join(above, "exc", "left").withColumn("_up", F.coalesce("_up", F.array().cast(f"array<{kind}>")))
    held = catches.filter("exc is not null").groupBy("site").agg(F.array_sort(F.collect_set("exc")).alias("_caught"))
    sites = cut(
        calls.select("site", "src", F.col("dst").alias("node")).distinct().join(held, "site", "left")
        .select("node", "src", "_caught").distinct())
    none = F.lit(None).cast(kind)
    rules = None

    def ruled(who: DataFrame, exc=none, decl=none, allows=none, bound: bool = False, silent: bool = False) -> DataFrame:
        rows = who.filter("node is not null").select(
            "node", exc.alias("_d"), decl.cast("string").alias("_decl"),
            F.when(allows.isNotNull(), F.struct(decl.cast("string").alias("decl"), allows.alias("exc"))).alias("_l"),
            F.lit(bound).alias("_bound"), F.lit(silent).alias("_silent"))
        return rows if rules is None else rules.unionByName(rows)

    if declared is not None:
        rules = ruled(declared, exc=F.col("exc"))
    if limits is not None:
        rules = ruled(limits, decl=F.col("decl"), allows=F.col("exc"), bound=True)
    if silent is not None:
        rules = ruled(silent, silent=True)
    if rules is not None:
        rules = cut(rules.groupBy("node").agg(
            F.collect_set("_d").alias("_d"), F.size(F.collect_set("_decl")).alias("_n"), F.collect_set("_l").alias("_l"),
            F.max("_bound").alias("_bound"), F.max("_silent").alias("_silent")))

    def admit(df: DataFrame) -> DataFrame:
        if rules is None:
            return df
        fits = F.filter("_l", lambda x: F.array_contains("_up", x["exc"]))
        decls = F.array_distinct(F.filter(F.transform(fits, lambda x: x["decl"]), lambda d: d.isNotNull()))
        return lift(df).join(rules, "node", "left").filter(
            F.col("_silent").isNull()
            | (~F.col("_silent") & ~F.arrays_overlap("_up", "_d")
               & (~F.col("_bound") | ((F.size(fits) > 0) & (F.size(decls) == F.col("_n")))))).select("node", "exc")

    def step(f: DataFrame) -> DataFrame:
        out = lift(f).join(sites, "node").filter("_caught is null or not arrays_overlap(_caught, _up)")
        return admit(out.select(F.col("src").alias("node"), "exc").distinct())

    seed = admit(raised.select("node", "exc").distinct())
    if declared is not None:
        seed = seed.unionByName(declared.select("node", "exc"))
    state = fixpoint(seed, step, hops=4)
    if declared is not None:
        state = state.join(declared.select("node", "exc"), ["node", "exc"], "left_anti")
    return state


def unknown_flags(calls: DataFrame, known: DataFrame, catches: DataFrame, broadest: list[str]) -> DataFrame:
    """Methods (node) with a call to an unknown callee that no catch of one of
    the broadest types surrounds."""
    lost = calls.join(known.select(F.col("node").alias("dst")), "dst", "left_anti")
    guarded = catches.filter(F.col("exc").isin(broadest)).select("site").distinct()
    return lost.join(guarded, "site", "left_anti").select(F.col("src").alias("node")).distinct()


def protected_flow(parts: DataFrame) -> DataFrame:
    """Types that leave a protected statement: (site, exc).

    ``parts(site, part, exc, kind)``: part ``body``, ``handler`` or ``final``;
    a ``finally`` adds its own flow to that of the body, any other catch-all
    (``kind = 'all'``) replaces the body's.
    """
    replaced = parts.filter("part = 'handler' and kind = 'all'").select("site").distinct()
    body = parts.filter("part = 'body'").join(replaced, "site", "left_anti")
    return body.unionByName(parts.filter("part <> 'body'")).filter("exc is not null").select("site", "exc").distinct()


