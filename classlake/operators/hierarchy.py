"""Type hierarchies: parents(node, parent, pos) with the superclass at position 0."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from classlake import iterate
from classlake.iterate import cut, cut_by


def closure(parents: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Reflexive supertypes: (node, anc).

    ``start(node)`` limits the closure to the types someone asks about.
    Cycles are harmless because known rows are never expanded again.
    """
    up = cut(parents.select(F.col("node").alias("anc"), F.col("parent").alias("_p")).distinct())
    seed = (parents.select("node").unionByName(parents.select(F.col("parent").alias("node")))
            if start is None else start.select("node")).distinct()
    return iterate.fixpoint(
        seed.select("node", F.col("node").alias("anc")),
        lambda f: f.join(up, "anc").select("node", F.col("_p").alias("anc")))


def ordered_supertypes(parents: DataFrame, start: DataFrame, breadth_first: bool = False) -> DataFrame:
    """One row for each class with its reflexive supertypes in visit order: (node, ancs).

    Depth first, a class's list is itself and then its parents' lists by ``pos``,
    each supertype at its first place; breadth first, supertypes fewer steps
    away come before.  Lists are built from the top of the hierarchy down and
    sent to the children alone, so a list is written once for each child.  On
    cycles, which have no top, paths are compared instead.
    """
    type_ = dict(parents.dtypes)["node"]
    up = cut(parents.select("node", "parent", F.col("pos").cast("int").alias("pos"))
             .filter("node is not null and parent is not null").distinct())
    asked = cut(iterate.fixpoint(
        start.select("node"), lambda f: f.join(up, "node").select(F.col("parent").alias("node"))))
    arcs = up.join(asked, "node", "left_semi")
    try:
        levels = cut(iterate.levels(arcs.select(F.col("parent").alias("src"), F.col("node").alias("dst")), asked))
    except ValueError:
        order = Window.partitionBy("node").orderBy("rank")
        lists = _ranked_paths(up, start, breadth_first).withColumn("_at", F.row_number().over(order)).groupBy("node").agg(
            F.array_sort(F.collect_list(F.struct("_at", "anc"))).alias("_l"))
        return lists.select("node", F.col("_l.anc").alias("ancs"))
    spark = parents.sparkSession
    base = f"{iterate.work_dir(spark)}/{uuid.uuid4().hex}"
    # a class sends its list to its children's levels, and to level -1 as the result if it is asked for
    child = cut(arcs.join(levels, "node").select(F.col("parent").alias("_p"), F.col("node").alias("_child"), "pos", "level").unionByName(
        start.select("node").distinct().select(F.col("node").alias("_p"), F.col("node").alias("_child"), F.lit(-1).alias("pos"), F.lit(-1).cast("long").alias("level"))))
    zeros = F.array(F.lit(0))
    sent = spark.createDataFrame([], f"node {type_}, pos int, parent {type_}, ancs array<{type_}>, lens array<int>").schema
    last = levels.agg(F.max("level")).first()[0]
    for level in range(0, -1 if last is None else int(last) + 1):
        if level == 0:
            done = levels.filter("level = 0").select("node", F.array("node").alias("ancs"), zeros.alias("lens"))
        else:
            parts = spark.read.schema(sent).parquet(f"{base}/level={level}").groupBy("node").agg(
                F.array_sort(F.collect_list(F.struct("pos", "parent", "ancs", "lens"))).alias("_l"))
            ancs = F.concat(F.array("node"), F.flatten("_l.ancs"))
            if breadth_first:
                far = F.concat(zeros, F.transform(F.flatten("_l.lens"), lambda n: n + 1))
                met = parts.select("node", F.array_sort(F.transform(
                    F.arrays_zip(ancs.alias("anc"), far.alias("far")),
                    lambda x, i: F.struct(x["far"].alias("far"), i.alias("at"), x["anc"].alias("anc")))).alias("_s"))
                done = met.select("node", "_s", F.array_distinct("_s.anc").alias("ancs")).select(
                    "node", "ancs", F.transform("ancs", lambda a: F.element_at(
                        F.col("_s.far"), F.array_position(F.col("_s.anc"), a).cast("int"))).alias("lens"))
            else:
                done = parts.select("node", F.array_distinct(ancs).alias("ancs"), F.array().cast("array<int>").alias("lens"))
        on = done.join(child, F.col("node").eqNullSafe(F.col("_p")) if level == 0 else F.col("node") == F.col("_p")).select(
            F.col("_child").alias("node"), "pos", F.col("_p").alias("parent"), "ancs", "lens", "level")
        with iterate.few_broadcasts(spark):
            on.write.mode("append").partitionBy("level").parquet(base)
    if last is None:
        return spark.createDataFrame([], sent).select("node", "ancs")
    return spark.read.schema(sent).parquet(f"{base}/level=-1").select("node", "ancs")


def ranked_closure(parents: DataFrame, start: DataFrame, breadth_first: bool = False) -> DataFrame:
    """Reflexive supertypes with visit order: (node, anc, rank).

    ``rank`` is the place among the node's supertypes, from 0 for itself,
    depth first or breadth first (see :func:`ordered_supertypes`).
    """
    return cut(ordered_supertypes(parents, start, breadth_first).select("node", F.posexplode("ancs").alias("rank", "anc"))
               .select("node", "anc", "rank"))


def _ranked_paths(parents: DataFrame, start: DataFrame, breadth_first: bool) -> DataFrame:
    """(node, anc, rank) by the least path of ordinals, shorter ones first where ``breadth_first``; cycles are harmless."""
    up = cut(parents.select(F.col("node").alias("anc"), F.col("parent").alias("_p"), F.col("pos").alias("_pos")))

    def rank(path):
        length = F.size(path) if breadth_first else F.lit(0)
        return F.struct(length.cast("int").alias("len"), path.alias("path"))

    seed = start.select("node").distinct().select(
        "node", F.col("node").alias("anc"), rank(F.array().cast("array<int>")).alias("rank"))
    return iterate.best_paths(
        seed,
        lambda f: f.join(up, "anc").select(
            "node", F.col("_p").alias("anc"),
            rank(F.concat(F.col("rank.path"), F.array("_pos"))).alias("rank")),
        ["node", "anc"], "rank")


def super_chain(parents: DataFrame, start: DataFrame) -> DataFrame:
    """The class and its superclasses only: (node, anc, depth)."""
    up = cut(parents.filter("pos = 0").select(F.col("node").alias("anc"), F.col("parent").alias("_p")))
    return iterate.fixpoint(
        start.select("node", F.col("node").alias("anc")).distinct(),
        lambda f: f.join(up, "anc").select("node", F.col("_p").alias("anc")),
        depth="depth")


def subtype_test(pairs: DataFrame, closed: DataFrame, known: DataFrame, root) -> DataFrame:
    """``pairs(a, b)`` with ``is_sub``: is a the same as or below b?

    Null is never below anything; an unknown class, or one without a
    superclass, still counts as below the root.
    """
    hit = closed.select(F.col("node").alias("a"), F.col("anc").alias("b"), F.lit(True).alias("_hit"))
    top = known.select(F.col("node").alias("a"), F.col("super").isNotNull().alias("_has"))
    return (
        pairs.join(hit, ["a", "b"], "left").join(top, "a", "left")
        .withColumn("is_sub", F.col("a").isNotNull() & F.col("b").isNotNull() & (
            F.coalesce("_hit", F.lit(False)) | (F.col("a") == F.col("b"))
            | ((F.col("b") == F.lit(root)) & ~F.coalesce("_has", F.lit(False)))))
        .withColumn("is_sub", F.coalesce("is_sub", F.lit(False)))
        .drop("_hit", "_has"))


def common_ancestor(pairs: DataFrame, ranked: DataFrame, root) -> DataFrame:
    """``pairs(a, b)`` with ``common``: the first supertype of a, depth first,
    that is also a supertype of b; the root counts only when it is a itself.
    """
    listed = cut(ranked.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rank", "anc"))).alias("_l")).select(
        "node", F.col("_l.anc").alias("_l")))
    # lists meet, not their elements: a pair stays one row
    mine = listed.select(F.col("node").alias("a"), F.filter("_l", lambda x: (x != F.lit(root)) | (x == F.col("node"))).alias("_a"))
    other = listed.select(F.col("node").alias("b"), F.col("_l").alias("_b"))
    return pairs.join(mine, "a", "left").join(other, "b", "left").select(
        *pairs.columns, F.get(F.array_intersect("_a", "_b"), F.lit(0)).alias("common"))


def inheritance_levels(parents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): longest way down from a type without parents."""
    return iterate.levels(
        parents.select(F.col("parent").alias("src"), F.col("node").alias("dst")), nodes)


def children_by_level(parents: DataFrame, levels: DataFrame) -> DataFrame:
    """(class, _child, pos, level, _at): arcs from parents to children with the child's level and the parent's, in folders by the latter.

    ``pos`` is the parent's first place where a class names it twice.
    """
    return cut_by(
        parents.groupBy(F.col("parent").alias("class"), F.col("node").alias("_child")).agg(F.min("pos").cast("int").alias("pos"))
        .join(levels.select(F.col("node").alias("_child"), "level"), "_child")
        .join(levels.select(F.col("node").alias("class"), F.col("level").alias("_at")), "class"), "_at")


def nested_forest(claims: DataFrame, roots: DataFrame) -> DataFrame:
    """Nested classes reached from root classes: (root, node, depth).

    ``claims(inner, encloser, recorded)``: an inner class is attached once,
    and only below the encloser it records itself.
    """
    agreed = cut(
        claims.filter("encloser = recorded").select(F.col("encloser").alias("node"), F.col("inner").alias("_i"))
        .distinct())
    seed = roots.select(F.col("node").alias("root"), "node")
    return iterate.fixpoint(
        seed,
        lambda f: f.join(agreed, "node").select("root", F.col("_i").alias("node")),
        depth="depth")


#: Bits of access flags.
PRIVATE, STATIC, FINAL, ABSTRACT, SYNTHETIC = 0x2, 0x8, 0x10, 0x400, 0x1000


def nested_classes(claims: DataFrame, roots: DataFrame) -> DataFrame:
    """Nested classes with their final kind and flags: (root, node, parent, depth, kind, flags, context).

    ``claims(inner, encloser, recorded, ord, kind, flags, anonymous_shape, named,
    outer_named)``: an inner class hangs below the encloser that it records
    itself, by the first claim (least ``ord``) that agrees.  ``roots(node, flags)``.

    Kinds: an ``anonymous`` class without the shape of one is ``local``; one that is
    used by name is ``member`` where its record names the outer class, and
    ``static`` then, else ``local``.  Flags: anonymous classes are not static, local
    ones at most abstract or final.

    ``context`` holds what enclosers hand down: ``PRIVATE`` and ``SYNTHETIC`` stay on
    once a class has them; ``STATIC`` says that there is no instance around, which
    static members start, other members end and local classes leave as it is.
    Each class's rule is a pair of masks; the rules along a chain are composed by
    doubling, so no chain is walked class by class.
    """
    agreed = claims.filter("inner <> encloser and encloser = recorded").join(
        roots.select(F.col("node").alias("inner")), "inner", "left_anti")
    payload = ["encloser", "kind", "flags", "anonymous_shape", "named", "outer_named"]
    first = agreed.groupBy("inner").agg(F.min_by(F.struct(*payload), F.struct("ord", "encloser")).alias("c")).select("inner", "c.*")
    shaped = F.when((F.col("kind") == "anonymous") & ~F.col("anonymous_shape"), "local").otherwise(F.col("kind"))
    promoted = (F.col("_k") == "anonymous") & F.col("named")
    kind = F.when(promoted & F.col("outer_named"), "member").when(promoted, "local").otherwise(F.col("_k"))
    bit = lambda c, m: c.bitwiseAND(F.lit(m).cast("long"))
    flags = F.col("flags").cast("long")
    fixed = (
        first.withColumn("_k", shaped).withColumn("_kind", kind)
        .withColumn("flags", F.when(promoted & F.col("outer_named"), flags.bitwiseOR(F.lit(STATIC).cast("long")))
                    .when(F.col("_kind") == "anonymous", bit(flags, ~STATIC))
                    .when(F.col("_kind") == "local", bit(flags, ABSTRACT | FINAL)).otherwise(flags)))
    static = bit(F.col("flags"), STATIC) != 0
    member = F.col("_kind") == "member"
    ruled = cut(
        fixed.withColumn("_keep", F.when(member & ~static, F.lit(~STATIC)).otherwise(F.lit(-1)).cast("long"))
        .withColumn("_add", bit(F.col("flags"), PRIVATE | SYNTHETIC).bitwiseOR(
            F.when(member & static, F.lit(STATIC)).otherwise(F.lit(0)).cast("long")))
        .select("inner", "encloser", F.col("_kind").alias("kind"), "flags", "_keep", "_add"))
    chains = iterate.folded_chains(ruled, "inner", "encloser", "_keep", "_add")
    top = roots.select(F.col("node").alias("root"), F.col("flags").cast("long").alias("_rf"))
    handed = bit(F.col("_rf"), PRIVATE | SYNTHETIC).bitwiseOR(F.lit(STATIC).cast("long"))
    below = (
        chains.join(top, "root")  # a chain that ends elsewhere hangs below no root
        .join(ruled.select(F.col("inner").alias("node"), F.col("encloser").alias("parent"), "kind", "flags"), "node")
        .select("root", "node", "parent", F.col("steps").alias("depth"), "kind", "flags",
                handed.bitwiseAND(F.col("keep")).bitwiseOR(F.col("add")).alias("context")))
    tops = top.select("root", F.col("root").alias("node"), F.lit(None).cast(below.schema["parent"].dataType).alias("parent"),
                      F.lit(0).cast("long").alias("depth"), F.lit("root").alias("kind"), F.col("_rf").alias("flags"),
                      handed.alias("context"))
    return tops.unionByName(below)
