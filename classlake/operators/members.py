"""Member resolution, dangling references, override relations, obligations.

Methods are ``methods(class, name, params, ret, ...)``; the signature that
matters for overriding is (name, params).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classlake import iterate
from classlake.iterate import cut, cut_by, wavefront
from classlake.scan import first_by

KEY = ["class", "name", "params", "ret"]
REF = ["owner", "name", "params", "ret"]


def resolve(refs: DataFrame, ranked: DataFrame, members: DataFrame,
            renames: DataFrame | None = None) -> DataFrame:
    """Distinct references with the class that declares their target: REF + (found,).

    The own class first, then supertypes in the order of ``ranked``.  A
    constructor never leaves the named class.  With ``renames(owner, name,
    params, target)`` an unresolved reference is tried again under its new name.
    """
    keys = cut(refs.select(*REF).distinct())
    found = _search(keys, ranked, members)
    if renames is not None:
        lost = keys.join(found, REF, "left_anti").join(renames, ["owner", "name", "params"])
        again = _search(
            lost.select("owner", F.col("target").alias("name"), "params", "ret").distinct(), ranked, members)
        again = again.select("owner", F.col("name").alias("target"), "params", "ret", "found")
        again = lost.join(again, ["owner", "target", "params", "ret"]).select(*REF, "found")
        found = found.unionByName(again)
    return keys.join(found, REF, "left")


def _search(keys: DataFrame, ranked: DataFrame, members: DataFrame) -> DataFrame:
    names = members.select(*KEY).distinct()

    def look(wanted: DataFrame, places: DataFrame) -> DataFrame:
        return (
            wanted.join(places.select(F.col("node").alias("owner"), F.col("anc").alias("class"), "rank"), "owner")
            .filter((F.col("name") != "<init>") | (F.col("owner") == F.col("class")))
            .join(names, KEY).groupBy(*REF).agg(F.min_by("class", "rank").alias("found")))

    return in_slices(keys, ranked, look, REF)


def in_slices(keys: DataFrame, ranked: DataFrame, look: Callable[[DataFrame, DataFrame], DataFrame],
              key: list[str]) -> DataFrame:
    """Search the supertypes of each key's ``owner`` in order and stop at the first slice that answers.

    ``ranked(node, anc, rank)`` counts places from 0; ``look(keys, places)`` gives
    one row for each key that the places answer.  Slices double in size: the
    class itself, two more places, four more ...  Only keys without an answer
    whose owner has further places meet the next slice.
    """
    wanted = keys
    low, width = 0, 1
    found: list[DataFrame] = []
    while True:
        places = ranked.filter((F.col("rank") >= low) & (F.col("rank") < low + width))
        found.append(cut(look(wanted, places)))
        low, width = low + width, width * 2
        further = ranked.filter(F.col("rank") == low).select(F.col("node").alias("owner"))
        wanted = cut(wanted.join(found[-1], key, "left_anti").join(further, "owner", "left_semi").select(keys.columns))
        if wanted.isEmpty():
            break
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole


def resolve_rename(refs: DataFrame, breadth: DataFrame, members: DataFrame, renames: DataFrame) -> DataFrame:
    """References with the new name of their member: (owner, name, params, target).

    Supertypes are searched breadth first; a class that declares the member
    itself without a rename stops the search.
    """
    key = ["owner", "name", "params"]
    keys = cut(refs.select(*key).distinct())
    spot = ["class", "name", "params"]
    renamed = renames.select(F.col("owner").alias("class"), "name", "params", "target")
    marks = renamed.unionByName(
        members.select(*spot).distinct().join(renamed, spot, "left_anti")
        .select(*spot, F.lit(None).cast(dict(renames.dtypes)["target"]).alias("target")))

    def look(wanted: DataFrame, places: DataFrame) -> DataFrame:
        return (
            wanted.join(places.select(F.col("node").alias("owner"), F.col("anc").alias("class"), "rank"), "owner")
            .join(marks, spot).groupBy(*key).agg(F.min_by("target", "rank").alias("target")))

    return keys.join(in_slices(keys, breadth, look, key), key, "left").select(*key, "target")


def missing_targets(refs: DataFrame, ranked: DataFrame, members: DataFrame, owners: DataFrame) -> DataFrame:
    """Own, non-interface owners' unresolved members with their first caller."""
    real = owners.filter("is_own and not is_iface").select(F.col("node").alias("owner"))
    asked = refs.join(real, "owner", "left_semi")
    lost = resolve(asked, ranked, members).filter("found is null").select(*REF)
    first = asked.groupBy(*REF).agg(F.min("caller").alias("witness"))
    return lost.join(first, REF)


def missing_classes(referenced: DataFrame, known: DataFrame) -> DataFrame:
    """Referenced names (node) not present anywhere."""
    return referenced.select("node").distinct().join(known.select("node"), "node", "left_anti")


# ---------------------------------------------------------------- overriding


def compatible(child: str, parent: str, returns: DataFrame, df: DataFrame) -> DataFrame:
    """Keep rows whose return types may override: equal, or listed in
    ``returns(child, parent)`` (one row per related pair of return types)."""
    pairs = returns.select(F.col("child").alias(child), F.col("parent").alias(parent), F.lit(True).alias("_rel"))
    return df.join(pairs, [child, parent], "left").filter(
        (F.col(child) == F.col(parent)) | F.col("_rel")).drop("_rel")


def override_pairs(methods: DataFrame, closed: DataFrame, returns: DataFrame) -> DataFrame:
    """(class, name, params, ret, sup, sup_ret): a method and one it overrides.

    ``methods`` carries booleans ``overridable`` and ``final``.
    """
    able = methods.filter("overridable")
    child = able.select(*KEY)
    parent = able.filter("not final").select(
        F.col("class").alias("sup"), "name", "params", F.col("ret").alias("sup_ret"))
    strict = closed.filter("node <> anc").select(F.col("node").alias("class"), F.col("anc").alias("sup"))
    joined = child.join(strict, "class").join(parent, ["sup", "name", "params"])
    return compatible("ret", "sup_ret", returns, joined).select(*KEY, "sup", "sup_ret")


def inherited_implementations(methods: DataFrame, closed: DataFrame, returns: DataFrame,
                              own: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """(class, name, params, ret, sup, sup_ret): class method and the interface
    method it satisfies because an own class inherits both.

    ``methods`` carries ``overridable``, ``final``, ``public`` and ``in_iface``;
    ``own(node)`` are own classes that are not interfaces.  With ``parents`` of a
    hierarchy without cycles, classes meet where they first do (see
    :func:`first_meetings`) instead of in every class below.
    """
    able = methods.filter("overridable")
    below = closed.join(own.select("node"), "node", "left_semi")
    # only signatures that classes and interfaces share are spread over subclasses
    shared = able.groupBy("name", "params").agg(F.min("in_iface").alias("_lo"), F.max("in_iface").alias("_hi"))
    able = able.join(shared.filter("not _lo and _hi").select("name", "params"), ["name", "params"], "left_semi")
    impl = cut(able.filter("not in_iface").select(*KEY, "final", "public").distinct())
    intf = cut(able.filter("in_iface").select(
        F.col("class").alias("sup"), "name", "params", F.col("ret").alias("sup_ret")).distinct())
    # classes meet below first, once for each pair; their methods follow
    if parents is None:
        related = closed.filter("node <> anc")
        met = (
            below.select("node", F.col("anc").alias("class")).join(impl.select("class").distinct(), "class", "left_semi")
            .join(below.select("node", F.col("anc").alias("sup")).join(intf.select("sup").distinct(), "sup", "left_semi"), "node")
            .select("class", "sup").distinct())
        apart = (
            met.join(related.select(F.col("node").alias("class"), F.col("anc").alias("sup")), ["class", "sup"], "left_anti")
            .join(related.select(F.col("node").alias("sup"), F.col("anc").alias("class")), ["class", "sup"], "left_anti"))
    else:
        apart = first_meetings(parents, closed, below.select(F.col("anc").alias("node")).distinct(),
                               impl.select("class").distinct(), intf.select("sup").distinct())
    pairs = apart.join(impl, "class").join(intf, ["sup", "name", "params"])
    down = returns.select(F.col("child").alias("ret"), F.col("parent").alias("sup_ret"), F.lit(True).alias("_down"))
    up = returns.select(F.col("child").alias("sup_ret"), F.col("parent").alias("ret"), F.lit(True).alias("_up"))
    pairs = pairs.join(down, ["ret", "sup_ret"], "left").join(up, ["ret", "sup_ret"], "left")
    same = F.col("ret") == F.col("sup_ret")
    down_ok = same | F.coalesce("_down", F.lit(False))
    up_ok = same | F.coalesce("_up", F.lit(False))
    return pairs.filter(
        (F.col("public") & down_ok) | (~F.col("final") & (down_ok | up_ok))).select(*KEY, "sup", "sup_ret")


def first_meetings(parents: DataFrame, closed: DataFrame, nodes: DataFrame, classes: DataFrame, sups: DataFrame) -> DataFrame:
    """Distinct (class, sup) that some of ``nodes`` is below, neither being below the other.

    ``nodes(node)`` holds the supertypes of its members.  Of the nodes below both
    one has no parent that is: one parent is below the class alone, another one
    below the sup alone.  So only nodes of several parents are looked at, and what
    their parents share is left out; what is left is not related.
    """
    arcs = cut(parents.select("node", "parent").distinct().join(nodes, "node", "left_semi"))
    forks = cut(arcs.join(arcs.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("node"), "node", "left_semi"))
    tops = forks.select(F.col("parent").alias("node")).distinct()
    lists = cut(
        closed.select("node", "anc").join(tops, "node", "left_semi")
        .join(classes.select(F.col("class").alias("anc"), F.col("class").alias("_c")), "anc", "left")
        .join(sups.select(F.col("sup").alias("anc"), F.col("sup").alias("_s")), "anc", "left")
        .filter("_c is not null or _s is not null")
        .groupBy("node").agg(F.collect_set("_c").alias("_cs"), F.collect_set("_s").alias("_ss")))
    held = cut(forks.join(lists.withColumnRenamed("node", "parent"), "parent"))
    none = F.array().cast(dict(held.dtypes)["_cs"])
    other = forks.join(lists.withColumnRenamed("node", "parent"), "parent", "left").select(
        "node", F.col("parent").alias("_p"), F.coalesce("_cs", none).alias("_oc"), F.coalesce("_ss", none).alias("_os"))
    return (
        held.filter(F.size("_cs") > 0).select("node", "parent", "_cs", "_ss").join(other.filter(F.size("_os") > 0), "node")
        .filter("parent <> _p")
        .select(F.array_except("_cs", "_oc").alias("_a"), F.array_except("_os", "_ss").alias("_b"))
        .filter((F.size("_a") > 0) & (F.size("_b") > 0)).distinct()
        .select(F.explode("_a").alias("class"), "_b").select("class", F.explode("_b").alias("sup")).distinct())


def method_key(*cols: Column | str) -> Column:
    return F.concat_ws(" ", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols])


def families(methods: DataFrame, pairs: DataFrame) -> DataFrame:
    """Override families: KEY + (family,), the least member key of the component."""
    edges = pairs.select(
        method_key(*KEY).alias("a"), method_key("sup", "name", "params", "sup_ret").alias("b"))
    able = methods.filter("overridable").withColumn("_k", method_key(*KEY))
    comp = iterate.components(edges, "a", "b", able.select(F.col("_k").alias("node")))
    return able.join(comp.select(F.col("node").alias("_k"), F.col("component").alias("family")), "_k").select(
        *KEY, "family")


def flowing_families(methods: DataFrame, parents: DataFrame, levels: DataFrame, returns: DataFrame,
                     also: DataFrame) -> DataFrame:
    """As :func:`families` over :func:`override_pairs` and the pairs of ``also``, without the pairs: KEY + (family,).

    ``levels(node, level)`` puts parents before children and names every class
    of ``parents``.  Labels flow down the hierarchy: a class hands its children,
    for each (name, params, ret), the label of the nearest declaration that can
    be overridden.  What lies above a declaration with the same return type is
    overridden by it too, so nobody below has to meet it again.  A method takes
    the least label that it meets; the others are linked with it.  Only labels
    are left for the search for components.
    """
    from classlake.operators.hierarchy import children_by_level

    able = methods.filter("overridable").withColumn("_k", method_key(*KEY))
    own = cut_by(
        able.select(*KEY, "final", "_k").distinct()
        .join(levels.select(F.col("node").alias("class"), "level"), "class", "left")
        .withColumn("level", F.coalesce("level", F.lit(0).cast("long"))), "level")
    child = children_by_level(parents, levels)

    def step(level: int, sent: DataFrame) -> tuple[DataFrame, DataFrame]:
        # dealt out once by what all joins and aggregates that follow have in common
        spot = ["class", "name", "params"]
        seen = sent.select(*KEY, "root")
        mine = own.filter(F.col("level") == level).drop("level").repartition(*spot)
        met = compatible("ret", "_ret", returns, mine.join(
            seen.withColumnRenamed("ret", "_ret").repartition(*spot).distinct(), spot)).select(*KEY, "root")
        met = cut(mine.join(met, KEY, "left").select(*KEY, "final", "_k", F.coalesce("root", "_k").alias("root")).distinct())
        heads = met.filter("not final and params is not null and name is not null and ret is not null").repartition("class").groupBy(
            *KEY).agg(F.min("root").alias("root"))
        below = child.filter(F.col("_at") == level).select("class", "_child", "level")
        on = iterate._union([
            rows.join(below, "class").select(F.col("_child").alias("class"), "name", "params", "ret", "root", "level")
            for rows in (heads, seen.repartition("class").distinct().join(heads, KEY, "left_anti"))])
        return met.select("_k", "root"), on

    kind = dict(own.dtypes)
    met = wavefront(levels, step, ", ".join([*(f"{c} {kind[c]}" for c in KEY), "root string", f"level {kind['level']}"]))
    least = cut(met.groupBy("_k").agg(F.min("root").alias("root"), F.max("root").alias("_hi")))
    several = least.filter("root <> _hi").select("_k", F.col("root").alias("a"))
    links = several.join(met, "_k").select("a", F.col("root").alias("b"))
    of = lambda c: least.select(F.col("_k").alias("_" + c), F.col("root").alias(c))
    beside = (
        also.select(method_key(*KEY).alias("_a"), method_key("sup", "name", "params", "sup_ret").alias("_b"))
        .join(of("a"), "_a").join(of("b"), "_b").select("a", "b"))
    first = cut(least.groupBy("root").agg(F.min("_k").alias("_first")))
    comp = iterate.components(cut(links.unionByName(beside).filter("a <> b").distinct()), "a", "b", first, "root")
    comp = cut(comp.join(first, "root"))
    named = comp.join(comp.groupBy("component").agg(F.min("_first").alias("family")), "component").select("root", "family")
    return able.join(least.join(named, "root").select("_k", "family"), "_k").select(*KEY, "family")


def override_hierarchy(methods: DataFrame, closed: DataFrame, returns: DataFrame) -> DataFrame:
    """Every inherited declaration a method overrides: KEY + (sup, sup_ret).

    ``methods`` carries ``overridable``, ``visible`` (public or protected) and
    ``package``; package-private declarations count inside one package only.
    """
    able = methods.filter("overridable")
    strict = closed.filter("node <> anc").select(F.col("node").alias("class"), F.col("anc").alias("sup"))
    parent = able.select(F.col("class").alias("sup"), "name", "params", F.col("ret").alias("sup_ret"),
                         F.col("visible").alias("_v"), F.col("package").alias("_pkg"))
    joined = (
        able.select(*KEY, "package").join(strict, "class").join(parent, ["sup", "name", "params"])
        .filter("_v or _pkg = package"))
    return compatible("ret", "sup_ret", returns, joined).select(*KEY, "sup", "sup_ret")


def hierarchy_gaps(parents: DataFrame, known: DataFrame) -> DataFrame:
    """(node, gap): how far the supertypes of known classes are known.

    0 all are; 1 one is missing, but none up the chain of superclasses; 2 a
    superclass is missing.  A gap is handed down, weakened to 1 on the way
    through an interface.
    """
    arcs = cut(
        parents.join(known.select("node"), "node", "left_semi")
        .join(known.select(F.col("node").alias("parent"), F.lit(True).alias("_known")), "parent", "left")
        .select("node", "parent", F.col("pos").cast("int").alias("pos"), "_known"))
    most = F.when(F.col("pos") == 0, 2).otherwise(1)
    seed = known.select("node", F.lit(0).alias("gap")).unionByName(
        arcs.filter("_known is null").select("node", most.alias("gap")))
    down = cut(arcs.filter("_known").select("parent", F.col("node").alias("_child"), "pos"))
    return iterate.merged(
        seed,
        lambda f: f.filter("gap > 0").join(down, F.col("node") == F.col("parent"))
        .select(F.col("_child").alias("node"), F.least("gap", most).alias("gap")),
        ["node"], "gap")


def override_ancestry(methods: DataFrame, parents: DataFrame, known: DataFrame, returns: DataFrame) -> DataFrame:
    """What a method overrides, and the ancestors that nobody knows: KEY + (pos, sup, sup_ret, resolved, gap).

    One row for each inherited declaration (``resolved``) and each ancestor that
    is not ``known`` (its return type is null), numbered in the order of a
    depth-first search that takes the superclass before the interfaces and goes
    no further than an unknown class.  A method without either has one row with
    ``pos`` null.  ``gap`` as in :func:`hierarchy_gaps`.  ``methods`` as for
    :func:`override_hierarchy`; ``parents(node, parent, pos)``.
    """
    from classlake.operators.hierarchy import ranked_closure

    here = known.select(F.col("node").alias("class"))
    able = cut(methods.filter("overridable").join(here, "class", "left_semi"))
    ranks = cut(ranked_closure(
        parents.join(known.select("node"), "node", "left_semi"), able.select(F.col("class").alias("node")))
        .filter("node <> anc").select(F.col("node").alias("class"), F.col("anc").alias("sup"), "rank"))
    parent = able.select(F.col("class").alias("sup"), "name", "params", F.col("ret").alias("sup_ret"),
                         F.col("visible").alias("_v"), F.col("package").alias("_pkg"))
    found = compatible("ret", "sup_ret", returns, (
        able.select(*KEY, "package").join(ranks, "class").join(parent, ["sup", "name", "params"])
        .filter("_v or _pkg = package"))).select(*KEY, "sup", "sup_ret", "rank", F.lit(True).alias("resolved"))
    # unknown ancestors are spread over the methods of the classes below them alone
    lost = ranks.join(known.select(F.col("node").alias("sup")), "sup", "left_anti")
    missing = able.select(*KEY).join(lost, "class").select(
        *KEY, "sup", F.lit(None).cast("string").alias("sup_ret"), "rank", F.lit(False).alias("resolved"))
    rows = found.unionByName(missing)
    order = Window.partitionBy(*KEY).orderBy("rank", "sup", "sup_ret")  # at most one row an ancestor and return type
    placed = rows.withColumn("pos", F.row_number().over(order).cast("long"))
    gaps = hierarchy_gaps(parents, known).select(F.col("node").alias("class"), F.col("gap").cast("long").alias("gap"))
    return able.select(*KEY).join(placed, KEY, "left").join(gaps, "class").select(
        *KEY, "pos", "sup", "sup_ret", "resolved", "gap")


# ---------------------------------------------------------------- obligations


def abstract_obligations(targets: DataFrame, breadth: DataFrame | None, methods: DataFrame,
                         parents: DataFrame | None = None, levels: DataFrame | None = None) -> DataFrame:
    """Abstract methods a concrete class inherits: one row per declaration.

    (node, name, params, owner, ret, rank, ord, access_rank).  ``targets(node,
    package)``; ``methods`` carries ``overridable``, ``abstract``, ``visible``,
    ``in_iface``, ``package``, ``access_rank`` and ``ord``.

    With ``parents`` and ``levels`` there is no closure, and for each (name,
    params, ret) the first declaration stands for all, with the strongest access
    (see :func:`_flowing_obligations`); that is what choosing among them needs.
    """
    if parents is not None:
        return _flowing_obligations(targets, methods, parents, levels)
    strict = breadth.filter("node <> anc").select("node", F.col("anc").alias("class"), "rank")
    need = methods.filter("overridable and abstract")
    return (
        targets.select("node", F.col("package").alias("_pkg")).join(strict, "node").join(need, "class")
        .filter("visible or in_iface or package = _pkg")
        .select("node", "name", "params", F.col("class").alias("owner"), "ret", "rank", "ord", "access_rank"))


def _flowing_obligations(targets: DataFrame, methods: DataFrame, parents: DataFrame, levels: DataFrame) -> DataFrame:
    """First abstract declarations in breadth-first order, handed down level by level.

    A class hands its children, for each (name, params, ret), the declaration it
    meets first: what is first for a child comes first for one of its parents.
    Declarations that one package alone sees are handed on besides while they
    come before (or have more access than) what everybody sees.  ``rank`` counts
    the places among what a class meets, so it orders like the visit does.
    """
    from classlake.operators.hierarchy import children_by_level

    child = children_by_level(parents, levels)
    node = dict(child.dtypes)["class"]
    everybody = F.coalesce("visible", F.lit(False)) | F.coalesce("in_iface", F.lit(False))
    place = lambda far, pos, parent, at: [far.cast("int").alias("far"), pos.cast("int").alias("pos"),
                                          parent.cast(node).alias("parent"), at.cast("long").alias("at")]
    held = ["class", "name", "params", "ret", "all", "package"]
    rest = ["ord", "owner", "access_rank"]
    own = cut_by(
        methods.filter("overridable and abstract").withColumn("all", everybody).filter("all or package is not null")
        .select("class", "name", "params", "ret", "all", F.when(~F.col("all"), F.col("package")).alias("package"),
                *place(F.lit(0), F.lit(-1), F.lit(None), F.lit(0)), "ord", F.col("class").alias("owner"), "access_rank")
        .join(levels.select(F.col("node").alias("class"), "level"), "class"), "level")
    key = ["far", "pos", "parent", "at"]

    def step(level: int, sent: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = own.filter(F.col("level") == level).unionByName(sent).select(*held, *key, *rest).repartition("class")
        best = (
            rows.groupBy(*held, (F.col("far") > 0).alias("above"))
            .agg(F.min(F.struct(*key, "ord", "owner")).alias("b"), F.max("access_rank").alias("access_rank")))
        order = Window.partitionBy("class").orderBy("b.far", "b.pos", "b.parent", "b.at")
        met = cut(best.withColumn("rank", F.dense_rank().over(order).cast("long")))
        beside = Window.partitionBy("class", "name", "params", "ret")
        handed = (
            met.withColumn("_b", F.min(F.when(F.col("all"), F.col("b"))).over(beside))
            .withColumn("_a", F.max(F.when(F.col("all"), F.col("access_rank"))).over(beside))
            .filter("_b is null or (all and b = _b) or (not all and (b < _b or access_rank > _a))")
            .withColumn("access_rank", F.when(F.col("all"), F.col("_a")).otherwise(F.col("access_rank"))))
        on = handed.join(child.filter(F.col("_at") == level).select("class", "_child", F.col("pos").alias("_pos"), "level"), "class").select(
            F.col("_child").alias("class"), "name", "params", "ret", "all", "package",
            *place(F.col("b.far") + 1, F.col("_pos"), F.col("class"), F.col("rank")),
            "b.ord", "b.owner", "access_rank", "level")
        return met.filter("above").select(*held, "rank", "b.ord", "b.owner", "access_rank"), on

    kind = dict(own.dtypes)
    met = wavefront(levels, step, ", ".join(f"`{c}` {kind[c]}" for c in [*held, *key, *rest, "level"]))
    return (
        targets.select("node", F.col("package").alias("_pkg")).join(met, F.col("node") == F.col("class"))
        .filter("all or package = _pkg")
        .select("node", "name", "params", "owner", "ret", "rank", "ord", "access_rank"))


def most_specific_return(obligations: DataFrame, returns: DataFrame) -> DataFrame:
    """First declaration of each group whose return type suits all others.

    (node, name, params, owner, ret, access_rank) with the strongest access of
    the group; groups without such a declaration give no row.  Types are
    compared once per distinct type, not per declaration.
    """
    group = ["node", "name", "params"]
    kinds = obligations.select(*group, "ret").distinct()
    total = kinds.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    # a type suits itself and its listed parents: walk those instead of all pairs of a group
    above = returns.filter("child <> parent").select(F.col("child").alias("ret"), F.col("parent").alias("_o")).distinct()
    suits = kinds.join(above, "ret").join(kinds.withColumnRenamed("ret", "_o"), [*group, "_o"], "left_semi")
    suits = kinds.unionByName(suits.select(*group, "ret")).groupBy(*group, "ret").agg(F.count(F.lit(1)).alias("_k"))
    fits = suits.join(total, group).filter("_k = _n")
    access = obligations.groupBy(*group).agg(F.max("access_rank").alias("need"))
    first = first_by(
        obligations.join(fits.select(*group, "ret"), [*group, "ret"], "left_semi")
        .select(*group, "owner", "ret", "rank", "ord"), group, ["rank", "ord", "owner", "ret"])
    return first.join(access, group).select(*group, "owner", "ret", F.col("need").alias("access_rank"))


def unmet_obligations(required: DataFrame, chain: DataFrame, closed: DataFrame, methods: DataFrame,
                      returns: DataFrame) -> DataFrame:
    """Required methods a concrete class neither has nor gets by default.

    Satisfied by the nearest class-chain declaration with enough access and a
    fitting return when that is not abstract; without any such declaration, by
    a single most specific interface method that is not abstract.
    """
    group = ["node", "name", "params"]
    able = methods.filter("overridable")
    mine = able.select(F.col("class").alias("anc"), "name", "params", F.col("ret").alias("_ret"),
                       F.col("access_rank").alias("_rank"), "abstract", "ord")
    decl = (
        required.select(*group, "ret", "access_rank").join(chain, "node").join(mine, ["anc", "name", "params"])
        .filter("_rank >= access_rank"))
    decl = compatible("_ret", "ret", returns, decl)
    nearest = decl.groupBy(*group).agg(
        F.min_by("abstract", F.struct("depth", "ord", "_ret")).alias("_abs"))
    iface = able.filter("in_iface").select(
        F.col("class").alias("anc"), "name", "params", F.col("abstract").alias("_a"), F.col("ret").alias("_ir"))
    # only supertypes that offer something are met
    strict = closed.filter("node <> anc").join(iface.select("anc").distinct(), "anc", "left_semi").select("node", "anc")
    offers = required.select(*group).join(strict, "node").join(iface, ["anc", "name", "params"])
    # a more specific offer beats every offer above it: offers of one signature are compared once for each pair of types
    spots = iface.select("anc", "name", "params").distinct()
    above = (
        spots.withColumnRenamed("anc", "_low").join(strict.select(F.col("node").alias("_low"), "anc"), "_low")
        .join(spots, ["anc", "name", "params"], "left_semi"))
    beaten = (
        offers.select(*group, F.col("anc").alias("_low")).distinct()
        .join(above, ["_low", "name", "params"]).select(*group, "anc").distinct())
    single = (
        offers.join(beaten, [*group, "anc"], "left_anti").groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_a").alias("_a")).filter("_n = 1 and not _a").select(*group))
    state = required.join(nearest, group, "left").join(single.withColumn("_def", F.lit(True)), group, "left")
    return state.filter(
        F.coalesce("_abs", F.lit(True)) & ~(F.col("_abs").isNull() & F.coalesce("_def", F.lit(False)))
    ).select(*group, "ret", "access_rank")


# ---------------------------------------------------------------- other joins


def relocations(classes: DataFrame, uses: DataFrame, fixed: str) -> DataFrame:
    """Default-package own classes and the package they move to: (node, target).

    ``classes(node, package)`` are own classes, the default package is empty;
    ``uses(node, used)``.  All move to the one package that refers to any of
    them, or to ``fixed`` when several packages do.
    """
    loose = classes.filter("package = ''")
    user = classes.filter("package <> ''")
    asking = (
        uses.join(user, "node").join(loose.select(F.col("node").alias("used")), "used", "left_semi")
        .agg(F.min("package").alias("_lo"), F.max("package").alias("_hi")))
    target = asking.filter("_lo is not null").select(
        F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.lit(fixed)).alias("target"))
    return loose.select("node", target.scalar().alias("target")).filter("target is not null")


def inner_claims(claims: DataFrame) -> DataFrame:
    """One claim per inner class: (inner, claimant, info, inconsistent).

    ``claims(inner, claimant, encloser, ord, info)``: the class itself beats its
    encloser, which beats others; then the first claim.
    """
    rank = (F.when(F.col("claimant") == F.col("inner"), 0)
            .when(F.col("claimant") == F.col("encloser"), 1).otherwise(2))
    return claims.groupBy("inner").agg(
        F.min_by(F.struct("claimant", "info"), F.struct(rank.alias("r"), "ord", "claimant", "info")).alias("c"),
        (F.min("info") != F.max("info")).alias("inconsistent"),
    ).select("inner", "c.claimant", "c.info", "inconsistent")


def attach_docs(members: DataFrame, docs: DataFrame, key: list[str]) -> DataFrame:
    """Members with their documentation, null where there is none."""
    return members.join(docs.select(*key, "doc"), key, "left")


def decode_switch(labels: DataFrame, table: DataFrame) -> DataFrame:
    """Decoded labels of fully decodable switches: (unit, idx, label, constant).

    ``labels(unit, idx, label)``, ``table(unit, key, constant)``.  Label -1 is
    the null branch; a label without an entry takes the least larger key; a
    switch with a label left over stays undecoded.  The next larger key comes
    from an ordered scan over labels and keys together.
    """
    from classlake.scan import last_seen

    keyed = table.groupBy("unit", F.col("key").alias("label")).agg(F.min("constant").alias("_c"))
    wanted = labels.select("unit", "label").filter("label >= 0").distinct()
    joined = wanted.withColumn("_w", F.lit(True)).join(keyed, ["unit", "label"], "full").withColumn(
        "_neg", -F.col("label"))
    near = last_seen(joined, ["unit"], "_neg", F.col("_c"), "constant").filter("_w").select(
        "unit", "label", "constant")
    null = labels.filter("label = -1").select("unit", "label", F.lit("null").alias("constant")).distinct()
    known = labels.join(near.unionByName(null), ["unit", "label"], "left")
    open_units = known.filter("constant is null").select("unit").distinct()
    return known.join(open_units, "unit", "left_anti").select("unit", "idx", "label", "constant")


def platform_lookup(refs: DataFrame, classes: DataFrame, members: DataFrame, root_supplied: DataFrame) -> DataFrame:
    """REF + (state, declared): RESOLVED with declared types, ABSENT or UNKNOWN.

    ``classes(node)`` and ``members`` (KEY + declared) describe the platform;
    everything is UNKNOWN when ``root_supplied`` (the input's own copy of the
    platform root) has a row.
    """
    known = classes.select(F.col("node").alias("owner"), F.lit(True).alias("_c"))
    api = members.select(F.col("class").alias("owner"), "name", "params", "ret", "declared", F.lit(True).alias("_m"))
    own = root_supplied.agg((F.count(F.lit(1)) > 0).alias("_own"))
    return (
        refs.select(*REF).distinct().join(known, "owner", "left").join(api, REF, "left")
        .withColumn("_own", own.scalar())
        .select(*REF,
                F.when(F.col("_own") | F.col("_c").isNull(), "UNKNOWN")
                .when(F.col("_m"), "RESOLVED").otherwise("ABSENT").alias("state"),
                F.when(~F.col("_own") & F.col("_c"), F.col("declared")).alias("declared")))
