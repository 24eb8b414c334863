"""Identifier rules, generated names and collision-free naming."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classlake.iterate import converge, cut
from classlake.scan import global_rank, ranked, running_max, running_sum, sliced

# Words of the Java language that cannot name anything.
KEYWORDS = """
abstract assert boolean break byte case catch char class const continue default do double else enum
extends false final finally float for goto if implements import instanceof int interface long native
new null package private protected public return short static strictfp super switch synchronized this
throw throws transient true try void volatile while
""".split()
# Device names some file systems reserve.
DEVICES = """
con prn aux nul com1 com2 com3 com4 com5 com6 com7 com8 com9 lpt1 lpt2 lpt3 lpt4 lpt5 lpt6 lpt7 lpt8 lpt9
""".split()

# one UTF-16 unit per character: supplementary characters never qualify
_IDENTIFIER = (
    r"\A[\p{javaJavaIdentifierStart}&&[^\x{10000}-\x{10FFFF}]]"
    r"[\p{javaJavaIdentifierPart}&&[^\p{javaIdentifierIgnorable}]&&[^\x{10000}-\x{10FFFF}]]*\z"
)
# Names whose parts between dollar signs have three characters at most, and the longest name kept.
_SHORT_PARTS = r"\A(?:.{1,3}(?:\z|\$))+\z"
LONGEST_CLASS_NAME = 249


def valid_identifier(name: Column) -> Column:
    return name.rlike(_IDENTIFIER)


def must_rename_member(name: Column, is_method: Column) -> Column:
    """Names no source file can declare."""
    special = is_method & name.isin("<init>", "<clinit>")
    bad = (name == "") | (~special & ~valid_identifier(name)) | name.isin(KEYWORDS)
    return F.coalesce(bad, F.lit(True))


def must_rename_class(name: Column) -> Column:
    parts = F.split(F.regexp_replace(name, "/+$", ""), "/")
    bad = F.exists(
        parts,
        lambda p: (p == "") | ~valid_identifier(p) | p.isin(KEYWORDS) | F.lower(p).isin(DEVICES))
    only_slashes = name.rlike(r"\A/+\z")
    return F.coalesce((name == "") | (~only_slashes & bad), F.lit(True))


def rename_class(name: Column) -> Column:
    """Also devices, obfuscated names (every ``$`` part short) and overlong ones."""
    return (
        must_rename_class(name) | F.lower(name).isin(DEVICES) | name.rlike(_SHORT_PARTS)
        | (F.length(name) > LONGEST_CLASS_NAME))


# ---------------------------------------------------------------- type based names


def clean_type(kind: Column) -> Column:
    """Type name without type arguments and qualifier."""
    bare = F.regexp_replace(kind, "<.*$", "")
    return F.regexp_replace(bare, r"^.*\.", "")


def name_base(kind: Column) -> Column:
    """Base of a variable name: innermost simple name, first letter lowered;
    array types get a plural ``s``."""
    inner = F.regexp_replace(F.regexp_replace(clean_type(kind), r"^.*\$", ""), r"\[\]", "")
    low = F.concat(F.lower(F.substring(inner, 1, 1)), F.substring(inner, 2, 1 << 30))
    plural = kind.contains("[]") & ~low.endswith("s")
    return F.when(plural, F.concat(low, F.lit("s"))).otherwise(low)


# Naming base -> first counter, plain first names?, names.
TYPE_NAMES = {
    "int": (0, True, ["i", "j", "k", "l"]),
    "byte": (0, False, ["b"]),
    "char": (0, False, ["c"]),
    "short": (1, False, ["short"]),
    "boolean": (0, True, ["flag"]),
    "double": (0, False, ["d"]),
    "float": (0, True, ["f"]),
    "File": (1, True, ["file"]),
    "String": (0, True, ["s"]),
    "Class": (0, True, ["oclass"]),
    "Long": (0, True, ["olong"]),
    "Byte": (0, True, ["obyte"]),
    "Short": (0, True, ["oshort"]),
    "Boolean": (0, True, ["obool"]),
    "Package": (0, True, ["opackage"]),
    "Enum": (0, True, ["oenum"]),
}


def typed_names(variables: DataFrame) -> DataFrame:
    """``variables(unit, var, version, type)`` with ``new_name``.

    The k-th variable of a base in a unit takes name k modulo the base's names
    with the quotient as suffix.  A type without a base of its own founds one
    when it is capitalised or an array; a plain lower-case type founds none,
    but uses one founded before it under the same letters.
    """
    fixed = [k for k in TYPE_NAMES]
    kind = clean_type(F.col("type"))
    single = F.regexp_replace(F.regexp_replace(kind, r"\.\.\.", "[]"), r"(\[\])+", "[]")
    find = F.regexp_replace(kind, r"(\[\])+", "[]")
    base = (
        F.when(find.isin(fixed), find)
        .when(F.lower(find).isin(fixed), F.lower(find))
        .when(kind == "long", F.lit("int")))
    founds = kind.rlike(r"^[A-Z]") | kind.contains("[") | kind.contains("...")
    rows = variables.select(
        "unit", "var", "version", "type", kind.alias("_kind"),
        F.coalesce(base, F.when(founds, F.lower(single))).alias("_base"),
        (base.isNull() & founds).alias("_own"))
    order = F.struct("var", "version")
    founded = rows.filter("_own").groupBy("unit", F.col("_base").alias("_kind")).agg(F.min(order).alias("_since"))
    rows = rows.join(founded, ["unit", "_kind"], "left").withColumn(
        "_base", F.coalesce("_base", F.when(order > F.col("_since"), F.col("_kind"))))
    plain = rows.filter("_base is null").select("unit", "var", "version", "type", F.lower("_kind").alias("new_name"))
    counted = ranked(rows.filter("_base is not null"), ["unit", "_base"], ["var", "version"], "_k", sliced("var"))
    first = F.create_map(*[x for b, (s, _, _) in TYPE_NAMES.items() for x in (F.lit(b), F.lit(s))])
    skip = F.create_map(*[x for b, (_, z, _) in TYPE_NAMES.items() for x in (F.lit(b), F.lit(z))])
    words = F.create_map(*[x for b, (_, _, n) in TYPE_NAMES.items()
                           for x in (F.lit(b), F.array(*[F.lit(w) for w in n]))])
    bare = F.replace(F.replace(F.col("_base"), F.lit("[]"), F.lit("")), F.lit("."), F.lit(""))
    own_name = F.when(F.col("_base").contains("["), F.concat(F.lit("a"), bare)).otherwise(bare)
    names = F.coalesce(words[F.col("_base")], F.array(own_name))
    k = F.col("_k") + F.coalesce(first[F.col("_base")], F.lit(0))
    m = F.size(names)
    plain_first = F.coalesce(skip[F.col("_base")], F.lit(True))
    suffix = F.when(plain_first & (k < m), "").otherwise(F.floor(k / m).cast("string"))
    word = F.element_at(names, (k % m + 1).cast("int"))
    named = counted.select("unit", "var", "version", "type", F.concat(word, suffix).alias("new_name"))
    return named.unionByName(plain)


# ---------------------------------------------------------------- counters


def counter_names(wanted: DataFrame, occupied: DataFrame, order: list[str], prefix: str) -> DataFrame:
    """``wanted`` with ``new_name`` = prefix and the next number no one holds.

    The k-th row gets the k-th free number.  Numbers come from one range
    partitioned rank; taken numbers o_0 < o_1 < ... shift a rank by as many
    j as satisfy o_j - j <= k, which a running count tells.
    """
    rows = cut(global_rank(wanted, order, "_k"))
    taken = (
        occupied.select(F.regexp_extract("name", f"^{prefix}(0|[1-9][0-9]{{0,17}})$", 1).alias("_o"))
        .filter("_o <> ''").select(F.col("_o").cast("long").alias("_o")).distinct())
    taken = global_rank(taken, ["_o"], "_j")
    steps = taken.select((F.col("_o") - F.col("_j")).alias("_k")).groupBy("_k").agg(F.count(F.lit(1)).alias("_add"))
    at = rows.select("_k").join(steps, "_k", "full")
    shifted = running_sum(at, [], "_k", F.coalesce("_add", F.lit(0)), "_shift")
    return (
        rows.join(shifted.select("_k", "_shift"), "_k")
        .withColumn("new_name", F.concat(F.lit(prefix), (F.col("_k") + F.col("_shift")).cast("string")))
        .drop("_k", "_shift"))


def class_names(wanted: DataFrame, occupied: DataFrame, order: list[str]) -> DataFrame:
    """New class names for ``wanted(name, ...)``.

    A name of digits and a rest becomes ``Inner`` + rest for the first such
    class whose result is free; every other class takes the next free number,
    with ``Inner`` + rest in front where there is a rest.
    """
    rest = F.regexp_extract("name", r"^\p{Nd}+(\P{Nd}.*)$", 1)
    rows = wanted.withColumn("_rest", rest)
    rank = F.struct(*order)
    lead = rows.filter("_rest <> ''").groupBy("_rest").agg(F.min(rank).alias("_lead"))
    held = occupied.select(F.col("name").alias("_inner")).distinct().withColumn("_held", F.lit(True))
    rows = (
        rows.join(lead, "_rest", "left").withColumn("_inner", F.concat(F.lit("Inner"), "_rest"))
        .join(held, "_inner", "left")
        .withColumn("_free", (F.col("_rest") != "") & (F.struct(*order) == F.col("_lead")) & F.col("_held").isNull()))
    rows = rows.withColumn("_free", F.coalesce("_free", F.lit(False))).drop("_lead", "_held")
    direct = rows.filter("_free").withColumn("new_name", F.col("_inner"))
    counted = counter_names(rows.filter("not _free"), occupied, order, "class_")
    counted = counted.withColumn(
        "new_name", F.when(F.col("_rest") != "", F.concat("_inner", F.substring(F.col("new_name"), F.lit(6), F.length("new_name"))))
        .otherwise(F.col("new_name")))
    return direct.unionByName(counted).drop("_rest", "_inner", "_free")


# ---------------------------------------------------------------- names free within a scope


def letter_name(index: Column) -> Column:
    """0 -> a ... 25 -> z, 26 -> ba: base 26 with letters for digits."""
    return F.translate(F.conv(index.cast("string"), 10, 26), "0123456789ABCDEFGHIJKLMNOP", "abcdefghijklmnopqrstuvwxyz")


def free_names(rows: DataFrame, reserved: DataFrame | None = None) -> DataFrame:
    """``rows(scope, base, ord, letters)`` with ``new_name``, unique per scope.

    Rows choose in the order of ``ord`` (unique per scope): base, base1, base2,
    ... or, with ``letters``, the single letter names from the base onward.  A
    row that loses a name to an earlier one moves on, and so do the later rows
    of its base; rounds repeat until nobody loses, which is the outcome of
    choosing one after another.  A keyword gets a trailing ``_`` and never
    takes part.  ``reserved(scope, name)`` are names nobody may take.
    """
    keyword = rows.filter(F.col("base").isin(KEYWORDS)).select(
        *rows.columns, F.concat("base", F.lit("_")).alias("new_name"))
    held = keyword.groupBy("scope", F.col("new_name").alias("_name")).agg(F.min("ord").alias("_taken"))
    if reserved is not None:
        none = F.lit(None).cast(held.schema["_taken"].dataType)
        extra = reserved.select("scope", F.col("name").alias("_name"), none.alias("_taken")).distinct()
        held = held.unionByName(extra.withColumn("_taken", F.lit(-(1 << 62)).cast(held.schema["_taken"].dataType)))
        held = held.groupBy("scope", "_name").agg(F.min("_taken").alias("_taken"))
    held = cut(held)
    active = rows.filter(~F.col("base").isin(KEYWORDS))
    state = ranked(active, ["scope", "base"], ["ord"], "_k", sliced("ord")).withColumn("_shift", F.lit(0).cast("long"))

    def named(df: DataFrame) -> DataFrame:
        index = F.col("_k") + F.col("_shift")
        numbered = F.concat("base", F.when(index == 0, "").otherwise(index.cast("string")))
        return df.withColumn("_name", F.when(
            F.col("letters"), letter_name(F.ascii("base") - 97 + index)).otherwise(numbered))

    def step(df: DataFrame) -> DataFrame:
        now = named(df)
        best = now.groupBy("scope", "_name").agg(F.min("ord").alias("_best"))
        judged = (
            now.join(best, ["scope", "_name"]).join(held, ["scope", "_name"], "left")
            .withColumn("_want", F.col("_shift") + F.when(
                (F.col("ord") > F.col("_best")) | (F.col("_taken") < F.col("ord")), 1).otherwise(0)))
        moved = running_max(judged, ["scope", "base"], "_k", F.col("_want"), "_next")
        return moved.select(*rows.columns, "_k", F.col("_next").cast("long").alias("_shift"))

    def changed(new: DataFrame, old: DataFrame) -> DataFrame:
        was = old.select("scope", "base", "ord", F.col("_shift").alias("_was"))
        return new.join(was, ["scope", "base", "ord"]).filter("_shift <> _was")

    settled = named(converge(state, step, changed))
    return settled.select(*rows.columns, F.col("_name").alias("new_name")).unionByName(keyword)


def scope_clashes(variables: DataFrame) -> DataFrame:
    """``variables(unit, name, start, end, ord)`` with ``new_name``.

    Scopes nest.  A variable gets as many ``x`` as live outer variables of its
    name require; repeated until no live names clash.  The number of live
    variables is a running count of starts and ends, not a join of pairs.
    """
    state = variables.withColumn("_x", F.lit(0).cast("long"))

    def live(df: DataFrame) -> DataFrame:
        now = df.withColumn("_name", F.concat("name", F.repeat(F.lit("x"), F.col("_x").cast("int"))))
        opens = now.select("unit", "_name", "start", "ord", F.lit(1).alias("_d"))
        ends = now.groupBy("unit", "_name", F.col("end").alias("start")).agg((-F.count(F.lit(1))).alias("_d"))
        ends = ends.select("unit", "_name", "start", F.lit(-1).cast("long").alias("ord"), "_d")
        events = opens.unionByName(ends)
        # ends come before starts at one position; every event gets its own place
        placed = ranked(events, ["unit", "_name"], ["start", "ord"], "_pos", sliced("start"))
        counted = running_sum(placed, ["unit", "_name"], "_pos", F.col("_d"), "_open").filter("_d = 1")
        return now.join(counted.select("unit", "_name", "start", "ord", "_open"), ["unit", "_name", "start", "ord"])

    def step(df: DataFrame) -> DataFrame:
        return live(df).select(*variables.columns, (F.col("_x") + F.col("_open") - 1).alias("_x"))

    def changed(new: DataFrame, old: DataFrame) -> DataFrame:
        was = old.select("unit", "name", "start", "ord", F.col("_x").alias("_was"))
        return new.join(was, ["unit", "name", "start", "ord"]).filter("_x <> _was")

    done = converge(state, step, changed)
    return done.select(*variables.columns, F.concat("name", F.repeat(F.lit("x"), F.col("_x").cast("int"))).alias("new_name"))


# ---------------------------------------------------------------- extension points

Policy = Callable[[DataFrame], DataFrame]


def apply_policy(names: DataFrame, decide: Callable[[DataFrame], Column], generate: Policy) -> DataFrame:
    """User-supplied renaming: ``decide`` marks rows, ``generate`` adds ``new_name``."""
    marked = names.withColumn("_rename", decide(names))
    changed = generate(marked.filter("_rename").drop("_rename"))
    kept = marked.filter("not _rename").drop("_rename").withColumn("new_name", F.col("name"))
    return changed.select(*names.columns, "new_name").unionByName(kept.select(*names.columns, "new_name"))


SLICE = 1 << 16  # variables that a provider is given at once


def provide_names(variables: DataFrame, provider: Callable[[pd.DataFrame], pd.Series], counted: Column | None = None,
                  whole: bool = False) -> DataFrame:
    """User-supplied naming of each unit's variables, in order of ``var`` (and ``version``).

    The provider is called on ordered slices of at most ``SLICE`` variables of a
    unit, with two more columns: ``at``, a variable's place in its unit, and, if
    ``counted`` names a value, ``seen``, how many earlier variables of the unit
    have the same one.  Both count over all earlier slices: slices are counted
    first and their sums carried on, so no task holds more than a slice, however
    large a unit.  A provider that has to see a unit as one asks for ``whole``.
    """
    order = [c for c in ("var", "version") if c in variables.columns]
    cut_at = F.floor(F.col("var") / SLICE)
    placed = ranked(variables, ["unit"], order, "at", cut_at)
    names = ["at"]
    if counted is not None:
        placed = ranked(placed.withColumn("_value", counted), ["unit", "_value"], ["at"], "seen", F.floor(F.col("at") / SLICE)).drop("_value")
        names.append("seen")
    placed = placed.withColumn("_slice", F.lit(0).cast("long") if whole else F.floor(F.col("at") / SLICE))

    out = [*variables.columns, "new_name"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", ignore_index=True)
        return pdf.assign(new_name=provider(pdf.drop(columns="_slice")))[out]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in variables.schema.fields)
    columns = [c for c in variables.columns if c not in names]
    return placed.select(*columns, *names, "_slice").groupBy("unit", "_slice").applyInPandas(run, f"{fields}, new_name string")
