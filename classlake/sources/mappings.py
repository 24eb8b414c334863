"""Mapping files and parameter-name files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from classlake.functions.descriptors import parameters, remap_descriptors, slot_width
from classlake.iterate import cut
from classlake.scan import last_seen


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) with lines numbered from 1 inside each file."""
    whole = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\r?\n\z", "").alias("value"))
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "value")).select(
        "file", (F.col("line") + 1).cast("long").alias("line"), "value")


def nearest_parent(lines: DataFrame, keys: list[str], pos: str, parent, out: str) -> DataFrame:
    """``out`` = value of the nearest earlier (or same) row with a parent value."""
    return last_seen(lines, keys, pos, parent, out)


def _unescape(text):
    """Backslash escapes n, r, t, 0 and backslash; anything else is an error."""
    held = F.replace(text, F.lit("\\\\"), F.lit("\x01"))
    for code, char in (("n", "\n"), ("r", "\r"), ("t", "\t"), ("0", "\x00")):
        held = F.replace(held, F.lit("\\" + code), F.lit(char))
    bad = F.raise_error(F.concat(F.lit("bad escape in mapping: "), text)).cast("string")
    return F.when(F.instr(held, "\\") > 0, bad).otherwise(F.replace(held, F.lit("\x01"), F.lit("\\")))


def _headers(lines: DataFrame, source: str | None, target: str | None) -> DataFrame:
    """(file, _n, _src, _dst): number of namespaces, 1-based columns of both."""
    cells = F.split(F.regexp_replace(F.ltrim("value"), "^\\x{FEFF}", ""), "\t")
    head = lines.filter("line = 1").select("file", cells.alias("_h"))
    fits = (F.size("_h") >= 5) & (F.col("_h")[0] == "tiny") & (F.col("_h")[1] == "2")
    head = head.select(
        "file", F.slice("_h", F.lit(4), F.size("_h")).alias("_ns"),
        F.when(fits, 0).otherwise(F.raise_error(F.lit("unsupported mapping header")).cast("int")).alias("_bad"))
    at = lambda name, default: (F.array_position("_ns", name) if name else F.lit(default)).cast("int")
    head = head.select("file", (F.size("_ns") + F.col("_bad")).alias("_n"), at(source, 1).alias("_src"), at(target, 2).alias("_dst"))
    unknown = (F.col("_src") == 0) | (F.col("_dst") == 0) | (F.col("_src") == F.col("_dst"))
    return head.withColumn("_src", F.when(
        unknown, F.raise_error(F.lit("namespaces not found in header")).cast("int")).otherwise(F.col("_src")))


def parse_mapping(lines: DataFrame, source: str | None = None, target: str | None = None) -> DataFrame:
    """Mapping rows: (file, kind, owner, name, descriptor, lv_index, target).

    ``lines(file, line, value)`` of tab-indented mapping files: a header with
    namespaces, then ``c`` rows, ``f``/``m`` rows one tab deeper and ``p`` rows
    two tabs deeper.  A child belongs to the nearest parent before it; any
    other row at a lower depth ends the parent.  Blank and ``#`` rows are
    skipped; short rows, unknown escapes and contradicting renames are errors.
    Descriptors, written in the first namespace, are carried to the source
    one.  Empty and unchanged names rename nothing.
    """
    depth = F.length(F.regexp_extract("value", r"^\t*", 0))
    body = F.regexp_replace("value", r"^\t+", "")
    rows = (
        lines.filter("line > 1").select("file", "line", depth.alias("_depth"), body.alias("_body"))
        .filter("trim(_body) <> '' and not startswith(_body, '#')")
        .withColumn("_c", F.split("_body", "\t")).withColumn("_k", F.col("_c")[0]))
    first = F.min(F.when(F.col("_depth") == 0, F.col("line")))
    mark = F.min(F.when((F.col("_depth") == 1) & (F.col("_k") == "escaped-names"), F.col("line")))
    escaped = rows.groupBy("file").agg(F.coalesce(mark < F.coalesce(first, F.lit(1 << 62)), F.lit(False)).alias("_esc"))
    rows = rows.join(_headers(lines, source, target), "file").join(escaped, "file")
    wanted = (
        ((F.col("_depth") == 0) & (F.col("_k") == "c")) | ((F.col("_depth") == 1) & F.col("_k").isin("f", "m"))
        | ((F.col("_depth") == 2) & (F.col("_k") == "p")))
    skip = F.when(F.col("_k") == "c", 1).otherwise(2)
    decode = lambda x: F.when(F.col("_esc"), _unescape(x)).otherwise(x)
    at = lambda i: F.when(wanted, decode(F.try_element_at("_c", (skip + i).cast("int"))))
    rows = rows.withColumns({
        "_from": at(F.col("_src")), "_to": at(F.col("_dst")), "_first": at(F.lit(1)), "_desc": decode(F.get("_c", F.lit(1)))})
    # the class and the method in force after each row; null after any other row of their depth
    top = F.when(F.col("_depth") == 0, F.struct(
        F.when((F.col("_k") == "c") & (F.col("_from") != ""), F.col("_from")).alias("v")))
    method = F.when(F.col("_depth") <= 1, F.struct(
        F.when((F.col("_depth") == 1) & (F.col("_k") == "m"), F.struct(
            F.col("_from").alias("name"), F.col("_desc").alias("descriptor"))).alias("v")))
    rows = cut(last_seen(cut(rows), ["file"], "line", top, "_owner"))
    rows = last_seen(rows, ["file"], "line", method, "_method")
    owner, parent = F.col("_owner.v"), F.col("_method.v")
    kept = wanted & (
        (F.col("_k") == "c") | (owner.isNotNull() & ((F.col("_depth") == 1) | parent.isNotNull())))
    is_p, is_c, none = F.col("_k") == "p", F.col("_k") == "c", F.lit(None).cast("string")
    kind = F.create_map(*[F.lit(x) for x in ("c", "class", "f", "field", "m", "method", "p", "param")])
    fail = F.raise_error(F.concat(F.lit("short mapping row at line "), F.col("line").cast("string"))).cast("string")
    flat = cut(rows.filter(kept).select(
        "file", "line", kind[F.col("_k")].alias("kind"),
        F.when(is_c, F.col("_from")).otherwise(owner).alias("owner"),
        F.when(is_c, none).when(is_p, parent["name"]).otherwise(F.col("_from")).alias("name"),
        F.when(is_c, none).when(is_p, parent["descriptor"]).otherwise(F.col("_desc")).alias("_descriptor"),
        F.when(is_p, F.get("_c", F.lit(1)).cast("int")).alias("lv_index"), "_from", "_first",
        F.when(F.size("_c") < skip + F.col("_n"), fail).otherwise(F.col("_to")).alias("target")))
    shifts = flat.filter("kind = 'class' and _first <> '' and _from <> '' and _first <> _from").select(
        "file", F.col("_first").alias("old"), F.col("_from").alias("new")).distinct()
    flat = remap_descriptors(flat, "_descriptor", shifts, "descriptor", ["file"])
    real = flat.filter("target <> '' and _from <> target and (kind = 'param' or _from <> '')")
    key = ["file", "kind", "owner", "name", "descriptor", "lv_index"]
    clash = F.raise_error(F.concat(F.lit("contradicting renames of "), F.concat_ws(" ", F.min("owner"), F.min("name")))).cast("string")
    return real.groupBy(*key).agg(F.when(F.min("target") != F.max("target"), clash).otherwise(F.min("target")).alias("target"))


def parameter_names_in_phases(mapping: DataFrame) -> DataFrame:
    """Parameter rows under the old and the new key of their method.

    While renaming is under way a method may be looked up by any mix of old
    and new owner, name and descriptor.
    """
    key = ["file", "owner", "name", "descriptor"]
    classes = mapping.filter("kind = 'class'").select("file", F.col("owner").alias("old"), F.col("target").alias("new"))
    params = mapping.filter("kind = 'param'").select(*key, "lv_index", "target")
    methods = mapping.filter("kind = 'method'").select(*key, F.col("target").alias("_name"))
    rows = (
        remap_descriptors(params, "descriptor", classes, "_desc", ["file"])
        .join(methods, key, "left")
        .join(classes.select("file", F.col("old").alias("owner"), F.col("new").alias("_owner")), ["file", "owner"], "left"))
    for old, new in (("owner", "_owner"), ("name", "_name"), ("descriptor", "_desc")):
        both = F.array_distinct(F.array(F.col(old), F.coalesce(new, old)))
        rows = rows.withColumn(old, F.explode(both))
    return rows.select(*key, "lv_index", "target").distinct()


def parse_parameter_names(lines: DataFrame) -> DataFrame:
    """(class, method, descriptor, slot, param) from ``class method desc p1 p2 ...`` rows.

    Rows with fewer than four columns are skipped; a name is repeated once per
    stack slot of its type.  A method has few parameters, so the positions are
    numbered inside the row's own array.
    """
    parts = F.split("value", " ")
    rows = lines.select(parts.alias("_p")).filter(F.size("_p") >= 4).select(
        F.col("_p")[0].alias("class"), F.col("_p")[1].alias("method"), F.col("_p")[2].alias("descriptor"),
        F.slice("_p", F.lit(4), F.size("_p")).alias("_names"))
    rows = rows.withColumn("_types", parameters(F.col("descriptor")))
    wide = F.flatten(F.zip_with(
        "_names", "_types", lambda n, t: F.array_repeat(n, slot_width(t).cast("int"))))
    return rows.select("class", "method", "descriptor", F.posexplode(wide).alias("slot", "param")).filter("param is not null")


