"""Offsets, lines, local ranges, frames and text positions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classlake.scan import first_by, interval_join, last_seen, running_max


def line_of(pcs: DataFrame, lines: DataFrame) -> DataFrame:
    """``pcs(unit, pc)`` with ``line``: the last table row with ``start_pc <= pc``,
    -1 without one.

    The table is searched from its end, so among rows at or before ``pc`` the
    greatest ``ord`` wins; that is a running maximum along the offsets and
    needs no range join, sorted table or not.
    """
    best = lines.groupBy("unit", F.col("start_pc").alias("pc")).agg(F.max(F.struct("ord", "line")).alias("_row"))
    places = pcs.select("unit", "pc").distinct().withColumn("_asked", F.lit(True))
    seen = running_max(places.join(best, ["unit", "pc"], "full"), ["unit"], "pc", F.col("_row"), "_top")
    found = seen.filter("_asked").select("unit", "pc", F.coalesce("_top.line", F.lit(-1)).alias("line"))
    return pcs.join(found, ["unit", "pc"])


def visible_locals(uses: DataFrame, ranges: DataFrame) -> DataFrame:
    """``uses(unit, slot, pc)`` with the first range that covers them.

    ``ranges(unit, slot, start_pc, length, name, ord)``, half-open.
    """
    spans = ranges.withColumn("_end", F.col("start_pc") + F.col("length"))
    hit = interval_join(uses, spans, ["unit", "slot"], "pc", "start_pc", "_end")
    first = first_by(hit.select("unit", "slot", "pc", "ord", "name"), ["unit", "slot", "pc"], ["ord"])
    return uses.join(first.select("unit", "slot", "pc", "name"), ["unit", "slot", "pc"], "left")


def contained_locals(ranges: DataFrame, regions: DataFrame) -> DataFrame:
    """Local ranges that lie wholly in ``regions(unit, lo, hi)`` (both ends included)."""
    after = regions.withColumn("_after", F.col("hi") + 1)
    return (
        interval_join(ranges, after, ["unit"], "start_pc", "lo", "_after")
        .filter(F.col("start_pc") + F.col("length") <= F.col("hi")).drop("_after"))


def slot_type(uses: DataFrame, frames: DataFrame) -> DataFrame:
    """``uses(unit, pc, slot)`` with ``type`` in the latest frame at or before pc;
    null when that frame lacks the slot, earlier frames are not consulted."""
    offsets = frames.select("unit", F.col("offset").alias("pc")).distinct().withColumn("_frame", F.col("pc"))
    places = uses.select("unit", "pc").distinct().join(offsets, ["unit", "pc"], "full")
    seen = last_seen(places, ["unit"], "pc", F.col("_frame"), "offset").select("unit", "pc", "offset")
    return (
        uses.join(seen, ["unit", "pc"], "left")
        .join(frames.select("unit", "offset", "slot", "type"), ["unit", "offset", "slot"], "left")
        .drop("offset"))


def offset_map(mappings: DataFrame) -> DataFrame:
    """First mapping per offset: (unit, offset, new_line)."""
    return first_by(mappings.select("unit", "offset", "ord", "new_line"), ["unit", "offset"], ["ord"]).select(
        "unit", "offset", "new_line")


def original_lines(lines: DataFrame, mapped: DataFrame) -> DataFrame:
    """(unit, line, new_line) for original lines.

    Line table rows whose offset is mapped count first, the last row of a line
    winning; a line still missing takes the least mapped offset that lies on it.
    """
    at = mapped.select("unit", F.col("offset").alias("start_pc"), "new_line")
    direct = lines.join(at, ["unit", "start_pc"]).groupBy("unit", "line").agg(
        F.max_by("new_line", "ord").alias("new_line"))
    found = line_of(mapped.select("unit", F.col("offset").alias("pc"), "new_line"), lines).filter("line > -1")
    fill = found.groupBy("unit", "line").agg(F.min_by("new_line", "pc").alias("new_line"))
    return direct.unionByName(fill.join(direct, ["unit", "line"], "left_anti"))


def unmapped_lines(lines: DataFrame, original: DataFrame) -> DataFrame:
    """Original lines no output line stands for."""
    return lines.select("unit", "line").distinct().join(original, ["unit", "line"], "left_anti")


def line_comments(original: DataFrame) -> DataFrame:
    """Comment per output line listing its distinct original lines in order."""
    return (
        original.select("unit", "new_line", "line").distinct().groupBy("unit", "new_line")
        .agg(F.concat(F.lit("// "), F.array_join(F.array_sort(F.collect_list("line")), " ")).alias("comment")))


def text_position(text: Column, index: Column) -> Column:
    """``line:column`` of a 0-based index, both counted from 1; separators that
    end the text before the index do not open a line."""
    before = F.substring(text, F.lit(1), index.cast("int"))
    head = F.regexp_replace(before, r"\n+\z", "")
    line = F.when(before == "", 1).when(head == "", 0).otherwise(
        F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1)
    back = F.instr(F.reverse(before), "\n")
    start = F.when(back == 0, 0).otherwise(F.length(before) - back + 1)
    return F.concat_ws(":", line.cast("string"), (index + 1 - start).cast("string"))


def mark_positions(texts: DataFrame, mark: str) -> DataFrame:
    """(class, start, pos) of every ``mark`` in ``texts(class, text)``, pos as :func:`text_position` has it.

    A text is taken apart into lines, and a line at the marks; running sums
    over the pieces give the places, so a long text costs no more per mark.
    """
    before = Window.partitionBy("class").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    lines = texts.select("class", F.posexplode(F.split("text", "\n")).alias("i", "s")).select(
        "class", "i", "s", F.coalesce(F.sum(F.length("s") + 1).over(before), F.lit(0)).alias("_begin"),
        F.max(F.when(F.col("s") != "", F.col("i") + 1)).over(before).alias("_filled"))
    pieces = lines.select(
        "class", "i", "_begin", "_filled", (F.size(F.split("s", re.escape(mark))) - 1).alias("_marks"),
        F.posexplode(F.split("s", re.escape(mark))).alias("k", "piece"))
    upto = Window.partitionBy("class", "i").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    at = F.sum(F.length("piece") + len(mark)).over(upto) - len(mark)
    found = pieces.withColumn("_at", at).filter("k < _marks")
    line = F.when((F.col("_at") > 0) | (F.col("_begin") == 0), F.col("i") + 1).otherwise(F.coalesce("_filled", F.lit(0)))
    return found.select(
        "class", (F.col("_begin") + F.col("_at")).cast("long").alias("start"),
        F.concat_ws(":", line.cast("string"), (F.col("_at") + 1).cast("string")).alias("pos"))


def token_links(tokens: DataFrame) -> DataFrame:
    """References with the first declaration of their target.

    ``tokens(class, start, kind, is_decl, owner, name, descriptor)``.
    """
    key = ["kind", "owner", "name", "descriptor"]
    first = first_by(
        tokens.filter("is_decl").select(*key, F.col("class").alias("decl_class"), F.col("start").alias("decl_start")),
        key, ["decl_class", "decl_start"])
    return tokens.filter("not is_decl").join(first, key, "left")


def parse_token_dump(lines: DataFrame) -> DataFrame:
    """Token dump lines ``(r:c, r:c) kind [flag] owner#name descriptor`` as rows."""
    pattern = r"^\((\d+):(\d+), (\d+):(\d+)\) (\w+)(?: \[(\w+)\])? ([^#\s]+)(?:#([^\s:(]+)[:]?(\S*))?"
    part = lambda i: F.regexp_extract("value", pattern, i)
    return lines.filter(F.col("value").rlike(pattern)).select(
        part(1).cast("int").alias("line"), part(2).cast("int").alias("col"),
        part(3).cast("int").alias("end_line"), part(4).cast("int").alias("end_col"),
        part(5).alias("kind"), (part(6) == "declaration").alias("is_decl"),
        part(7).alias("owner"), part(8).alias("name"), part(9).alias("descriptor"))
