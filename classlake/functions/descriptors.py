"""JVM descriptors and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: one parameter type of a descriptor.
PARAMETER = r"\[*(?:[BCDFIJSZ]|L[^;]+;)"


def parameters(descriptor: Column) -> Column:
    """Parameter types of ``(params)ret`` in order."""
    inside = F.regexp_extract(descriptor, r"^\((.*)\)", 1)
    return F.regexp_extract_all(inside, F.lit(PARAMETER), F.lit(0))


def return_type(descriptor: Column) -> Column:
    return F.substring_index(descriptor, ")", -1)


def slot_width(kind: Column) -> Column:
    """Stack slots of a type: long and double take two."""
    return F.when(kind.isin("J", "D"), 2).otherwise(1)


def slot_offsets(params: Column, static: Column) -> Column:
    """First slot of each parameter; slot 0 is the receiver unless static."""
    start = F.when(static, 0).otherwise(1).cast("int")
    return F.transform(
        params,
        lambda _, i: F.aggregate(
            F.slice(params, 1, i), start, lambda acc, t: acc + slot_width(t).cast("int")))


def source_signature(name: Column, descriptor: Column) -> Column:
    """Name and parameter part; without ``)`` the whole descriptor counts."""
    part = F.when(F.instr(descriptor, ")") > 0,
                  F.concat(F.substring_index(descriptor, ")", 1), F.lit(")"))).otherwise(descriptor)
    return F.concat_ws(" ", name, part)


def package_name(internal: Column) -> Column:
    """Everything before the last ``/``; empty for the default package."""
    return F.regexp_extract(internal, r"^(.*)/[^/]*$", 1)


def simple_name(internal: Column) -> Column:
    return F.substring_index(internal, "/", -1)


def with_simple_name(internal: Column, name: Column) -> Column:
    return F.concat(F.regexp_extract(internal, r"^(.*/)?", 0), name)


def unique_key(name: Column, descriptor: Column) -> Column:
    return F.concat_ws(" ", name, descriptor)


def remap_descriptors(df: DataFrame, descriptor: str, renames: DataFrame, out: str,
                      keys: list[str] | None = None) -> DataFrame:
    """Descriptors with class names replaced under ``renames(old, new)``,
    separately per ``keys``.

    Works on distinct descriptors, whose parts are few (a method has at most
    255 parameters), and joins the result back.
    """
    keys = keys or []
    distinct = df.select(*keys, descriptor).distinct()
    parts = distinct.select(
        *keys, descriptor, F.posexplode(F.regexp_extract_all(descriptor, F.lit("L[^;]+;|[^L]+"), F.lit(0))).alias("_at", "_part"))
    parts = parts.withColumn("old", F.regexp_extract("_part", "^L([^;]+);$", 1))
    named = parts.join(renames.select(*keys, "old", "new"), [*keys, "old"], "left")
    text = F.when(F.col("new").isNotNull(), F.concat(F.lit("L"), "new", F.lit(";"))).otherwise(F.col("_part"))
    rebuilt = named.groupBy(*keys, descriptor).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", text.alias("t")))), lambda x: x["t"]), "").alias(out))
    return df.join(rebuilt, [*keys, descriptor], "left")
