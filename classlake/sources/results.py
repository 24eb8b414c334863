"""Result sinks and output path rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from classlake.scan import first_by


def first_writes(results: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first write of each entry; later ones are skipped."""
    return first_by(results, keys, order)


def repeated_writes(results: DataFrame, keys: list[str]) -> DataFrame:
    """Entries written more than once, for the warning: keys + (writes,)."""
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("writes")).filter("writes > 1")


def safe_path(path: Column) -> Column:
    """No NUL, backslash, drive letter or absolute path, and never above the root.

    Each ``..`` lowers the depth by one; it must never fall below the root.
    """
    parts = F.split(path, "/")
    step = lambda p: F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)
    lowest = F.aggregate(
        parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda acc, p: F.struct(
            (acc["d"] + step(p)).alias("d"), F.least(acc["low"], acc["d"] + step(p)).alias("low")),
        lambda acc: acc["low"])
    unsafe = (
        (F.instr(path, "\x00") > 0) | path.contains("\\") | path.rlike(r"^\p{L}:") | path.startswith("/"))
    return ~unsafe & (lowest >= 0)


def save_text(results: DataFrame, path: str, order: list[str]) -> None:
    """Write (unit_id, line) rows as text below one folder per unit, in order.

    Range partitioning by unit and order lets one unit span many files, whose
    names sort in the order of its lines.
    """
    (
        results.repartitionByRange("unit_id", *order).sortWithinPartitions("unit_id", *order)
        .select("unit_id", F.col("line").alias("value"))
        .write.partitionBy("unit_id").mode("errorifexists").text(path))


def save_table(results: DataFrame, path: str, by: str = "unit_id") -> None:
    """Write result rows as Parquet below one folder per unit."""
    results.write.partitionBy(by).mode("errorifexists").parquet(path)


# ---------------------------------------------------------------- extension points

Source = Callable[[SparkSession, str], DataFrame]
Sink = Callable[[DataFrame, str], None]
SOURCES: dict[str, Source] = {}
SINKS: dict[str, Sink] = {"text": lambda df, p: save_text(df, p, ["ord"]), "table": save_table}


def register_source(name: str, read: Source) -> None:
    SOURCES[name] = read


def register_sink(name: str, write: Sink) -> None:
    SINKS[name] = write
