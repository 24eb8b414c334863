"""Ordered scans, ranks and interval joins that survive one very large group.

A plain window puts a whole group on one task.  Here a group is first cut
into slices of bounded width along its order; each slice is scanned on its own
and a much smaller table with one row per slice carries totals across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from classlake.iterate import cut

SLICE = 1 << 16
BUCKET = 64


def first_by(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per ``keys``: the least by ``order``.

    An aggregate with partial combine rather than ``row_number() = 1``, so a
    hot key is reduced before the shuffle.
    """
    payload = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}")
                      for i, o in enumerate(order)])
    if not payload:
        return df.select(*keys).distinct()
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*payload), rank).alias("_first"))
        .select(*keys, *[F.col("_first")[c].alias(c) for c in payload])
    )


def sliced(pos: str, width: int = SLICE) -> Column:
    """Slice number of an integer position."""
    return F.floor(F.col(pos) / F.lit(width)).cast("long")


def running_sum(df: DataFrame, keys: list[str], pos: str, value: Column, out: str,
                width: int = SLICE) -> DataFrame:
    """Inclusive running sum of ``value`` along ``pos`` inside ``keys``."""
    cut_up = df.withColumn("_scan_v", value.cast("long")).withColumn("_scan_s", sliced(pos, width))
    totals = cut_up.groupBy(*keys, "_scan_s").agg(F.sum("_scan_v").alias("_scan_t"))
    before = Window.partitionBy(*keys).orderBy("_scan_s").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_scan_s", F.coalesce(F.sum("_scan_t").over(before), F.lit(0)).alias("_scan_c"))
    inside = Window.partitionBy(*keys, "_scan_s").orderBy(pos).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        cut_up.withColumn("_scan_r", F.sum("_scan_v").over(inside))
        .join(carry, [*keys, "_scan_s"])
        .withColumn(out, F.col("_scan_r") + F.col("_scan_c"))
        .select(*[c for c in df.columns if c != out], out)
    )


def running_max(df: DataFrame, keys: list[str], pos: str, value: Column, out: str,
                width: int = SLICE) -> DataFrame:
    """Inclusive running maximum of ``value`` (any ordered type) along ``pos``."""
    cut_up = df.withColumn("_scan_v", value).withColumn("_scan_s", sliced(pos, width))
    totals = cut_up.groupBy(*keys, "_scan_s").agg(F.max("_scan_v").alias("_scan_t"))
    before = Window.partitionBy(*keys).orderBy("_scan_s").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_scan_s", F.max("_scan_t").over(before).alias("_scan_c"))
    inside = Window.partitionBy(*keys, "_scan_s").orderBy(pos).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    top = F.when(F.col("_scan_c").isNull() | (F.col("_scan_r") >= F.col("_scan_c")), F.col("_scan_r"))
    return (
        cut_up.withColumn("_scan_r", F.max("_scan_v").over(inside))
        .join(carry, [*keys, "_scan_s"])
        .withColumn(out, F.coalesce(top, "_scan_c"))
        .select(*[c for c in df.columns if c != out], out)
    )


def last_seen(df: DataFrame, keys: list[str], pos: str, value: Column, out: str,
              inclusive: bool = True, width: int = SLICE, tie: str | None = None) -> DataFrame:
    """Last non-null ``value`` at or before (or strictly before) each row."""
    cut_up = df.withColumn("_scan_v", value).withColumn("_scan_s", sliced(pos, width))
    order = [pos] if tie is None else [pos, tie]
    at = F.when(F.col("_scan_v").isNotNull(), F.struct(*order))
    slices = cut_up.groupBy(*keys, "_scan_s").agg(F.max_by("_scan_v", at).alias("_scan_t"))
    before = Window.partitionBy(*keys).orderBy("_scan_s").rowsBetween(Window.unboundedPreceding, -1)
    carry = slices.select(*keys, "_scan_s", F.last("_scan_t", ignorenulls=True).over(before).alias("_scan_c"))
    inside = Window.partitionBy(*keys, "_scan_s").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    return (
        cut_up.withColumn("_scan_r", F.last("_scan_v", ignorenulls=True).over(inside))
        .join(carry, [*keys, "_scan_s"])
        .withColumn(out, F.coalesce("_scan_r", "_scan_c"))
        .select(*[c for c in df.columns if c != out], out)
    )


def neighbour(df: DataFrame, keys: list[str], pos: str, value: Column, out: str,
              offset: int) -> DataFrame:
    """``value`` of the row at ``pos + offset`` for dense integer positions.

    Positions are keys, so the neighbour is an equi-join and needs no window.
    """
    other = df.select(*keys, (F.col(pos) - F.lit(offset)).cast(df.schema[pos].dataType).alias(pos),
                      value.alias(out))
    return df.join(other, [*keys, pos], "left")


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str, slice_by: Column) -> DataFrame:
    """0-based rank inside ``keys``; ``slice_by`` grows with the first order column.

    Slices are counted first, so no task sorts more than one slice of a group.
    """
    cut_up = df.withColumn("_scan_s", slice_by)
    counts = cut_up.groupBy(*keys, "_scan_s").agg(F.count(F.lit(1)).alias("_scan_n"))
    if keys:
        before = Window.partitionBy(*keys).orderBy("_scan_s").rowsBetween(Window.unboundedPreceding, -1)
    else:
        before = Window.partitionBy(F.lit(0)).orderBy("_scan_s").rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select(*keys, "_scan_s", F.coalesce(F.sum("_scan_n").over(before), F.lit(0)).alias("_scan_c"))
    inside = Window.partitionBy(*keys, "_scan_s").orderBy(*order)
    return (
        cut_up.withColumn("_scan_r", F.row_number().over(inside) - 1)
        .join(carry, [*keys, "_scan_s"])
        .withColumn(out, (F.col("_scan_r") + F.col("_scan_c")).cast("long"))
        .drop("_scan_s", "_scan_r", "_scan_c")
    )


def global_rank(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """0-based rank of every row in one total order, without a single-task sort.

    Rows are range-partitioned by ``order`` and written once with their
    partition number; offsets come from one count per partition.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("_scan_p", F.spark_partition_id()))
    counts = placed.groupBy("_scan_p").agg(F.count(F.lit(1)).alias("_scan_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_scan_p").rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select("_scan_p", F.coalesce(F.sum("_scan_n").over(before), F.lit(0)).alias("_scan_c"))
    inside = Window.partitionBy("_scan_p").orderBy(*order)
    return (
        placed.withColumn("_scan_r", F.row_number().over(inside) - 1)
        .join(F.broadcast(carry), "_scan_p")  # one row per partition
        .withColumn(out, (F.col("_scan_r") + F.col("_scan_c")).cast("long"))
        .drop("_scan_p", "_scan_r", "_scan_c")
    )


def interval_join(points: DataFrame, ranges: DataFrame, keys: list[str], pos: str,
                  lo: str, hi: str, bucket: int = BUCKET) -> DataFrame:
    """Points with ``lo <= pos < hi`` in the same ``keys``.

    Both sides carry a bucket of the position, so the join key is narrow even
    when one group holds most rows.  Buckets double in size from ``bucket``
    up; a range takes the first size that holds it, so it touches two buckets
    at most however wide it is, and a point is copied once for each size in
    use (64 at most).
    """
    width = (F.col(hi) - F.col(lo)).cast("double")
    r = ranges.filter(F.col(hi) > F.col(lo)).withColumn("_scan_w", F.greatest(
        F.lit(float(bucket)), F.pow(F.lit(2.0), F.ceil(F.log2(width)).cast("double"))).cast("long"))
    sizes = sorted(x[0] for x in r.select("_scan_w").distinct().collect())
    at = lambda c: F.floor(c / F.col("_scan_w")).cast("long")
    p = points.withColumn("_scan_w", F.explode(F.array(*[F.lit(x).cast("long") for x in sizes]).cast("array<bigint>")))
    p = p.withColumn("_scan_b", at(F.col(pos)))
    r = r.withColumn("_scan_b", F.explode(F.sequence(at(F.col(lo)), at(F.col(hi) - 1))))
    return (
        p.join(r, [*keys, "_scan_w", "_scan_b"])
        .filter((F.col(pos) >= F.col(lo)) & (F.col(pos) < F.col(hi)))
        .drop("_scan_w", "_scan_b")
    )
