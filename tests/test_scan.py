"""Scans against brute force, with slices small enough that a hot group spans many."""

import pandas as pd
from conftest import order, rows
from pyspark.sql import functions as F

from classlake import scan


def hot(rng, n=300):
    """One unit holds two thirds of the rows."""
    out = []
    for unit, size in (("hot", n * 2 // 3), ("a", n // 6), ("b", n // 6)):
        for i in range(size):
            out.append((unit, i, rng.choice([None, rng.randrange(9)])))
    rng.shuffle(out)
    return pd.DataFrame(out, columns=["unit", "idx", "v"]).astype({"v": "Int64"})


def frame(spark, pdf):
    data = [tuple(None if pd.isna(x) else (int(x) if not isinstance(x, str) else x) for x in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(data, "unit string, idx long, v long")


def test_running_sum_and_max(spark, rng):
    pdf = hot(rng)
    df = frame(spark, pdf)
    s = pdf.sort_values(["unit", "idx"])
    want = s.assign(o=s["v"].fillna(0).groupby(s["unit"]).cumsum())
    got = rows(scan.running_sum(df, ["unit"], "idx", F.coalesce("v", F.lit(0)), "o", width=7), "unit", "idx", "o")
    assert got == sorted((r.unit, r.idx, int(r.o)) for r in want.itertuples())
    best = s.assign(o=s["v"].fillna(-1).groupby(s["unit"]).cummax())
    got = rows(scan.running_max(df, ["unit"], "idx", F.col("v"), "o", width=7), "unit", "idx", "o")
    assert got == sorted(((r.unit, r.idx, None if r.o < 0 else int(r.o)) for r in best.itertuples()), key=order)


def test_last_seen(spark, rng):
    pdf = hot(rng).sort_values(["unit", "idx"])
    df = frame(spark, pdf)
    for inclusive in (True, False):
        col = pdf.groupby("unit")["v"].ffill()
        if not inclusive:
            col = col.groupby(pdf["unit"]).shift(1)
        want = sorted(((u, i, None if pd.isna(v) else int(v)) for u, i, v in zip(pdf["unit"], pdf["idx"], col)), key=order)
        got = rows(scan.last_seen(df, ["unit"], "idx", F.col("v"), "o", inclusive, width=5), "unit", "idx", "o")
        assert got == want


def test_ranks(spark, rng):
    pdf = hot(rng)
    df = frame(spark, pdf).withColumn("t", F.col("idx") * 3)
    got = rows(scan.ranked(df, ["unit"], ["t"], "r", scan.sliced("t", 11)), "unit", "idx", "r")
    assert got == sorted((u, i, i) for u, i in zip(pdf["unit"], pdf["idx"]))
    got = rows(scan.global_rank(df.repartition(5), ["unit", "idx"], "r"), "unit", "idx", "r")
    keys = sorted(zip(pdf["unit"], pdf["idx"]))
    assert got == [(u, i, n) for n, (u, i) in enumerate(keys)]


def test_interval_join(spark, rng):
    pts = [(u, i) for u in ("hot", "a") for i in range(120 if u == "hot" else 20)]
    rgs = [(u, lo, lo + rng.randrange(0, 40)) for u in ("hot", "a") for lo in rng.sample(range(100), 15)]
    got = rows(
        scan.interval_join(spark.createDataFrame(pts, "unit string, idx long"),
                           spark.createDataFrame(rgs, "unit string, lo long, hi long"), ["unit"], "idx", "lo", "hi", bucket=8),
        "unit", "idx", "lo", "hi")
    assert got == sorted(((u, i, lo, hi) for u, i in pts for v, lo, hi in rgs if u == v and lo <= i < hi), key=order)


def test_first_by_is_deterministic(spark, rng):
    data = [(k, rng.randrange(5), i) for i, k in enumerate("abcabcab" * 20)]
    df = spark.createDataFrame(data, "k string, o long, v long")
    want = rows(scan.first_by(df, ["k"], ["o", "v"]), "k", "o", "v")
    again = rows(scan.first_by(df.orderBy(F.rand(3)).repartition(13), ["k"], ["o", "v"]), "k", "o", "v")
    assert want == again == sorted(min((x for x in data if x[0] == k), key=lambda x: x[1:]) for k in "abc")


def test_a_wide_range_over_few_points_is_not_multiplied(spark):
    wide = spark.createDataFrame([("u", 0, 64_000_000), ("u", 10, 11), ("u", 5, 5)], "unit string, lo long, hi long")
    points = spark.createDataFrame([("u", 10), ("u", 63_999_999), ("u", 64_000_000), ("v", 1)], "unit string, idx long")
    got = scan.interval_join(points, wide, ["unit"], "idx", "lo", "hi")
    assert rows(got, "idx", "lo", "hi") == [(10, 0, 64_000_000), (10, 10, 11), (63_999_999, 0, 64_000_000)]
    copies = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in copies and scan.interval_join(points, wide.filter("lo = 5"), ["unit"], "idx", "lo", "hi").isEmpty()
