import itertools

import pytest
from conftest import order, rows
from pyspark.sql import functions as F

from classlake import iterate


def edges(spark, data, a="src", b="dst"):
    return spark.createDataFrame(data or [(0, 0)], f"{a} long, {b} long").filter("true" if data else "false")


def reach(data, start):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for a, b in data:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_fixpoint_and_depth(spark, rng):
    data = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)]
    out = edges(spark, data).select(F.col("src").alias("n"), F.col("dst").alias("_to")).distinct()
    seed = spark.createDataFrame([(0,)], "n long")
    got = iterate.fixpoint(seed, lambda f: f.join(out, "n").select(F.col("_to").alias("n")), hops=3, depth="d")
    dist, layer = {0: 0}, [0]
    while layer:
        nxt = []
        for x in layer:
            for a, b in data:
                if a == x and b not in dist:
                    dist[b] = dist[x] + 1
                    nxt.append(b)
        layer = nxt
    assert rows(got, "n", "d") == sorted(dist.items())


def test_components_with_hub(spark, rng):
    data = [(0, i) for i in range(1, 40)] + [(50 + i, 51 + i) for i in range(20)] + [(90, 90)]
    got = dict(rows(iterate.components(edges(spark, data), "src", "dst", spark.createDataFrame([(n,) for n in (0, 60, 90, 99)], "node long")), "node", "component"))
    assert {got[i] for i in range(40)} == {0}
    assert {got[i] for i in range(50, 71)} == {50}
    assert got[90] == 90 and got[99] == 99


def test_strong_components_small(spark):
    data = [(0, 1), (1, 0), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 3)]
    got = dict(rows(iterate.strong_components(edges(spark, data), spark.createDataFrame([(i,) for i in range(8)], "node long")), "node", "component"))
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 3, 6: 3, 7: 3}


def test_strong_components_random(spark, rng):
    data = [(rng.randrange(25), rng.randrange(25)) for _ in range(34)]
    nodes = range(25)
    got = dict(rows(iterate.strong_components(edges(spark, data), spark.createDataFrame([(i,) for i in nodes], "node long")), "node", "component"))
    r = {n: reach(data, n) for n in nodes}
    assert got == {n: min(m for m in r[n] if n in r[m]) for n in nodes}


def test_pointer_double_ancestors_looping(spark):
    chain = [(i, i + 1) for i in range(13)]
    links = edges(spark, chain, "n", "t").withColumn("u", F.lit(1))
    assert rows(iterate.pointer_double(links, ["u"], "n", "t"), "n", "t", "steps") == [(i, 13, 13 - i) for i in sorted(range(13), key=lambda i: i)]
    got = rows(iterate.ancestors(links, ["u"], "n", "t", "a"), "n", "a")
    assert got == sorted(((a, b) for a, b in itertools.combinations(range(14), 2)), key=order)
    loop = edges(spark, [(0, 1), (1, 2), (2, 1), (5, 6), (6, 7), (9, 9)], "n", "t").withColumn("u", F.lit(1))
    assert rows(iterate.looping(loop, ["u"], "n", "t"), "n") == [(0,), (1,), (2,), (9,)]


def test_levels(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node long")
    got = dict(rows(iterate.levels(edges(spark, [(0, 1), (1, 2), (0, 2), (2, 3), (4, 3)]), nodes), "node", "level"))
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 5: 0}
    with pytest.raises(ValueError):
        iterate.levels(edges(spark, [(0, 1), (1, 2), (2, 0)]), nodes)


def test_passes_run_once_or_until_nothing_changes(spark):
    df = spark.createDataFrame([(1, 5), (2, 0)], "k long, v long")
    down = lambda d: d.withColumn("v", F.greatest(F.col("v") - 2, F.lit(0)))
    more = lambda d: d.withColumn("v", F.when(F.col("v") == 1, 0).otherwise(F.col("v")))
    assert rows(iterate.run_passes(df, [down, more]), "k", "v") == [(1, 3), (2, 0)]
    moved = lambda new, old: new.join(old.select("k", F.col("v").alias("w")), "k").filter("v <> w")
    assert rows(iterate.run_passes(df, [down, more], moved), "k", "v") == [(1, 0), (2, 0)]


def test_work_dir_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        applicationId = "app"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        iterate.work_dir(Session())


def test_looping_passes_restart_changed_groups(spark):
    """Each group goes its own way: halve while even (loops), raise to five (loops), mark (does not)."""
    data = [(k, v) for k, v in enumerate((0, 1, 7, 8, 9, 40, 63, 64))] + [(3, 8), (3, 5)]

    def one(values):
        while True:
            for change in (lambda v: v // 2 if v > 0 and v % 2 == 0 else v, lambda v: 5 if v < 5 else v):
                after = sorted(map(change, values))
                if after != values:
                    break
            else:
                return [*values, -1]
            values = after

    halve = lambda d: d.withColumn("v", F.when((F.col("v") > 0) & (F.col("v") % 2 == 0), F.expr("v div 2")).otherwise(F.col("v")))
    more = lambda d: d.withColumn("v", F.when(F.col("v") < 5, 5).otherwise(F.col("v")))
    mark = lambda d: d.unionByName(d.select("k", F.lit(-1).cast("long").alias("v")).distinct())
    df = spark.createDataFrame(data, "k long, v long")
    want = sorted((k, v) for k in {k for k, _ in data} for v in one(sorted(v for q, v in data if q == k)))
    assert rows(iterate.looping_passes(df, ["k"], [(halve, True), (more, True), (mark, False)]), "k", "v") == want
    # a pass that does not loop changes a group without a restart, each time the chain gets to it
    twice = iterate.looping_passes(df, ["k"], [(mark, False), (halve, True)])
    marks = twice.filter("v = -1").groupBy("k").count()
    halvings = {k: max(bin(v)[::-1].index("1") if v else 0 for q, v in data if q == k) for k, _ in data}
    assert rows(marks, "k", "count") == sorted((k, n + 1) for k, n in halvings.items())
    assert iterate.looping_passes(df.limit(0), ["k"], [(halve, True)]).isEmpty()


def test_settled_groups_leave(spark):
    seen = []
    df = spark.createDataFrame([(k, k) for k in range(6)], "k long, v long")

    def step(part):
        seen.append(part.count())
        return [part.withColumn("v", F.col("v") - 1)]

    done, = iterate.until_settled([df], ["k"], lambda part: part.filter("v > 0").select("k"), step)
    assert rows(done, "k", "v") == [(k, 0) for k in range(6)]
    assert seen == [5, 4, 3, 2, 1]


def test_loops_broadcast_small_sides_alone(spark):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    right = spark.range(200_000).select(F.col("id").alias("n"), F.xxhash64("id").alias("h"))
    held, few = iterate.cut(right), iterate.cut(right.limit(10))
    plan = lambda side: spark.range(10).select(F.col("id").alias("n")).join(side, "n", "left")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(held)
    with iterate.few_broadcasts(spark):
        assert "BroadcastHashJoin" not in plan(held) and "BroadcastHashJoin" in plan(few)
    assert spark.conf.get(threshold) == before
    spark.conf.set(threshold, "-1")
    try:
        with iterate.few_broadcasts(spark):
            assert spark.conf.get(threshold) == "-1"
    finally:
        spark.conf.set(threshold, before)


def test_rounds_run_with_few_broadcasts(spark, monkeypatch):
    seen = []

    def step(f):
        seen.append(1)
        return f.select((F.col("n") + 1).alias("n")).filter("n < 6")

    inside = iterate.few_broadcasts
    monkeypatch.setattr(iterate, "few_broadcasts", lambda s: (seen.append(2), inside(s))[1])
    got = iterate.fixpoint(spark.range(1).select(F.col("id").alias("n")), step, hops=2)
    assert rows(got, "n") == [(k,) for k in range(6)] and 2 in seen
