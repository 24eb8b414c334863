"""Loops over DataFrames: semi-naive fixpoints, pointer doubling, components.

Each round is an ordinary Spark job whose result is written to the shared work
folder, so lineage stays short and a lost executor re-reads files instead of
replaying earlier rounds.  The driver holds only round counters and booleans.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]

#: Bytes up to which a side of a loop's join is broadcast: every round sends its sides to the driver anew.
SENT = 128 * 1024

_LOCAL_DIRS: dict[str, str] = {}
_HOLDERS: list[Callable[[], None]] = []


def work_dir(spark: SparkSession) -> str:
    """Shared folder for loop state, as named by ``spark.checkpoint.dir``.

    A machine-local folder is used only when the setting is absent and the
    master is local (tests); on a cluster the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="classlake-")
        named = "file://" + _LOCAL_DIRS[app]
    return f"{named.rstrip('/')}/classlake-{spark.sparkContext.applicationId}"


def _drop(spark: SparkSession, path: str) -> None:
    """Delete a superseded round table of this module."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hadoop_path, True)


@contextmanager
def few_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Joins that run inside broadcast sides of at most ``SENT`` bytes.

    A broadcast passes the driver.  Files are far smaller than their rows and a
    loop has hundreds of joins, so the session's threshold lets gigabytes pass.
    A lower threshold of the session stays as it is.
    """
    number = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    main, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {main: spark.conf.get(main)}  # has a default, the other only a value that somebody set
    if (value := spark.conf.get(adaptive, None)) is not None:
        before[adaptive] = value
    for name, value in before.items():
        if not value.startswith("-"):  # negative: broadcasts are off
            spark.conf.set(name, str(min(SENT, number(value))))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _empty(df: DataFrame) -> bool:
    with few_broadcasts(df.sparkSession):
        return df.isEmpty()


def _write(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    with few_broadcasts(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the work folder and read it back: lineage ends here.

    Reading files back also gives the planner true sizes, so a side is
    broadcast only when its written size is at most ``SENT`` bytes.
    """
    return _write(df)[0]


def cut_by(df: DataFrame, column: str) -> DataFrame:
    """Like :func:`cut`, in folders by ``column``: a filter on it reads its folders alone."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    with few_broadcasts(spark):
        df.write.partitionBy(column).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fixpoint(
    seed: DataFrame,
    step: Step,
    hops: int = 4,
    depth: str | None = None,
) -> DataFrame:
    """Least set of rows that holds ``seed`` and is closed under ``step``.

    ``step`` maps rows to successor rows of the same schema and must
    distribute over union (each output row follows from one input row).
    ``depth`` names an output column for the least number of steps from the
    seed.

    A frontier is expanded ``hops`` times in one job; only rows first seen in
    the last hop feed the next round.  Rounds go on until nothing is new.
    """
    cols = seed.columns
    out = cols if depth is None else [*cols, depth]
    spark = seed.sparkSession
    frontier = cut(seed.distinct())
    reached = 0
    known = [frontier if depth is None else frontier.withColumn(depth, F.lit(0).cast("long"))]
    while True:
        layers = []
        current = frontier
        for hop in range(hops):
            current = step(current).select(cols).distinct()
            layers.append(current.withColumn("_hop", F.lit(hop)))
        found = _union(layers).groupBy(*cols).agg(F.min("_hop").alias("_hop"))
        if depth is not None:
            found = found.withColumn(depth, (F.col("_hop") + F.lit(reached + 1)).cast("long"))
        seen = _union(known).select(cols)
        fresh, path = _write(found.join(seen, cols, "left_anti"))
        reached += hops
        if fresh.isEmpty():
            _drop(spark, path)
            return _union(known)
        known.append(fresh.select(out))
        if len(known) > 24:
            known = [cut(_union(known))]
        frontier = fresh.filter(F.col("_hop") == hops - 1).select(cols)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def best_paths(
    seed: DataFrame,
    step: Step,
    keys: list[str],
    rank: str,
    hops: int = 3,
) -> DataFrame:
    """Like :func:`fixpoint`, but keeps one row per ``keys``: the least ``rank``.

    ``step`` must extend ranks monotonically.  Rows whose rank improves
    re-enter the frontier, so the result is exact on acyclic input however
    many rounds a better path takes to appear; improvement stops on cycles
    because extending a path never lowers its rank.
    """
    cols = seed.columns
    spark = seed.sparkSession
    payload = [c for c in cols if c not in keys]

    def least(df: DataFrame, extra: list[str]) -> DataFrame:
        kept = [*payload, *extra]
        return (
            df.groupBy(*keys)
            .agg(F.min_by(F.struct(*kept), F.col(rank)).alias("_p"))
            .select(*keys, *[F.col(f"_p.{c}").alias(c) for c in kept])
        )

    known, known_path = _write(least(seed.select(cols), []))
    frontier = known
    while True:
        layers = []
        current = frontier
        for hop in range(hops):
            current = least(step(current).select(cols), [])
            layers.append(current.withColumn("_hop", F.lit(hop)))
        found = least(_union(layers), ["_hop"])
        old = known.select(*keys, F.col(rank).alias("_old"))
        fresh, fresh_path = _write(
            found.join(old, keys, "left")
            .filter(F.col("_old").isNull() | (F.col(rank) < F.col("_old")))
            .select(*cols, "_hop")
        )
        if fresh.isEmpty():
            _drop(spark, fresh_path)
            return known
        merged, merged_path = _write(least(known.unionByName(fresh.select(cols)), []))
        _drop(spark, known_path)
        known, known_path = merged, merged_path
        # earlier hops were already expanded with the rank they were found with
        frontier = fresh.filter(F.col("_hop") == hops - 1).select(cols)
        if frontier.isEmpty():
            return known


def merged(seed: DataFrame, step: Step, keys: list[str], value: str, merge=F.max, hops: int = 3) -> DataFrame:
    """One row for each of ``keys``, whose ``value`` is merged with what arrives: least solution of a rising system.

    ``step`` maps rows to rows of the same schema and is monotone in ``value``;
    ``merge`` is an aggregate that is associative and idempotent (``F.max``,
    ``F.bit_or``).  Only rows that are new or rose go on, so a lattice of finite
    height ends the loop, on cycles as well.  What is known meets what arrives
    in one aggregate, which tells who rose as well.
    """
    cols = [*keys, value]
    fold = lambda df: df.select(cols).groupBy(*keys).agg(merge(value).alias(value))
    known, path = _write(fold(seed).withColumn("_rose", F.lit(True)))
    while True:
        best = known.filter("_rose").select(cols)
        for _ in range(hops):
            best = fold(best.unionByName(step(best).select(cols)))
        both = known.select(*cols, F.col(value).alias("_old")).unionByName(
            best.withColumn("_old", F.lit(None).cast(known.schema[value].dataType)))
        following, new_path = _write(
            both.groupBy(*keys).agg(merge(value).alias(value), merge("_old").alias("_old"))
            .select(*cols, (~F.col(value).eqNullSafe(F.col("_old"))).alias("_rose")))
        _drop(known.sparkSession, path)
        known, path = following, new_path
        if known.filter("_rose").isEmpty():
            return known.select(cols)


def folded_chains(links: DataFrame, node: str, target: str, keep: str, add: str) -> DataFrame:
    """(node, root, steps, keep, add): where each chain of links ends, and the bit rules on the way as one.

    ``links`` has at most one row for a node; a node turns the bits x that reach
    it from its target into ``x & keep | add``.  Two such rules in a row are one
    again, so each round doubles the reach of every link.  Nodes whose links
    lead into a cycle are left out.
    """
    one = F.lit(1).cast("long").alias("steps")
    current = cut(links.select(F.col(node).alias("node"), F.col(target).alias("root"), one,
                               F.col(keep).cast("long").alias("keep"), F.col(add).cast("long").alias("add")))
    ends = current.select(F.col("node").alias("root"))
    for _ in range(current.count().bit_length()):
        ahead = current.select(F.col("node").alias("root"), F.col("root").alias("_r"), F.col("steps").alias("_s"),
                               F.col("keep").alias("_k"), F.col("add").alias("_a"))
        if _empty(current.join(ahead, "root", "left_semi")):
            break
        mine, inner = F.col("keep"), F.coalesce("_k", F.lit(-1).cast("long"))
        current = cut(current.join(ahead, "root", "left").select(
            "node", F.coalesce("_r", "root").alias("root"), (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps"),
            mine.bitwiseAND(inner).alias("keep"),
            F.coalesce("_a", F.lit(0).cast("long")).bitwiseAND(mine).bitwiseOR(F.col("add")).alias("add")))
    return current.join(ends, "root", "left_anti").select("node", "root", "steps", "keep", "add")


def converge(state: DataFrame, step: Step, changed: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Apply ``step`` until ``changed(new, old)`` yields no row."""
    spark = state.sparkSession
    current, path = _write(state)
    while True:
        following, new_path = _write(step(current))
        still = not _empty(changed(following, current))
        _drop(spark, path)
        current, path = following, new_path
        if not still:
            return current


def until_settled(parts: list[DataFrame], keys: list[str], open_: Callable[..., DataFrame],
                  step: Callable[..., list[DataFrame]]) -> list[DataFrame]:
    """Rewrite groups of rows until each is settled; a group that is settled leaves the loop.

    ``parts`` are tables with the columns ``keys``, ``open_(*parts)`` names the
    groups that go on, ``step(*parts)`` gives the tables of those groups anew.
    A round reads and writes the groups that are still open alone: the rows of
    the others go once to the folder that the result is read from.
    """
    spark = parts[0].sparkSession
    done = [f"{work_dir(spark)}/{uuid.uuid4().hex}" for _ in parts]
    schemas = [p.schema for p in parts]
    held = [_write(p) for p in parts]
    while True:
        tables = [df for df, _ in held]
        on, on_path = _write(open_(*tables).select(*keys).distinct())
        for table, path in zip(tables, done, strict=True):
            with few_broadcasts(spark):
                table.join(on, keys, "left_anti").select(table.columns).write.mode("append").parquet(path)
        if on.isEmpty():
            following = []
        else:
            following = [_write(df.select(s.names)) for df, s in zip(
                step(*[t.join(on, keys, "left_semi").select(t.columns) for t in tables]), schemas, strict=True)]
        for path in [on_path, *(path for _, path in held)]:
            _drop(spark, path)
        if not following:
            return [spark.read.schema(s).parquet(path) for s, path in zip(schemas, done, strict=True)]
        held = following


def looping_passes(state: DataFrame, keys: list[str], passes: list[tuple[Step, bool]]) -> DataFrame:
    """Passes over every group of rows, in order: (pass, loops).

    Where a pass that loops changes a group, the group starts again at the first
    pass; a pass that does not loop goes on either way.  Groups are independent,
    and one that gets through to the end is done: later rounds do not read it.
    A pass must treat each group by itself; equal rows count.
    """
    on, path = _write(state)
    done: list[DataFrame] = []
    while True:
        again: list[DataFrame] = []
        for one, loops in passes:
            after, after_path = _write(one(on).select(state.columns))
            if loops:
                moved = cut(after.exceptAll(on).unionByName(on.exceptAll(after)).select(*keys).distinct())
                # a group without rows has nothing left to do
                again.append(cut(after.join(moved, keys, "left_semi").select(state.columns)))
                after, left_path = _write(after.join(moved, keys, "left_anti").select(state.columns))
                _drop(state.sparkSession, after_path)
                after_path = left_path
            _drop(state.sparkSession, path)
            on, path = after, after_path
        done.append(on)
        if not again or (following := _union(again)).isEmpty():
            return _union(done)
        on, path = _write(following)


def run_passes(state: DataFrame, passes: list[Step],
               changed: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """User-supplied passes over a frame, in order; with ``changed`` the whole
    chain repeats until that yields no row."""

    def once(df: DataFrame) -> DataFrame:
        for one in passes:
            df = df.transform(one)
        return df

    return once(state) if changed is None else converge(state, once, changed)


def pointer_double(links: DataFrame, keys: list[str], node: str, target: str) -> DataFrame:
    """Follow functional links to their end in logarithmically many rounds.

    ``links(keys, node, target)`` has at most one row per node and no cycle;
    the result maps each node to the last node of its chain and tells the
    number of ``steps`` to it.
    """
    cols = [*keys, node, target, "steps"]

    def step(cur: DataFrame) -> DataFrame:
        ahead = cur.select(*keys, F.col(node).alias(target), F.col(target).alias("_t2"),
                           F.col("steps").alias("_s2"))
        return (
            cur.join(ahead, [*keys, target], "left")
            .select(*keys, node, F.coalesce("_t2", target).alias(target),
                    (F.col("steps") + F.coalesce("_s2", F.lit(0))).alias("steps"))
        )

    def changed(new: DataFrame, old: DataFrame) -> DataFrame:
        was = old.select(*keys, node, F.col(target).alias("_was"))
        return new.join(was, [*keys, node]).filter(F.col(target) != F.col("_was"))

    return converge(
        links.select(*keys, node, target, F.lit(1).cast("long").alias("steps")), step, changed
    ).select(cols)


def chain_starts(links: DataFrame, keys: list[str], node: str, target: str) -> DataFrame:
    """Where functional links end: (keys, node, target); nodes whose links lead into a cycle are left out.

    Doubles the length of every hop, so n links in a row take log2(n) rounds;
    what still moves after that is on the way into a cycle.
    """
    current, path = _write(links.select(*keys, node, target))
    spark = links.sparkSession
    for _ in range(current.count().bit_length()):
        ahead = current.select(*keys, F.col(node).alias(target), F.col(target).alias("_t2"))
        moved, new_path = _write(
            current.join(ahead, [*keys, target], "left")
            .select(*keys, node, F.coalesce("_t2", target).alias(target), F.col("_t2").isNotNull().alias("_moved")))
        still = not moved.filter("_moved").isEmpty()
        _drop(spark, path)
        current, path = moved.drop("_moved"), new_path
        if not still:
            break
    linked = links.select(*keys, F.col(node).alias(target))
    return current.join(linked, [*keys, target], "left_anti").select(*keys, node, target)


def looping(links: DataFrame, keys: list[str], node: str, target: str) -> DataFrame:
    """Nodes of a functional graph whose chain never ends: (keys, node).

    After as many doublings as the longest possible chain needs, a chain that
    ends points at a node without a link; the others lead into a cycle.
    """
    current = cut(links.select(*keys, node, target))
    size = current.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(size).bit_length()):
        ahead = current.select(*keys, F.col(node).alias(target), F.col(target).alias("_t2"))
        current = cut(
            current.join(ahead, [*keys, target], "left")
            .select(*keys, node, F.coalesce("_t2", target).alias(target)))
    linked = links.select(*keys, F.col(node).alias(target))
    return current.join(linked, [*keys, target], "left_semi").select(*keys, node)


def ancestors(links: DataFrame, keys: list[str], node: str, target: str, out: str) -> DataFrame:
    """All (keys, node, out) with ``out`` strictly up the functional, acyclic links.

    Doubles the reach of every row per round, so a chain of length n takes
    about log2(n) rounds.
    """
    jump = links.select(*keys, node, F.col(target).alias("_j"))
    pairs = cut(jump.select(*keys, node, F.col("_j").alias(out)))
    jump = cut(jump)
    while True:
        ahead = pairs.select(*keys, F.col(node).alias("_j"), F.col(out).alias("_o"))
        grown = cut(
            pairs.unionByName(
                jump.join(ahead, [*keys, "_j"]).select(*keys, node, F.col("_o").alias(out)))
            .distinct())
        further = jump.select(*keys, F.col(node).alias("_j"), F.col("_j").alias("_j2"))
        jump = cut(jump.join(further, [*keys, "_j"]).select(*keys, node, F.col("_j2").alias("_j")))
        pairs = grown
        if jump.isEmpty():
            return pairs


def components(edges: DataFrame, a: str, b: str, nodes: DataFrame | None = None,
               node: str = "node") -> DataFrame:
    """Connected components: (node, component) with the least node as label.

    Alternates the two "star" contractions until every edge points straight
    at a component minimum.  A round only aggregates minima (combined before
    the shuffle) and joins them back, so a hub with very many neighbours is
    never gathered in one place.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    current, path = _write(
        pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    spark = edges.sparkSession
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select(F.col("u"), F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        )
        mid, mid_path = _write(large)
        small_low = mid.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            mid.join(small_low, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                      F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").filter("u <> v").distinct()
        )
        following, next_path = _write(small)
        _drop(spark, path)
        _drop(spark, mid_path)
        current, path = following, next_path
        tops = current.select(F.col("v").alias("u")).distinct()
        chained = current.select("u").join(tops, "u", "left_semi")
        forked = current.groupBy("u").count().filter("count > 1").select("u")
        if _empty(chained.unionByName(forked)):
            break
    labelled = current.select(F.col("u").alias(node), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias(node), F.col("v").alias("component")).distinct()
    found = labelled.unionByName(roots)
    if nodes is None:
        return found
    single = nodes.select(node).distinct().join(found.select(node), node, "left_anti")
    return found.unionByName(single.select(node, F.col(node).alias("component")))


def strong_components(edges: DataFrame, nodes: DataFrame, hops: int = 4) -> DataFrame:
    """Strongly connected components: (node, component), label = least node.

    Chains of nodes with one way in and one way out are folded first, in
    logarithmically many rounds, which shortens every later walk.  Nodes
    without an incoming or outgoing live edge are trimmed as singletons; the
    rest is coloured with the least node that reaches it, and the nodes of a
    colour that reach the colour's own node form one component.
    ``edges(src, dst)``, ``nodes(node)``.
    """
    live = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    once = lambda c: live.groupBy(F.col(c).alias("node")).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("node")
    mid = cut(once("src").join(once("dst"), "node"))
    out = cut(live.join(mid.select(F.col("node").alias("src")), "src", "left_semi").select(
        F.col("src").alias("n"), F.col("dst").alias("t")))
    ring = cut(looping(out, [], "n", "t"))
    ahead = pointer_double(out.join(ring, "n", "left_anti"), [], "n", "t")
    into = live.join(mid.select(F.col("node").alias("dst")), "dst", "left_semi").select(
        F.col("dst").alias("n"), F.col("src").alias("t")).join(ring, "n", "left_anti")
    behind = pointer_double(into, [], "n", "t")
    core = cut(
        live.join(mid.select(F.col("node").alias("src")), "src", "left_anti")
        .join(ahead.select(F.col("n").alias("dst"), F.col("t").alias("_e")), "dst", "left")
        .select("src", F.coalesce("_e", "dst").alias("dst")).filter("src <> dst").distinct())
    found = _core_components(core, hops)
    ends = (
        ahead.select(F.col("n").alias("node"), F.col("t").alias("_e"))
        .join(behind.select(F.col("n").alias("node"), F.col("t").alias("_s")), "node"))
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias("_c" + c))
    inner = (
        ends.join(of("_e"), "_e", "left").join(of("_s"), "_s", "left")
        .withColumn("_ce", F.coalesce("_c_e", "_e")).withColumn("_cs", F.coalesce("_c_s", "_s"))
        .filter("_ce = _cs"))
    # a core node whose only cycle runs through folded chains is named by them
    hubs = inner.select(F.col("_ce").alias("node"), F.col("_ce").alias("component")).distinct()
    loops = components(
        out.join(ring, "n", "left_semi"), "n", "t")
    grouped = found.unionByName(
        hubs.join(found.select("node"), "node", "left_anti")).unionByName(
        inner.select("node", F.col("_ce").alias("component"))).unionByName(loops)
    grouped = cut(grouped)
    label = grouped.groupBy("component").agg(F.min("node").alias("label"))
    named = grouped.join(label, "component").select("node", F.col("label").alias("component"))
    every = nodes.select("node").distinct()
    single = every.join(named.select("node"), "node", "left_anti")
    return named.unionByName(single.select("node", F.col("node").alias("component")))


def _core_components(live: DataFrame, hops: int) -> DataFrame:
    """Components of more than one node, labelled by their colour."""
    left = -1
    done: list[DataFrame] = []
    while True:
        while True:
            trimmed = live
            for _ in range(2):
                heads = trimmed.select(F.col("dst").alias("src")).distinct()
                tails = trimmed.select(F.col("src").alias("dst")).distinct()
                trimmed = (trimmed.join(heads, "src", "left_semi").join(tails, "dst", "left_semi")
                           .select("src", "dst"))
            before = left
            live = cut(trimmed)
            left = live.count()
            if left == before or left == 0:
                break
        if left == 0:
            break
        colour = _least_reaching(live, hops)
        cs = colour.select(F.col("node").alias("src"), F.col("colour").alias("c1"))
        cd = colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2"))
        inner = cut(live.join(cs, "src").join(cd, "dst").filter("c1 = c2").select("src", "dst"))
        back = inner.select(F.col("dst").alias("node"), F.col("src").alias("prev"))
        member = fixpoint(
            colour.filter("node = colour"),
            lambda f: f.join(back, "node").select(F.col("prev").alias("node"), "colour"),
            hops,
        )
        member = cut(member.select("node", F.col("colour").alias("component")))
        done.append(member)
        gone = member.select("node")
        live = cut(live.join(gone.select(F.col("node").alias("src")), "src", "left_anti")
                   .join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")
                   .select("src", "dst"))
    if not done:
        return live.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return _union(done)


def _least_reaching(edges: DataFrame, hops: int) -> DataFrame:
    """(node, colour): least node from which ``node`` can be reached."""
    ends = edges.select(F.col("src").alias("node")).unionByName(
        edges.select(F.col("dst").alias("node"))).distinct()
    spark = edges.sparkSession
    known, path = _write(ends.select("node", F.col("node").alias("colour")))
    frontier = known
    while True:
        best = frontier
        for _ in range(hops):
            pushed = (best.join(edges, best["node"] == edges["src"])
                      .select(F.col("dst").alias("node"), "colour"))
            best = best.unionByName(pushed).groupBy("node").agg(F.min("colour").alias("colour"))
        old = known.select("node", F.col("colour").alias("_old"))
        fresh = cut(best.join(old, "node").filter(F.col("colour") < F.col("_old"))
                    .select("node", "colour"))
        if fresh.isEmpty():
            return known
        merged, new_path = _write(known.unionByName(fresh).groupBy("node")
                                  .agg(F.min("colour").alias("colour")))
        _drop(spark, path)
        known, path = merged, new_path
        frontier = fresh


def levels(edges: DataFrame, nodes: DataFrame, hops: int = 4) -> DataFrame:
    """Longest distance from a source node in an acyclic graph: (node, level).

    Levels rise along edges until none rises.  After many rounds a cycle is
    looked for once, and is an error.
    """
    spark = edges.sparkSession
    arcs = cut(edges.select(F.col("src").alias("node"), F.col("dst").alias("_to")).distinct())
    if not arcs.filter("node = _to").isEmpty():
        raise ValueError("cycle: a node precedes itself")
    known, path = _write(nodes.select("node").distinct().withColumn("level", F.lit(0).cast("long")))
    frontier = known
    turn = 0
    while True:
        best = frontier
        for _ in range(hops):
            risen = best.join(arcs, "node").select(
                F.col("_to").alias("node"), (F.col("level") + 1).alias("level"))
            best = best.unionByName(risen).groupBy("node").agg(F.max("level").alias("level"))
        old = known.select("node", F.col("level").alias("_old"))
        fresh = cut(best.join(old, "node").filter("level > _old").select("node", "level"))
        if fresh.isEmpty():
            return known
        merged, new_path = _write(
            known.unionByName(fresh).groupBy("node").agg(F.max("level").alias("level")))
        _drop(spark, path)
        known, path = merged, new_path
        frontier = fresh
        turn += 1
        if turn == 8:
            comp = strong_components(edges, nodes)
            if not comp.filter("node <> component").isEmpty():
                raise ValueError("cycle: nodes precede themselves")


def wavefront(levels: DataFrame, step: Callable[[int, DataFrame], tuple[DataFrame, DataFrame]], sent: str) -> DataFrame:
    """Work through an acyclic graph level by level; what one level decides is input of the later ones.

    ``levels(node, level)``.  ``step(level, rows)`` gets the rows that earlier
    levels sent to this one and returns its result and the rows it sends on,
    with the schema ``sent``, which has a column ``level`` for their receiver's.
    Rows sent are written in folders by that level, so each is written once and
    read once.  The union of the results is returned.
    """
    spark = levels.sparkSession
    last = levels.agg(F.max("level")).first()[0]
    paths: list[str] = []
    results: list[DataFrame] = []
    none = spark.createDataFrame([], sent)
    for level in range(0, -1 if last is None else int(last) + 1):
        rows = _union([none, *(spark.read.schema(none.schema).parquet(p).filter(F.col("level") == level) for p in paths)])
        done, on = step(level, rows)
        results.append(done)
        if level < last:
            paths.append(f"{work_dir(spark)}/{uuid.uuid4().hex}")
            with few_broadcasts(spark):
                on.select(none.columns).write.partitionBy("level").parquet(paths[-1])
    if not results:
        return step(0, none)[0]
    return _union(results)


def clear(spark: SparkSession) -> None:
    """Delete everything this application wrote to the work folder.

    Frames returned earlier may still read from it, so call it at the end.
    What holds such frames is told by :func:`on_clear`.
    """
    _drop(spark, work_dir(spark))
    for forget in _HOLDERS:
        forget()


def on_clear(forget: Callable[[], None]) -> None:
    """Have ``forget`` called whenever the work folder is deleted."""
    _HOLDERS.append(forget)
