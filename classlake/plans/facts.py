"""Fact tables derived from the given tables, one lazily built set per session and folder.

Facts that several operators read are written once to the work folder; all of
them are plain DataFrame expressions over the Parquet tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from classlake.iterate import cut, on_clear
from classlake.operators import blocks as B
from classlake.scan import ranked

_SETS: dict[tuple[str, str], "Facts"] = {}
on_clear(_SETS.clear)


def facts(spark: SparkSession, sf_dir: str) -> "Facts":
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SETS:
        _SETS[key] = Facts(spark, sf_dir)
    return _SETS[key]


class Facts:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ---- instruction streams and block graphs
    @cached_property
    def seq(self) -> DataFrame:
        e = self.table("events").select("user_id", "ts", "event_id", "event_type")
        r = ranked(e, ["user_id"], ["ts", "event_id"], "idx", F.date_trunc("hour", "ts"))
        size = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
        op = (
            F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), "goto")
            .when(F.col("event_type") == "error", "jump")
            .when((F.col("event_type") == "purchase") & (F.col("event_id") % 5 == 0), "return")
            .when(F.col("event_type") == "purchase", "call")
            .when(F.col("event_type") == "signup", "store")
            .when(F.col("event_type") == "click", "load")
            .when(F.col("event_id") % 7 == 0, "switch")
            .otherwise("general")
        )
        return cut(r.join(size, "user_id").select(
            F.col("user_id").alias("unit"), "idx", "n", "event_id", op.alias("op"),
            (F.col("event_id") % 4).alias("slot")))

    @cached_property
    def jump(self) -> DataFrame:
        """Targets in order; a switch has its default first, then its cases."""
        e, n = F.col("event_id"), F.col("n")
        to = lambda k, dest: F.struct(F.lit(k).alias("ord"), dest.alias("dest"))
        targets = F.when(F.col("op") == "switch", F.array(to(0, (e * 3 + 1) % n), to(1, e % n), to(2, (e * 5 + 2) % n))).otherwise(
            F.array(to(0, e % n)))
        return self.seq.filter(F.col("op").isin("jump", "goto", "switch")).select(
            "unit", "idx", F.explode(targets).alias("t")).select("unit", "idx", "t.ord", "t.dest")

    @cached_property
    def range(self) -> DataFrame:
        s = self.seq.filter("op = 'store' and event_id % 5 = 0")
        kinds = F.when(F.col("event_id") % 10 == 0, F.array(
            F.concat(F.lit("E"), (F.col("event_id") % 3).cast("string")),
            F.concat(F.lit("E"), (F.col("event_id") % 2 + 3).cast("string")),
        )).otherwise(F.array(F.concat(F.lit("E"), (F.col("event_id") % 3).cast("string"))))
        return s.select(
            "unit", F.col("idx").alias("from_idx"),
            F.least(F.col("idx") + 5, F.col("n")).alias("to_idx"),
            ((F.col("idx") * 3 + 7) % F.col("n")).alias("handler_idx"),
            F.explode(kinds).alias("exc_type"))

    @cached_property
    def wide(self) -> DataFrame:
        """The same spans under one handler and type, so that they group."""
        return self.range.select(
            "unit", "from_idx", "to_idx", F.lit(0).cast("long").alias("handler_idx"), F.lit("E").alias("exc_type"))

    @cached_property
    def block(self) -> DataFrame:
        return cut(B.block_ids(self.seq, self.jump, self.range))

    @cached_property
    def edge(self) -> DataFrame:
        return cut(B.block_edges(self.block, self.jump))

    @cached_property
    def node(self) -> DataFrame:
        return cut(B.nodes_of(self.block))

    # ---- classes, members, references
    @cached_property
    def hier(self) -> DataFrame:
        p = F.col("p_partkey")
        top = p <= 1
        return self.table("part").select(
            p.alias("node"),
            F.when(~top, F.floor(p / 2).cast("long")).alias("super"),
            F.when((p % 3 == 0) & (p > 3), F.floor(p / 3).cast("long")).alias("iface"),
            (top | (p % 5 != 0)).alias("is_own"),
            (~top & (p % 7 == 0)).alias("is_iface"))

    @cached_property
    def parent(self) -> DataFrame:
        """(node, parent, pos): super at position 0, interface at position 1."""
        return (
            self.hier.select("node", F.posexplode(F.array("super", "iface")).alias("pos", "parent"))
            .filter("parent is not null"))

    @cached_property
    def member(self) -> DataFrame:
        l = self.table("lineitem")
        return (
            l.groupBy(
                F.col("l_partkey").alias("class"),
                F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("name"),
                F.concat(F.lit("("), "l_returnflag", F.lit(")")).alias("params"),
                F.col("l_linestatus").alias("ret"))
            .agg(F.min(F.col("l_suppkey") % 4).alias("access"), F.min("l_orderkey").alias("ord")))

    @cached_property
    def method(self) -> DataFrame:
        """Members with the flags that overriding looks at."""
        h = self.hier.select(F.col("node").alias("class"), F.col("is_iface").alias("in_iface"))
        final = F.col("ord") % 7 == 1
        return cut(self.member.join(h, "class").select(
            "class", "name", "params", "ret", "ord", "in_iface",
            ((F.col("access") != 1) & (F.col("ord") % 13 != 5)).alias("overridable"),
            final.alias("final"), (~final & (F.col("ord") % 3 == 0)).alias("abstract"),
            (F.col("access") == 3).alias("public"), F.col("access").isin(2, 3).alias("visible"),
            (F.col("class") % 4).alias("package"),
            F.when((F.col("access") == 3) | F.col("in_iface"), 3).when(F.col("access") == 2, 2)
            .otherwise(1).alias("access_rank")))

    @cached_property
    def returns(self) -> DataFrame:
        """Related return types: F may stand where O is declared."""
        return self.spark.createDataFrame([("F", "O")], "child string, parent string")

    @cached_property
    def up(self) -> DataFrame:
        return self.depth_first.select("node", "anc")

    @cached_property
    def levels(self) -> DataFrame:
        """(node, level) of every class that is there or is somebody's parent."""
        from classlake.operators.hierarchy import inheritance_levels
        nodes = self.hier.select("node").unionByName(self.parent.select(F.col("parent").alias("node"))).filter("node is not null")
        return cut(inheritance_levels(self.parent, nodes))

    @cached_property
    def depth_first(self) -> DataFrame:
        from classlake.operators.hierarchy import ranked_closure
        return ranked_closure(self.parent, self.hier.select("node"))

    @cached_property
    def breadth_first(self) -> DataFrame:
        from classlake.operators.hierarchy import ranked_closure
        return ranked_closure(self.parent, self.hier.select("node"), breadth_first=True)

    @cached_property
    def ref(self) -> DataFrame:
        l = self.table("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
            "l_returnflag", "l_linestatus")
        placed = cut(ranked(
            l, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"],
            "_at", F.struct("l_linenumber", "l_partkey")))
        following = placed.select(
            "l_orderkey", (F.col("_at") - 1).alias("_at"), F.col("l_partkey").alias("owner"),
            F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("name"),
            F.concat(F.lit("("), "l_returnflag", F.lit(")")).alias("params"), F.col("l_linestatus").alias("ret"))
        return cut(
            placed.select("l_orderkey", "_at", F.col("l_partkey").alias("caller"))
            .join(following, ["l_orderkey", "_at"]).filter("owner <> caller")
            .select("caller", "owner", "name", "params", "ret").distinct())

    @cached_property
    def concrete(self) -> DataFrame:
        return self.hier.filter("is_own and not is_iface and node % 11 <> 0").select(
            "node", (F.col("node") % 4).alias("package"))

    @cached_property
    def call(self) -> DataFrame:
        return self.ref.select(F.col("caller").alias("src"), F.col("owner").alias("dst")).distinct()

    # ---- exceptions
    @cached_property
    def exc(self) -> DataFrame:
        return self.call.select("src", "dst", F.when(
            (F.col("src") * F.col("dst")) % 4 == 0,
            F.concat(F.lit("X"), ((F.col("src") + F.col("dst")) % 6).cast("string"))).alias("caught"))

    @cached_property
    def raised(self) -> DataFrame:
        return self.table("part").filter("p_partkey % 3 = 0").select(
            F.col("p_partkey").alias("node"),
            F.concat(F.lit("X"), (F.col("p_partkey") % 6).cast("string")).alias("exc"))

    @cached_property
    def exc_type(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.table("part").filter("p_partkey < 6").select(
            F.concat(F.lit("X"), k.cast("string")).alias("exc"),
            F.when(k > 0, F.concat(F.lit("X"), F.floor(k / 2).cast("string"))).alias("super"))

    # ---- mappings, paths, names, text
    @cached_property
    def map(self) -> DataFrame:
        none = F.lit(None).cast("string")
        classes = self.table("part").filter("p_partkey % 4 = 0").select(
            F.lit("class").alias("kind"), F.col("p_partkey").alias("owner"),
            none.alias("name"), none.alias("params"),
            F.concat("p_brand", F.lit("_"), F.col("p_partkey").cast("string")).alias("target"))
        methods = (
            self.member.filter("class % 4 = 1").groupBy("class", "name", "params")
            .agg(F.min("ord").alias("o"))
            .select(F.lit("method").alias("kind"), F.col("class").alias("owner"), "name", "params",
                    F.concat(F.lit("r_"), "name", F.lit("_"), F.col("o").cast("string")).alias("target")))
        return classes.unionByName(methods)

    @cached_property
    def path(self) -> DataFrame:
        return self.table("pages").select(
            F.col("page_id").alias("ord"), F.col("url").alias("path"),
            (F.col("page_id") % 2 == 0).alias("is_own"),
            F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("base_path"))

    @cached_property
    def art(self) -> DataFrame:
        return self.table("documents").select(
            F.md5("text").alias("k"), F.col("source").alias("unit"),
            (F.col("doc_id") % 2 == 0).alias("is_own"), F.col("doc_id").alias("ord"))

    @cached_property
    def name(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("ord"), F.col("p_brand").alias("scope"),
            F.col("p_name").alias("raw"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("base"),
            F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word"))

    @cached_property
    def turn(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").alias("file"), F.col("turn").alias("line"), "role", "text")

    @cached_property
    def text(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("class"), "text")
