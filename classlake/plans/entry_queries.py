"""Input inventory, mapping files, results."""

from __future__ import annotations

from pyspark.sql import functions as F

from classlake.functions.filters import allowed, excluded, implicit_enum_member
from classlake.plans.registry import query
from classlake.scan import ranked
from classlake.sources import entries as S
from classlake.sources import mappings as M
from classlake.sources import results as R


@query("entry_kinds", """
select page_id as ord, case when regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') like '%5' and substr(html, 1, 4) = '<!DO'
  then 'class' else 'other' end as kind from pages""")
def entry_kinds(f):
    pages = f.table("pages").join(f.path.select(F.col("ord").alias("page_id"), "base_path"), "page_id")
    magic = F.encode(F.substring("html", 1, 4), "UTF-8")
    return pages.select(F.col("page_id").alias("ord"), S.entry_kind(F.col("base_path"), magic, "5", b"<!DO").alias("kind"))


@query("versioned_entries", """
with p as (select ord, case ord % 4 when 0 then concat('META-INF/versions/', cast(ord % 23 as varchar), '/', base_path)
  when 1 then concat('META-INF/versions/x', cast(ord as varchar), '/', base_path) when 2 then concat('META-INF/versions/', cast(ord as varchar)) else base_path end as path from v_path)
select ord, case when ord % 4 = 0 then substr(path, length('META-INF/versions/') + length(cast(ord % 23 as varchar)) + 1) else path end as base_path,
  case when ord % 4 <> 0 then -1 when ord % 23 < 9 then null else cast(ord % 23 as int) end as multirelease from p""")
def versioned_entries(f):
    o, head = F.col("ord"), F.lit("META-INF/versions/")
    path = (
        F.when(o % 4 == 0, F.concat(head, (o % 23).cast("string"), F.lit("/"), "base_path"))
        .when(o % 4 == 1, F.concat(head, F.lit("x"), o.cast("string"), F.lit("/"), "base_path"))
        .when(o % 4 == 2, F.concat(head, o.cast("string"))).otherwise(F.col("base_path")))
    rows = f.path.select("ord", path.alias("path"))
    return S.split_version(rows, "path", strict=False).select("ord", "base_path", "multirelease")


@query("entry_directories", """
with p as (select is_own, base_path, string_split(base_path, '/') as parts from v_path where instr(base_path, '/') > 0)
select distinct is_own, array_to_string(parts[1:n], '/') as dir from (select *, unnest(range(1, len(parts))) as n from p) q""")
def entry_directories(f):
    return S.directories(f.path, ["is_own"], "base_path")


@query("artifact_precedence", """
select k, unit, is_own, ord from v_art qualify row_number() over (partition by k order by is_own desc, ord) = 1""")
def artifact_precedence(f):
    return S.precedence(f.art)


@query("misfiled_artifacts", """
with a as (select *, case when ord % 5 = 0 then md5(concat(k, 'x')) else k end as declared from v_art),
u as (select * from a union all select declared, unit, is_own, ord, declared from a where declared <> k)
select k, unit, is_own, ord from u qualify row_number() over (partition by k order by is_own desc, ord) = 1""")
def misfiled_artifacts(f):
    rows = f.art.withColumn(
        "declared", F.when(F.col("ord") % 5 == 0, F.md5(F.concat("k", F.lit("x")))).otherwise(F.col("k")))
    return S.register_misfiled(rows).select("k", "unit", "is_own", "ord")


@query("first_writes", "select is_own, base_path, min(ord) as ord from v_path group by all")
def first_writes(f):
    return R.first_writes(f.path.select("is_own", "base_path", "ord"), ["is_own", "base_path"], ["ord"])


@query("repeated_writes", """
select string_split(base_path, '/')[1] as base_path, count(*) as writes from v_path group by all having count(*) > 1""")
def repeated_writes(f):
    return R.repeated_writes(f.path.select(F.split_part("base_path", F.lit("/"), F.lit(1)).alias("base_path")), ["base_path"])


@query("safe_paths", r"""
select ord, ord % 7 in (0, 5) as safe from v_path""")
def safe_paths(f):
    n = F.col("ord") % 7
    path = (
        F.when(n == 0, F.col("base_path")).when(n == 1, F.concat(F.lit("../"), "base_path"))
        .when(n == 2, F.concat(F.lit("a/../../"), "base_path")).when(n == 3, F.concat(F.lit("/"), "base_path"))
        .when(n == 4, F.concat(F.lit("C:"), "base_path")).when(n == 5, F.concat(F.lit("a/./b/.."), F.lit("/"), "base_path"))
        .otherwise(F.concat(F.lit("a\\"), "base_path")))
    return f.path.select("ord", R.safe_path(path).alias("safe"))


@query("allowed_paths", "select ord from v_path where base_path like 'a%' or base_path like 'th%' or base_path like 'w%'")
def allowed_paths(f):
    return f.path.filter(allowed(F.col("base_path"), ["a", "th", "w"])).select("ord")


@query("excluded_paths", "select ord from v_path where not regexp_full_match(base_path, '.*/(fr|de)/.*|a.*')")
def excluded_paths(f):
    return f.path.filter(~excluded(F.col("base_path"), ".*/(fr|de)/.*|a.*")).select("ord")


@query("implicit_enum_members", """
select class, name, params, ret, ord % 4 = 0 or (ord % 4 = 1 and class % 2 = 0) or (ord % 4 = 2 and access = 1) as implicit from v_member""")
def implicit_enum_members(f):
    o, cls = F.col("ord") % 4, F.concat(F.lit("c"), F.col("class").cast("string"))
    array = F.concat(F.lit("[L"), cls, F.lit(";"))
    kind = F.when(o == 2, "field").otherwise("method")
    name = F.when(o == 0, "values").when(o == 1, "valueOf").otherwise(F.col("name"))
    descriptor = (
        F.when(o == 0, F.concat(F.lit("()"), array))
        .when((o == 1) & (F.col("class") % 2 == 0), F.concat(F.lit("(Ljava/lang/String;)L"), cls, F.lit(";")))
        .when(o == 2, array).otherwise(F.lit("()V")))
    return f.member.select("class", "name", "params", "ret", implicit_enum_member(
        kind, name, descriptor, cls, F.col("access") == 1).alias("implicit"))


@query("nearest_parent_rows", """
select file, line, (select arg_max(u.text, u.line) from v_turn u where u.file = t.file and u.role = 'user' and u.line <= t.line) as parent from v_turn t""")
def nearest_parent_rows(f):
    return M.nearest_parent(
        f.turn, ["file"], "line", F.when(F.col("role") == "user", F.col("text")), "parent").select("file", "line", "parent")


@query("mapping_rows", """
with own as (select distinct owner from v_map)
select 'class' as kind, concat('c', cast(owner as varchar)) as owner, null as name, null as descriptor, concat('C', cast(owner as varchar)) as target from own where owner % 12 <> 1
union all select 'method', concat('c', cast(owner as varchar)), name, params, target from v_map where kind = 'method' and owner % 12 <> 1""")
def mapping_rows(f):
    o = F.col("owner").cast("string")
    file = (F.col("owner") % 10).cast("string").alias("file")
    heads = f.map.select(file, "owner", F.lit(0).alias("d"), F.lit("").alias("s"), F.when(
        F.col("owner") % 12 == 1, F.concat(F.lit("x\tc"), o)).otherwise(
        F.concat(F.lit("c\tc"), o, F.lit("\tC"), o)).alias("value")).distinct()
    kids = f.map.filter("kind = 'method'").select(
        file, "owner", F.lit(1).alias("d"), F.concat("name", "params").alias("s"),
        F.concat(F.lit("\tm\t"), "params", F.lit("\t"), "name", F.lit("\t"), "target").alias("value"))
    body = ranked(heads.unionByName(kids), ["file"], ["owner", "d", "s"], "line", F.floor(F.col("owner") / 1000).cast("long"))
    body = body.select("file", (F.col("line") + 2).alias("line"), "value")
    top = body.select("file").distinct().select("file", F.lit(1).cast("long").alias("line"), F.lit("tiny\t2\t0\told\tnew").alias("value"))
    return M.parse_mapping(top.unionByName(body), "old", "new").select("kind", "owner", "name", "descriptor", "target")


@query("parameter_names", """
with m as (select distinct class, name from v_member),
s as (select unnest(['a', 'b', 'b', 'e']) as param, unnest([0, 1, 2, 3]) as slot)
select concat('c', cast(class as varchar)) as class, name as method, '(IJ[D)V' as descriptor, s.slot, s.param from m, s where class % 3 <> 0""")
def parameter_names(f):
    tail = F.when(F.col("class") % 3 == 0, F.lit("")).otherwise(F.lit(" (IJ[D)V a b e"))
    lines = f.member.select("class", "name").distinct().select(
        F.concat(F.lit("c"), F.col("class").cast("string"), F.lit(" "), "name", tail).alias("value"))
    return M.parse_parameter_names(lines)
