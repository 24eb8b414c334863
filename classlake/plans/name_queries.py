"""Identifier rules, generated names, renaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from classlake.functions import descriptors as D
from classlake.functions import names as N
from classlake.operators import rename as R
from classlake.operators.members import KEY
from classlake.plans.member_queries import family_table
from classlake.plans.registry import query

KEYWORD_SQL = ", ".join(f"'{w}'" for w in N.KEYWORDS)
DEVICE_SQL = ", ".join(f"'{w}'" for w in N.DEVICES)

CANDIDATES = """
cand as (select ord, case ord % 8 when 0 then word when 1 then concat(cast(ord as varchar), word) when 2 then 'class'
  when 3 then concat('com', cast(ord % 12 as varchar)) when 4 then concat('a$', substr(word, 1, 3), '$b1') when 5 then concat('p/', word, '//q')
  when 6 then '' else raw end as name from v_name)"""


def candidates(f):
    n = F.col("ord") % 8
    name = (
        F.when(n == 0, F.col("word")).when(n == 1, F.concat(F.col("ord").cast("string"), "word")).when(n == 2, "class")
        .when(n == 3, F.concat(F.lit("com"), (F.col("ord") % 12).cast("string")))
        .when(n == 4, F.concat(F.lit("a$"), F.substring("word", 1, 3), F.lit("$b1")))
        .when(n == 5, F.concat(F.lit("p/"), "word", F.lit("//q"))).when(n == 6, "").otherwise(F.col("raw")))
    return f.name.select("ord", name.alias("name"))


@query("invalid_names", f"""
with {CANDIDATES}
select ord, name, name = '' or not regexp_full_match(name, '[A-Za-z_$][A-Za-z0-9_$]*') or name in ({KEYWORD_SQL}) as member,
  case when name = '' then true
    when len(list_filter(string_split(regexp_replace(name, '/+$', ''), '/'), lambda p: p = '' or not regexp_full_match(p, '[A-Za-z_$][A-Za-z0-9_$]*')
      or p in ({KEYWORD_SQL}) or lower(p) in ({DEVICE_SQL}))) > 0 then true
    else lower(name) in ({DEVICE_SQL}) or regexp_full_match(name, '([^$]{{1,3}}\\$)*[^$]{{1,3}}') or length(name) > 249 end as class
from cand""")
def invalid_names(f):
    name = F.col("name")
    return candidates(f).select(
        "ord", "name", N.must_rename_member(name, F.lit(True)).alias("member"), N.rename_class(name).alias("class"))


@query("counter_class_names", """
with wanted as (select ord, case when ord % 4 = 0 then concat(cast(ord % 50 as varchar), word) else word end as name from v_name),
held as (select concat('class_', cast((ord * 7) % 500 as varchar)) as name from v_name where ord % 5 = 0
  union select concat('Inner', word) from v_name where ord % 97 = 0),
r as (select *, regexp_extract(name, '^[0-9]+([^0-9].*)$', 1) as rest from wanted),
d as (select *, rest <> '' and row_number() over (partition by rest order by ord) = 1 and concat('Inner', rest) not in (select name from held) as free from r),
k as (select *, row_number() over (order by ord) - 1 as k from d where not free),
tk as (select o, row_number() over (order by o) - 1 as j from (select distinct cast(substr(name, 7) as bigint) as o from held where name like 'class_%') q),
num as (select k.ord, k.name, k.rest, k.k + (select count(*) from tk where tk.o - tk.j <= k.k) as n from k)
select ord, name, concat('Inner', rest) as new_name from d where free
union all select ord, name, case when rest <> '' then concat('Inner', rest, '_', cast(n as varchar)) else concat('class_', cast(n as varchar)) end from num""")
def counter_class_names(f):
    wanted = f.name.select("ord", F.when(
        F.col("ord") % 4 == 0, F.concat((F.col("ord") % 50).cast("string"), "word")).otherwise(F.col("word")).alias("name"))
    held = f.name.filter("ord % 5 = 0").select(
        F.concat(F.lit("class_"), ((F.col("ord") * 7) % 500).cast("string")).alias("name"))
    held = held.unionByName(f.name.filter("ord % 97 = 0").select(F.concat(F.lit("Inner"), "word").alias("name")))
    return N.class_names(wanted, held, ["ord"]).select("ord", "name", "new_name")


TYPES = ["int", "long", "byte", "short", "boolean", "File", "java.lang.String", "java.util.List<java.lang.String>",
         "Foo[]", "foo[][]", "list"]
TYPE_LIST = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"


def typed_variables(f):
    kinds = F.array(*[F.lit(t) for t in TYPES])
    return f.seq.filter("op in ('store', 'call')").select(
        "unit", F.col("idx").cast("int").alias("var"), F.col("slot").cast("int").alias("version"),
        F.element_at(kinds, (F.col("event_id") % len(TYPES) + 1).cast("int")).alias("type"))


@query("typed_variable_names", f"""
with v as (select unit, idx as var, slot as version, {TYPE_LIST}[event_id % {len(TYPES)} + 1] as type from v_seq where op in ('store', 'call')),
b as (select *, case type when 'int' then 'int' when 'long' then 'int' when 'byte' then 'byte' when 'short' then 'short'
  when 'boolean' then 'boolean' when 'File' then 'File' when 'java.lang.String' then 'String'
  when 'java.util.List<java.lang.String>' then 'list' when 'Foo[]' then 'foo[]' when 'foo[][]' then 'foo[]'
  else case when exists (select 1 from v w where w.unit = v.unit and w.type like 'java.util%' and w.var < v.var) then 'list' end end as base from v),
k as (select *, row_number() over (partition by unit, base order by var, version) - 1
   + case when base in ('short', 'File') then 1 else 0 end as k from b)
select unit, cast(var as int) as var, cast(version as int) as version, type, case
  when base is null then 'list'
  when base = 'int' then concat(['i', 'j', 'k', 'l'][k % 4 + 1], case when k < 4 then '' else cast(k // 4 as varchar) end)
  when base = 'byte' then concat('b', cast(k as varchar)) when base = 'short' then concat('short', cast(k as varchar))
  else concat(case base when 'boolean' then 'flag' when 'File' then 'file' when 'String' then 's' when 'foo[]' then 'afoo' else 'list' end,
    case when k = 0 then '' else cast(k as varchar) end) end as new_name from k""")
def typed_variable_names(f):
    return N.typed_names(typed_variables(f))


@query("type_name_bases", """
with p as (select ord, lower(word) as w, lower(split_part(raw, ' ', -1)) as z from v_name),
t as (select ord, w, z, concat(upper(w[1]), w[2:]) as cw, concat(upper(z[1]), z[2:]) as cz from p)
select ord, case ord % 6 when 0 then cw when 1 then concat('com.', z, '.', cw) when 2 then concat('java.util.Map<', cw, ', x.', cz, '>')
    when 3 then concat('q.', cw, '$', cz) when 4 then concat(cw, '[]') else concat('a.b.', cw, '$', cz, '[][]') end as type,
  case ord % 6 when 2 then 'map' when 3 then z when 4 then concat(w, case when w[-1:] = 's' then '' else 's' end)
    when 5 then concat(z, case when z[-1:] = 's' then '' else 's' end) else w end as base from t""")
def type_name_bases(f):
    """A type for each part: plain, qualified, generic, nested and array types made of its words."""
    w, z = F.lower("word"), F.lower(F.split_part("raw", F.lit(" "), F.lit(-1)))
    title = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))
    cw, cz, k = title(w), title(z), F.col("ord") % 6
    kind = (
        F.when(k == 0, cw).when(k == 1, F.concat(F.lit("com."), z, F.lit("."), cw))
        .when(k == 2, F.concat(F.lit("java.util.Map<"), cw, F.lit(", x."), cz, F.lit(">")))
        .when(k == 3, F.concat(F.lit("q."), cw, F.lit("$"), cz)).when(k == 4, F.concat(cw, F.lit("[]")))
        .otherwise(F.concat(F.lit("a.b."), cw, F.lit("$"), cz, F.lit("[][]"))))
    return f.name.select("ord", kind.alias("type")).select("ord", "type", N.name_base(F.col("type")).alias("base"))


@query("scope_free_names", """
with r as (select scope, ord, case ord % 10 when 0 then 'i' when 1 then 'do' else base end as base, ord % 10 = 0 as letters from v_name),
k as (select *, row_number() over (partition by scope, base order by ord) - 1 as k from r)
select scope, ord, base, case when base = 'do' then 'do_'
  when letters then case when k + 8 < 26 then chr(cast(97 + 8 + k as int)) else concat(chr(cast(97 + (k + 8) // 26 as int)), chr(cast(97 + (k + 8) % 26 as int))) end
  when k = 0 then base else concat(base, cast(k as varchar)) end as new_name from k""")
def scope_free_names(f):
    n = F.col("ord") % 10
    rows = f.name.select(
        "scope", "ord", F.when(n == 0, "i").when(n == 1, "do").otherwise(F.col("base")).alias("base"), (n == 0).alias("letters"))
    return N.free_names(rows).drop("letters")


@query("scope_clash_names", """
with v as (select unit, concat('v', cast(slot as varchar)) as name, idx as start,
  case when idx % 64 < 16 then (idx // 64 + 1) * 64 else (idx // 16 + 1) * 16 end as fin from v_seq where op in ('store', 'load'))
select unit, name, start, concat(name, repeat('x', (select count(*) from v o
  where o.unit = v.unit and o.name = v.name and o.start < v.start and o.fin > v.start)::int)) as new_name from v""")
def scope_clash_names(f):
    i = F.col("idx")
    end = F.when(i % 64 < 16, (F.floor(i / 64) + 1) * 64).otherwise((F.floor(i / 16) + 1) * 16).cast("long")
    rows = f.seq.filter("op in ('store', 'load')").select(
        "unit", F.concat(F.lit("v"), F.col("slot").cast("string")).alias("name"), i.alias("start"), end.alias("end"),
        i.alias("ord"))
    return N.scope_clashes(rows).select("unit", "name", "start", "new_name")


@query("policy_names", """
select ord, word as name, case when length(word) < 5 then concat('n_', cast(ord as varchar)) else word end as new_name from v_name""")
def policy_names(f):
    return N.apply_policy(
        f.name.select("ord", F.col("word").alias("name")),
        lambda df: F.length("name") < 5,
        lambda df: df.withColumn("new_name", F.concat(F.lit("n_"), F.col("ord").cast("string"))))


@query("provided_names", """
select unit, cast(idx as int) as var, concat('p', cast(row_number() over (partition by unit order by idx) - 1 as varchar)) as new_name
from v_seq where op = 'store'""")
def provided_names(f):
    rows = f.seq.filter("op = 'store'").select("unit", F.col("idx").cast("int").alias("var"))
    return N.provide_names(rows, lambda pdf: "p" + pdf["at"].astype(str))


@query("provided_counters", """
select unit, cast(idx as int) as var, slot, concat('s', slot, '_', cast(row_number() over (partition by unit, slot order by idx) - 1 as varchar)) as new_name
from v_seq where op in ('store', 'load')""")
def provided_counters(f):
    """Names that count a slot's earlier uses over all slices of a unit."""
    rows = f.seq.filter("op in ('store', 'load')").select("unit", F.col("idx").cast("int").alias("var"), "slot")
    return N.provide_names(rows, lambda pdf: "s" + pdf["slot"].astype(str) + "_" + pdf["seen"].astype(str), counted=F.col("slot"))


# ---------------------------------------------------------------- descriptors

DESC = "concat('(IJ[Lp/c', cast(class as varchar), ';D[[Z)Lc', cast(class % 100 as varchar), ';')"


def described(f):
    text = F.concat(F.lit("(IJ[Lp/c"), F.col("class").cast("string"), F.lit(";D[[Z)Lc"),
                    (F.col("class") % 100).cast("string"), F.lit(";"))
    return f.member.select(*KEY, "access", text.alias("descriptor"))


@query("descriptor_parts", f"""
select class, name, params, ret, ['I', 'J', concat('[Lp/c', cast(class as varchar), ';'), 'D', '[[Z'] as types,
  concat('Lc', cast(class % 100 as varchar), ';') as result,
  case when access = 1 then [0, 1, 3, 4, 6] else [1, 2, 4, 5, 7] end as slots from v_member""")
def descriptor_parts(f):
    d = F.col("descriptor")
    return described(f).select(
        *KEY, D.parameters(d).alias("types"), D.return_type(d).alias("result"),
        D.slot_offsets(D.parameters(d), F.col("access") == 1).alias("slots"))


@query("source_signatures", f"""
select class, name, params, ret, concat(name, ' (IJ[Lp/c', cast(class as varchar), ';D[[Z)') as signature, concat(name, ' ', {DESC}) as key from v_member""")
def source_signatures(f):
    return described(f).select(
        *KEY, D.source_signature(F.col("name"), F.col("descriptor")).alias("signature"),
        D.unique_key(F.col("name"), F.col("descriptor")).alias("key"))


@query("package_names", """
select ord, case when instr(base_path, '/') > 0 then left(base_path, length(base_path) - instr(reverse(base_path), '/')) else '' end as package,
  string_split(base_path, '/')[-1] as simple from v_path""")
def package_names(f):
    p = F.col("base_path")
    return f.path.select("ord", D.package_name(p).alias("package"), D.simple_name(p).alias("simple"))


@query("remapped_descriptors", """
with ren as (select concat('c', cast(owner as varchar)) as old, target as new from v_map where kind = 'class')
select m.class, m.name, m.params, m.ret, concat('(IJ[Lp/c', cast(m.class as varchar), ';D[[Z)L',
  coalesce(r.new, concat('c', cast(m.class % 100 as varchar))), ';') as mapped
from v_member m left join ren r on r.old = concat('c', cast(m.class % 100 as varchar))""")
def remapped_descriptors(f):
    renames = f.map.filter("kind = 'class'").select(
        F.concat(F.lit("c"), F.col("owner").cast("string")).alias("old"), F.col("target").alias("new"))
    return D.remap_descriptors(described(f), "descriptor", renames, "mapped").select(*KEY, "mapped")


# ---------------------------------------------------------------- renaming


@query("applied_mapping", """
select m.class, m.name, m.params, m.ret, coalesce(p.target, m.name) as new_name from v_member m left join v_map p
on p.kind = 'method' and p.owner = m.class and p.name = m.name and p.params = m.params""")
def applied_mapping(f):
    mapping = f.map.filter("kind = 'method'").select(F.col("owner").alias("class"), "name", "params", "target")
    return R.apply_mapping(f.member.select(*KEY), mapping, ["class", "name", "params"], "name", "new_name")


@query("mapping_stats", """
select count(*) filter (kind = 'class') as classes, count(*) filter (kind = 'field') as fields,
  count(*) filter (kind = 'method') as methods, count(*) filter (kind = 'param') as params from v_map""")
def mapping_stats(f):
    return R.mapping_stats(f.map)


@query("rename_store_violations", """
with s as (select distinct kind, concat_ws(' ', cast(owner as varchar), name, params) as old_key, substr(target, 1, 7) as new_key from v_map)
select kind, 'old' as side, old_key as key, count(*) as n from s group by all having count(*) > 1
union all select kind, 'new', new_key, count(*) from s group by all having count(*) > 1""")
def rename_store_violations(f):
    pairs = f.map.select(
        "kind", F.concat_ws(" ", F.col("owner").cast("string"), "name", "params").alias("old_key"),
        F.substring("target", 1, 7).alias("new_key"))
    return R.check_bijective(pairs)


def method_mapping(f):
    return f.map.filter("kind = 'method'").select("owner", "name", "params", "target")


FAMILY_NAME = """
fam as (select f.family, arg_min(p.target, (case when m.in_iface then 2 when m.abstract then 1 else 0 end, m.ord, m.class, m.name, m.params, m.ret)) as target
  from o_family f join v_method m on m.class = f.class and m.name = f.name and m.params = f.params and m.ret = f.ret
  join v_map p on p.kind = 'method' and p.owner = f.class and p.name = f.name and p.params = f.params group by f.family)"""


@query("family_names", f"with {FAMILY_NAME} select family, target from fam")
def family_names(f):
    return R.family_names(family_table(f), f.method, method_mapping(f))


def owned_methods(f):
    own = f.hier.select(F.col("node").alias("class"), F.col("is_own").alias("own"))
    return f.method.join(own, "class")


@query("name_conflicts", f"""
with {FAMILY_NAME},
rk as (select f.family, case when not bool_and(h.is_own) then 0 when bool_or(not m.in_iface and m.final) then 1
    when bool_or(not m.in_iface and not m.abstract) then 2 when bool_or(not m.in_iface) then 3 else 4 end as rank, min(m.ord) as first
  from o_family f join v_method m on m.class = f.class and m.name = f.name and m.params = f.params and m.ret = f.ret
  join v_hier h on h.node = f.class group by f.family),
nm as (select f.class, f.params, f.family, coalesce(fam.target, f.name) as new_name from o_family f left join fam on fam.family = f.family),
seen as (select distinct u.node, nm.new_name, nm.params, nm.family from nm join o_up u on u.anc = nm.class),
r as (select seen.*, rk.rank, row_number() over (partition by node, new_name, params order by rk.rank, rk.first, seen.family) as place
  from seen join rk on rk.family = seen.family)
select node, new_name, params, family from r where place > 1 and rank > 0""")
def name_conflicts(f):
    families, methods = family_table(f), owned_methods(f)
    chosen = R.family_names(families, methods, method_mapping(f))
    rendered = families.join(chosen, "family", "left").withColumn("new_name", F.coalesce("target", "name"))
    return R.visible_conflicts(rendered, None, R.keeper_ranks(families, methods), (f.parent, f.levels))


@query("family_renaming", f"""
with {FAMILY_NAME},
rk as (select f.family, case when not bool_and(h.is_own) then 0 when bool_or(not m.in_iface and m.final) then 1
    when bool_or(not m.in_iface and not m.abstract) then 2 when bool_or(not m.in_iface) then 3 else 4 end as rank, min(m.ord) as first
  from o_family f join v_method m on m.class = f.class and m.name = f.name and m.params = f.params and m.ret = f.ret
  join v_hier h on h.node = f.class group by f.family),
vis as (select distinct u.node, f.params, f.family from o_family f join o_up u on u.anc = f.class),
st as (
  select 0 as round, f.family, coalesce(max(case when rk.rank > 0 then fam.target end), min(f.name)) as new_name
  from o_family f join rk on rk.family = f.family left join fam on fam.family = f.family group by f.family
  union all
  select round + 1, family, new_name from (
    with s as (select * from st),
    r as (select s.family, s.new_name, rk.rank, rk.first, row_number() over (
        partition by v.node, s.new_name, v.params order by rk.rank, rk.first, s.family) as place
      from vis v join s on s.family = v.family join rk on rk.family = s.family),
    lo as (select distinct family, new_name, first from r where place > 1 and rank > 0),
    num as (select family, row_number() over (partition by new_name order by first, family) as k from lo)
    select s.round, s.family, case when num.k is null then s.new_name else concat(s.new_name, '_', cast(num.k as varchar)) end as new_name
    from s left join num on num.family = s.family where exists (select 1 from num)) q)
select f.class, f.name, f.params, f.ret, f.family, st.new_name from o_family f join st on st.family = f.family
where st.round = (select max(round) from st)""")
def family_renaming(f):
    return R.rename_members(owned_methods(f), family_table(f), None, method_mapping(f), (f.parent, f.levels))


def proposed_methods(f):
    """Methods with the name their family would take."""
    chosen = R.family_names(family_table(f), f.method, method_mapping(f))
    families = family_table(f).join(chosen, "family", "left").select(*KEY, "target")
    return owned_methods(f).join(families, KEY, "left").select(
        *KEY, "ord", "overridable", (~F.col("own")).alias("fixed"), F.coalesce("target", "name").alias("proposed"))


@query("flowing_names", f"""
with {FAMILY_NAME},
lv as (select node, max(len(path)) as level from o_paths group by node),
w as (
  select m.class, m.name, m.params, m.ret, m.ord, m.overridable, not h.is_own as fixed, coalesce(fam.target, m.name) as proposed, lv.level
  from v_method m join v_hier h on h.node = m.class join lv on lv.node = m.class
  left join o_family f on f.class = m.class and f.name = m.name and f.params = m.params and f.ret = m.ret
  left join fam on fam.family = f.family),
s(class, name, params, ret, own, passes, new_name, how, lvl) using key (class, name, params, ret, own) as (
  select -1::bigint, '', '', '', true, false, '', '', -1::bigint
  union
  (with l as (select max(lvl) + 1 as l from s),
  inh as (
    select p.node as class, r.name, r.params, r.ret, arg_max(r.new_name, p.pos) as nn
    from l join lv on lv.level = l.l join v_parent p on p.node = lv.node join recurring.s r on r.class = p.parent and r.passes
    group by p.node, r.name, r.params, r.ret),
  a as (
    select w.*, inh.nn, case when fixed then 0 when overridable and nn is not null then 1 else 2 end as turn,
      case when fixed then w.name when overridable and nn is not null then nn else proposed end as want
    from l join w on w.level = l.l left join inh on inh.class = w.class and inh.name = w.name and inh.params = w.params and inh.ret = w.ret),
  b as (
    select a.*, turn > 0 and (row_number() over (partition by class, want, params order by turn, ord, name, ret) > 1
      or (turn = 2 and exists (select 1 from inh i where i.class = a.class and i.nn = a.want and i.params = a.params))) as loses from a),
  c as (select *, row_number() over (partition by class, want, params, loses order by turn, ord, name, ret) as r from b),
  used as (
    select class, params, list(nm) as names from (
      select class, params, want as nm from a union select class, params, nn from inh) group by class, params),
  d as (
    select c.*, case when loses then want || '_' || list_filter(range(1, 200), lambda k: not list_contains(used.names, want || '_' || k))[r]
      else want end as fin
    from c join used on used.class = c.class and used.params = c.params)
  select class, name, params, ret, true, overridable, fin,
    case when loses then 'renamed' when turn = 1 then 'inherited' else 'kept' end, level from d
  union all
  select class, name, params, ret, false, true, nn, '', l.l from inh, l
  where not exists (select 1 from d where d.class = inh.class and d.name = inh.name and d.params = inh.params and d.ret = inh.ret and d.overridable)
  union all
  select -2 - l, '', '', '', true, false, '', '', l from l where l <= (select max(level) from lv)))
select class, name, params, ret, new_name, how from s where own and class >= 0""")
def flowing_names(f):
    return R.flowing_names(proposed_methods(f), f.parent, f.levels)


def all_fields(f):
    """Members as fields of one name each."""
    owners = f.hier.select(F.col("node").alias("class"), F.col("is_iface").alias("in_iface"), F.col("is_own").alias("own"))
    return f.member.withColumn("name", F.concat("name", "params", "ret")).join(owners, "class").select(
        "class", "name", "ord", "in_iface", "own")


@query("field_renaming", """
with st as (
  select 0 as round, class, concat(name, params, ret) as name, concat(name, params, ret) as new_name from v_member
  union all
  select round + 1, class, name, new_name from (
    with s as (select st.*, m.ord, h.is_iface, h.is_own from st join v_hier h on h.node = st.class
               join v_member m on m.class = st.class and concat(m.name, m.params, m.ret) = st.name),
    r as (select s.class, s.name, s.new_name, s.ord, s.is_own, row_number() over (
        partition by d.node, s.new_name order by s.is_iface, d.path, s.ord, s.name) as place
      from s join o_dfs d on d.anc = s.class),
    lo as (select distinct class, name, new_name, ord from r where place > 1 and is_own),
    num as (select class, name, row_number() over (partition by new_name order by ord, class, name) as k from lo)
    select s.round, s.class, s.name, case when num.k is null then s.new_name else concat(s.new_name, '_', cast(num.k as varchar)) end as new_name
    from s left join num on num.class = s.class and num.name = s.name where exists (select 1 from num)) q)
select class, name, new_name from st where round = (select max(round) from st)""")
def field_renaming(f):
    return R.rename_fields(all_fields(f), None, (f.parent, f.levels))


@query("field_keepers", """
select d.node, concat(m.name, m.params, m.ret) as name, arg_min(m.class, (h.is_iface, d.path, m.ord)) as keeper, count(*) as fields
from o_dfs d join v_member m on m.class = d.anc join v_hier h on h.node = m.class
group by d.node, concat(m.name, m.params, m.ret) having count(*) > 1""")
def field_keepers(f):
    fields = f.member.withColumn("name", F.concat("name", "params", "ret")).join(
        f.hier.select(F.col("node").alias("class"), F.col("is_iface").alias("in_iface")), "class")
    return R.field_keepers(fields.select("class", "name", "ord", "in_iface"), f.depth_first)


@query("inlined_accessors", """
with one as (select caller as owner, min(owner) as to_owner, min(name) as to_name, min(params) as to_params, min(ret) as to_ret
  from v_ref group by caller having count(*) = 1),
acc as (select m.class as owner, m.name, m.params, m.ret, o.to_owner, o.to_name, o.to_params, o.to_ret from v_member m join one o on o.owner = m.class where m.access <> 3)
select r.caller, case when a.owner is not null and r.caller % 3 = r.owner % 3 then a.to_owner else r.owner end as owner,
  case when a.owner is not null and r.caller % 3 = r.owner % 3 then a.to_name else r.name end as name,
  case when a.owner is not null and r.caller % 3 = r.owner % 3 then a.to_params else r.params end as params,
  case when a.owner is not null and r.caller % 3 = r.owner % 3 then a.to_ret else r.ret end as ret,
  a.owner is not null and r.caller % 3 = r.owner % 3 as inlined
from v_ref r left join acc a on a.owner = r.owner and a.name = r.name and a.params = r.params and a.ret = r.ret""")
def inlined_accessors(f):
    instr = f.ref.select(
        F.col("caller").alias("unit"), F.lit(0).alias("idx"), F.lit("call").alias("op"), F.lit(1).alias("block"),
        "owner", "name", "params", "ret")
    flagged = f.member.select(F.col("class").alias("unit"), F.lit(True).alias("static"), F.lit(True).alias("synthetic")).distinct()
    shapes = R.accessor_shapes(instr, flagged)
    accessors = f.member.filter("access <> 3").select(
        F.col("class").alias("owner"), "name", "params", "ret").join(
        shapes.withColumnRenamed("unit", "owner"), "owner")
    nests = f.hier.select("node", (F.col("node") % 3).alias("root"))
    return R.inline_accessors(f.ref, accessors, nests)


