"""Lines, data flow, exception flow, regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from classlake.iterate import cut
from classlake.operators import dataflow as D
from classlake.operators import effects as E
from classlake.operators import hierarchy as H
from classlake.operators import lines as L
from classlake.operators import regions as R
from classlake.plans.graph_queries import handler_edges, live_dominators, live_flow, live_graph
from classlake.plans.registry import query

# ---------------------------------------------------------------- lines and locals


def line_table(f):
    return f.seq.filter("op = 'store'").select(
        "unit", F.col("idx").alias("start_pc"), F.col("event_id").alias("line"), F.col("idx").alias("ord"))


@query("line_lookup", """
select s.unit, s.idx as pc, coalesce((select arg_max(t.event_id, t.idx) from v_seq t
  where t.unit = s.unit and t.op = 'store' and t.idx <= s.idx), -1) as line from v_seq s where s.op <> 'store'""")
def line_lookup(f):
    pcs = f.seq.filter("op <> 'store'").select("unit", F.col("idx").alias("pc"))
    return L.line_of(pcs, line_table(f))


@query("unsorted_line_lookup", """
select s.unit, s.idx as pc, coalesce((select arg_max(t.event_id, ((t.event_id * 7) % 1009, t.event_id)) from v_seq t
  where t.unit = s.unit and t.op = 'store' and t.idx <= s.idx), -1) as line from v_seq s""")
def unsorted_line_lookup(f):
    table = line_table(f).withColumn("ord", F.struct(((F.col("line") * 7) % 1009).alias("a"), F.col("line").alias("b")))
    return L.line_of(f.seq.select("unit", F.col("idx").alias("pc")), table)


def local_ranges(f):
    return f.seq.filter("op = 'store'").select(
        "unit", "slot", F.col("idx").alias("start_pc"), F.lit(10).alias("length"),
        F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("name"), F.col("idx").alias("ord"))


@query("visible_locals", """
select s.unit, s.slot, s.idx as pc, (select arg_min(concat('v', cast(t.event_id as varchar)), t.idx) from v_seq t
  where t.unit = s.unit and t.slot = s.slot and t.op = 'store' and t.idx <= s.idx and s.idx < t.idx + 10) as name
from v_seq s where s.op = 'load'""")
def visible_locals(f):
    uses = f.seq.filter("op = 'load'").select("unit", "slot", F.col("idx").alias("pc"))
    # the probe position is the join column of the ranges, so it gets a name of its own
    return L.visible_locals(uses, local_ranges(f))


@query("contained_locals", """
select s.unit, s.idx as start_pc, concat('v', cast(s.event_id as varchar)) as name, r.lo, r.hi
from v_seq s join (select distinct unit, from_idx as lo, from_idx + 40 as hi from v_range) r
on r.unit = s.unit and s.idx >= r.lo and s.idx + 10 <= r.hi where s.op = 'store'""")
def contained_locals(f):
    regions = f.range.select("unit", F.col("from_idx").alias("lo"), (F.col("from_idx") + 40).alias("hi")).distinct()
    return L.contained_locals(local_ranges(f), regions).select("unit", "start_pc", "name", "lo", "hi")


@query("frame_slot_types", """
with fr as (select unit, idx - idx % 8 as "offset", slot, concat('t', cast(min(event_id % 5) as varchar)) as type from v_seq where op = 'store' group by all)
select s.unit, s.idx as pc, s.slot, (select min(f.type) from fr f where f.unit = s.unit and f.slot = s.slot and f."offset" =
  (select max(g."offset") from fr g where g.unit = s.unit and g."offset" <= s.idx)) as type from v_seq s where s.op = 'load'""")
def frame_slot_types(f):
    frames = f.seq.filter("op = 'store'").groupBy("unit", (F.col("idx") - F.col("idx") % 8).alias("offset"), "slot").agg(
        F.concat(F.lit("t"), F.min(F.col("event_id") % 5).cast("string")).alias("type"))
    uses = f.seq.filter("op = 'load'").select("unit", F.col("idx").alias("pc"), "slot")
    return L.slot_type(uses, frames).select("unit", "pc", "slot", "type")


MAPPED = """
mp as (select unit, idx - idx % 3 as "offset", arg_min(event_id % 1000, idx) as new_line from v_seq where op in ('call', 'store') group by all),
lt as (select unit, idx as start_pc, event_id // 100 as line, idx as ord from v_seq where op = 'store')"""
ORIGINAL = f"""{MAPPED},
direct as (select lt.unit, lt.line, arg_max(mp.new_line, lt.ord) as new_line from lt join mp on mp.unit = lt.unit and mp."offset" = lt.start_pc group by all),
onl as (select mp.unit, mp."offset" as off, mp.new_line, (select arg_max(lt.line, lt.ord) from lt where lt.unit = mp.unit and lt.start_pc <= mp."offset") as line from mp),
orig as (select * from direct union all select unit, line, arg_min(new_line, off) from onl o where line is not null
  and not exists (select 1 from direct d where d.unit = o.unit and d.line = o.line) group by unit, line)"""


def mapped_offsets(f):
    rows = f.seq.filter("op in ('call', 'store')").select(
        "unit", (F.col("idx") - F.col("idx") % 3).alias("offset"), F.col("idx").alias("ord"),
        (F.col("event_id") % 1000).alias("new_line"))
    return L.offset_map(rows)


def coarse_lines(f):
    return f.seq.filter("op = 'store'").select(
        "unit", F.col("idx").alias("start_pc"), F.floor(F.col("event_id") / 100).cast("long").alias("line"),
        F.col("idx").alias("ord"))


@query("offset_line_map", f'with {MAPPED} select unit, "offset", new_line from mp')
def offset_line_map(f):
    return mapped_offsets(f)


@query("original_line_map", f"with {ORIGINAL} select unit, line, new_line from orig")
def original_line_map(f):
    return L.original_lines(coarse_lines(f), cut(mapped_offsets(f)))


@query("unmapped_lines", f"""with {ORIGINAL} select distinct unit, line from lt
where not exists (select 1 from orig o where o.unit = lt.unit and o.line = lt.line)""")
def unmapped_lines(f):
    return L.unmapped_lines(coarse_lines(f), L.original_lines(coarse_lines(f), cut(mapped_offsets(f))))


@query("line_comments", f"""with {ORIGINAL}
select unit, new_line // 50 as new_line, concat('// ', string_agg(distinct cast(line as varchar), ' ' order by line)) as comment
from (select distinct unit, new_line, line from orig) q group by unit, new_line // 50""".replace(
    "string_agg(distinct cast(line as varchar), ' ' order by line)",
    "array_to_string(list_transform(list_sort(list(distinct line)), lambda x: cast(x as varchar)), ' ')"))
def line_comments(f):
    original = L.original_lines(coarse_lines(f), cut(mapped_offsets(f)))
    return L.line_comments(original.withColumn("new_line", F.floor(F.col("new_line") / 50).cast("long")))


@query("text_positions", r"""
with b as (select class, start, left(text, start) as before from v_tok),
h as (select *, regexp_replace(before, '\n+$', '') as head from b)
select class, start, concat(cast(case when before = '' then 1 when head = '' then 0 else length(head) - length(replace(head, chr(10), '')) + 1 end as varchar), ':',
  cast(start + 1 - case when instr(reverse(before), chr(10)) = 0 then 0 else length(before) - instr(reverse(before), chr(10)) + 1 end as varchar)) as pos from h""")
def text_positions(f):
    return L.mark_positions(f.text, ".")


@query("token_links", """
with t as (select doc_id as class, lang as kind, source as owner, unnest(string_split(text, ' ')) as name, doc_id % 4 = 0 as is_decl,
  cast(unnest(range(len(string_split(text, ' ')))) as bigint) as start from documents),
d as (select kind, owner, name, min(class) as decl_class from t where is_decl group by all)
select r.class, r.start, r.kind, r.owner, r.name, d.decl_class from t r
left join d on d.kind = r.kind and d.owner = r.owner and d.name = r.name where not r.is_decl""")
def token_links(f):
    d = f.table("documents")
    tokens = d.select(
        F.col("doc_id").alias("class"), F.col("lang").alias("kind"), (F.col("doc_id") % 4 == 0).alias("is_decl"),
        F.col("source").alias("owner"), F.posexplode(F.split("text", " ")).alias("start", "name"), F.lit("").alias("descriptor"))
    return L.token_links(tokens.withColumn("start", F.col("start").cast("long"))).select("class", "start", "kind", "owner", "name", "decl_class")


# ---------------------------------------------------------------- data flow


@query("value_before_use", """
select s.unit, s.block, s.slot, s.idx, s.op, (select max(t.idx) from v_block t where t.unit = s.unit and t.block = s.block
  and t.slot = s.slot and t.op = 'store' and t.idx < s.idx) as def from v_block s where s.op in ('store', 'load')""")
def value_before_use(f):
    return D.value_before(f.block)


@query("read_before_write", """
select unit, block, slot, arg_min(op = 'load', idx) as read_first from v_block where op in ('store', 'load') group by all""")
def read_before_write(f):
    return D.first_access(f.block, ["unit", "block"])


@query("definition_numbers", """
select unit, slot, idx, row_number() over (partition by unit, slot order by idx) as version from v_seq where op = 'store'""")
def definition_numbers(f):
    return D.definition_numbers(f.seq)


REACHING = """
gen as (select unit, block, slot, max(idx) as def from v_block where op = 'store' group by all),
pass as (select distinct unit, src, dst, true as kills from v_edge union select distinct unit, src, dst, false from o_exc_edge),
rd as (select distinct e.unit, e.dst as block, g.slot, g.def from gen g join v_edge e on e.unit = g.unit and e.src = g.block
  union select r.unit, p.dst, r.slot, r.def from rd r join pass p on p.unit = r.unit and p.src = r.block
  left join gen g on p.kills and g.unit = r.unit and g.block = r.block and g.slot = r.slot where g.unit is null)"""


@query("reaching_definitions", f"with {REACHING} select unit, block, slot, def from rd")
def reaching_definitions(f):
    return D.reaching_definitions(f.block, f.edge, handler_edges(f))


@query("phi_sets", f"with {REACHING} select unit, block, slot, count(*) as versions from rd group by all having count(*) > 1")
def phi_sets(f):
    return D.phi_sets(D.reaching_definitions(f.block, f.edge, handler_edges(f)))


LIVE = """
fa as (select unit, block, slot, arg_min(op, idx) as op from v_block where op in ('store', 'load') group by all),
wr as (select distinct unit, block, slot from v_block where op = 'store'),
bk as (select distinct unit, src, dst, true as kills from v_edge union select distinct unit, src, dst, false from o_exc_edge),
lv as (select unit, block, slot from fa where op = 'load'
  union select l.unit, b.src, l.slot from lv l join bk b on b.unit = l.unit and b.dst = l.block
  left join wr w on b.kills and w.unit = l.unit and w.block = b.src and w.slot = l.slot where w.unit is null)"""


@query("live_slots", f"with {LIVE} select unit, block, slot from lv")
def live_slots(f):
    return D.live_slots(f.block, f.edge, handler_edges(f))


SSA = f"""{LIVE},
df as (select distinct e.unit, d.d as node, e.dst as front from o_live_flow e join o_dom d on d.unit = e.unit and d.n = e.src
  where not exists (select 1 from o_dom s where s.unit = e.unit and s.n = e.dst and s.d = d.d and s.n <> s.d)),
lp as (select l.* from lv l join o_reach r on r.unit = l.unit and r.node = l.block),
ph as (
  select distinct df.unit, df.front as block, lp.slot from df join lp on lp.unit = df.unit and lp.block = df.front
  where df.node = 1 or exists (select 1 from wr where wr.unit = df.unit and wr.block = df.node and wr.slot = lp.slot)
  union select df.unit, df.front, ph.slot from ph join df on df.unit = ph.unit and df.node = ph.block
  join lp on lp.unit = df.unit and lp.block = df.front and lp.slot = ph.slot)"""


def live_pairs(f):
    """Slots live at the start of the blocks that are reached."""
    if not hasattr(f, "_live_pairs"):
        reached = live_graph(f)[0].withColumnRenamed("node", "block")
        f._live_pairs = cut(D.live_slots(f.block, f.edge, handler_edges(f)).join(reached, ["unit", "block"], "left_semi"))
    return f._live_pairs


def phis(f):
    if not hasattr(f, "_phis"):
        tree = live_dominators(f)
        reached = f.block.join(live_graph(f)[0].withColumnRenamed("node", "block"), ["unit", "block"], "left_semi")
        f._phis = cut(D.phi_places(reached, D.dominance_frontiers(live_flow(f), tree), tree, live_pairs(f)))
    return f._phis


@query("dominance_frontiers", f"with {SSA} select unit, node, front from df")
def dominance_frontiers(f):
    return D.dominance_frontiers(live_flow(f), live_dominators(f))


@query("phi_places", f"with {SSA} select unit, block, slot from ph")
def phi_places(f):
    return phis(f)


@query("slot_versions", f"""with {SSA},
dp as (select unit, n, count(*) as depth from o_dom group by unit, n),
ls as (select unit, block, slot, max(idx) as idx from v_block where op = 'store' group by unit, block, slot),
ca as (
  select lp.unit, lp.block, lp.slot, dp.depth * 2 as r, 'phi' as kind, ph.block as spot from lp join o_dom d on d.unit = lp.unit and d.n = lp.block
  join ph on ph.unit = lp.unit and ph.block = d.d and ph.slot = lp.slot join dp on dp.unit = d.unit and dp.n = d.d
  union all
  select lp.unit, lp.block, lp.slot, dp.depth * 2 + 1, 'store', ls.idx from lp join o_dom d on d.unit = lp.unit and d.n = lp.block and d.d <> d.n
  join ls on ls.unit = lp.unit and ls.block = d.d and ls.slot = lp.slot join dp on dp.unit = d.unit and dp.n = d.d)
select lp.unit, lp.block, lp.slot, coalesce(arg_max(ca.kind, ca.r), 'entry') as kind, arg_max(ca.spot, ca.r) as "at"
from lp left join ca on ca.unit = lp.unit and ca.block = lp.block and ca.slot = lp.slot group by lp.unit, lp.block, lp.slot""")
def slot_versions(f):
    return D.versions_in(f.block, phis(f), live_dominators(f), live_pairs(f))


@query("live_versions", f"""with {REACHING}, {LIVE}
select r.unit, r.block, r.slot, r.def from rd r where exists
  (select 1 from lv l where l.unit = r.unit and l.block = r.block and l.slot = r.slot)""")
def live_versions(f):
    return D.live_versions(
        D.reaching_definitions(f.block, f.edge, handler_edges(f)), D.live_slots(f.block, f.edge, handler_edges(f)))


TOUCH = """
tc as (select unit, idx, slot, 'assign' as role from v_seq where op = 'store'
  union all select unit, idx, (slot + 1) % 4, 'read' from v_seq where op = 'store'
  union all select unit, idx, slot, 'effect' from v_seq where op = 'load'
  union all select unit, idx, slot, 'declare' from v_seq where op = 'goto'),
ln as (select r.unit, r.idx, max(m.idx) as prev from tc r join tc m on m.unit = r.unit and m.slot = r.slot and m.idx < r.idx
    and m.role in ('assign', 'effect') where r.role in ('read', 'effect') group by r.unit, r.idx, r.slot
  union select r.unit, r.idx, max(m.idx) from tc r join tc m on m.unit = r.unit and m.slot = r.slot and m.idx < r.idx
    and m.role = 'declare' where r.role in ('assign', 'declare') group by r.unit, r.idx, r.slot),
sl as (select unit, idx from v_seq where op = 'load'
  union select s.unit, l.prev from sl s join ln l on l.unit = s.unit and l.idx = s.idx)"""


@query("backward_slice", f"with {TOUCH} select unit, idx from sl")
def backward_slice(f):
    def touch(where, slot, role):
        return f.seq.filter(where).select("unit", "idx", slot.alias("slot"), F.lit(role).alias("role"))

    s = F.col("slot")
    touches = (
        touch("op = 'store'", s, "assign").unionByName(touch("op = 'store'", (s + 1) % 4, "read"))
        .unionByName(touch("op = 'load'", s, "effect")).unionByName(touch("op = 'goto'", s, "declare")))
    seeds = f.seq.filter("op = 'load'").select("unit", "idx")
    return D.backward_slice(seeds, D.slice_links(touches))


CODES = ["boolean", "bytechar", "byte", "shortchar", "short", "char", "int", "float", "null", "object"]
CODE_LIST = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"
BOUND = f"""
fam as (select * from (values ('boolean', 1), ('bytechar', 2), ('byte', 2), ('shortchar', 2), ('short', 2), ('char', 2), ('int', 2),
  ('float', 3), ('null', 6), ('object', 6)) t(type, family)),
st as (select * from (values ('bytechar', 'byte'), ('bytechar', 'shortchar'), ('byte', 'short'), ('shortchar', 'short'), ('shortchar', 'char'),
  ('short', 'int'), ('char', 'int'), ('null', 'object')) t(lo, hi)),
le as (select type as lo, type as hi from fam union select le.lo, st.hi from le join st on st.lo = le.hi),
wt as (select hi, count(*) as w from le group by hi),
ty as (select unit, block as node, {CODE_LIST}[cast(floor(min(event_id) / 7) as bigint) % 10 + 1] as type from v_block group by all)"""


def block_types(f):
    codes = F.array(*[F.lit(c) for c in CODES])
    least = f.block.groupBy("unit", F.col("block").alias("node")).agg(F.min("event_id").alias("_e"))
    return least.select("unit", "node", F.element_at(
        codes, (F.floor(F.col("_e") / 7).cast("long") % 10 + 1).cast("int")).alias("type"))


@query("type_bounds", f"""with {BOUND},
ed as (select distinct unit, src, dst from v_edge),
anc as (select unit, node as n, node as a from ty union select c.unit, c.n, e.src from anc c join ed e on e.unit = c.unit and e.dst = c.a),
s as (select distinct anc.unit, anc.n, ty.type, fam.family from anc join ty on ty.unit = anc.unit and ty.node = anc.a join fam on fam.type = ty.type),
mx as (select unit, n, max(family) as family from s group by all),
k as (select s.unit, s.n, s.type from s join mx on mx.unit = s.unit and mx.n = s.n and mx.family = s.family),
tot as (select unit, n, count(*) as c from k group by all),
ub as (select k.unit, k.n, le.hi from k join le on le.lo = k.type join tot on tot.unit = k.unit and tot.n = k.n group by k.unit, k.n, le.hi, tot.c having count(*) = tot.c)
select ub.unit, ub.n as node, arg_min(ub.hi, wt.w) as type from ub join wt on wt.hi = ub.hi group by all""")
def type_bounds(f):
    return D.type_bounds(block_types(f), f.edge, D.lattice(f.spark))


@query("type_bound_conflicts", f"""with {BOUND},
ed as (select distinct unit, src, dst from v_edge),
reach as (select unit, node as n, node as a from ty union select c.unit, c.n, e.src from reach c join ed e on e.unit = c.unit and e.dst = c.a),
s as (select distinct r.unit, r.n, ty.type, fam.family from reach r join ty on ty.unit = r.unit and ty.node = r.a join fam on fam.type = ty.type),
k as (select s.* from s join (select unit, n, max(family) as family from s group by all) m on m.unit = s.unit and m.n = s.n and m.family = s.family),
ub as (select k.unit, k.n, le.hi from k join le on le.lo = k.type join (select unit, n, count(*) as c from k group by all) t
  on t.unit = k.unit and t.n = k.n group by k.unit, k.n, le.hi, t.c having count(*) = t.c),
low as (select ub.unit, ub.n, arg_min(ub.hi, wt.w) as low from ub join wt on wt.hi = ub.hi group by all),
s2 as (select distinct r.unit, r.a as n, ty.type, fam.family from reach r join ty on ty.unit = r.unit and ty.node = r.n join fam on fam.type = ty.type),
k2 as (select s2.* from s2 join (select unit, n, min(family) as family from s2 group by all) m on m.unit = s2.unit and m.n = s2.n and m.family = s2.family),
lb as (select k2.unit, k2.n, le.lo from k2 join le on le.hi = k2.type join (select unit, n, count(*) as c from k2 group by all) t
  on t.unit = k2.unit and t.n = k2.n group by k2.unit, k2.n, le.lo, t.c having count(*) = t.c),
high as (select lb.unit, lb.n, arg_max(lb.lo, wt.w) as high from lb join wt on wt.hi = lb.lo group by all)
select low.unit, low.n as node, low.low, high.high from low join high on high.unit = low.unit and high.n = low.n
join fam a on a.type = low.low join fam b on b.type = high.high
where a.family <> 6 and b.family <> 6 and (a.family > b.family or (a.family = b.family
  and not exists (select 1 from le where le.lo = low.low and le.hi = high.high)))""")
def type_bound_conflicts(f):
    table = D.lattice(f.spark)
    back = f.edge.select("unit", F.col("dst").alias("src"), F.col("src").alias("dst"))
    lower = D.type_bounds(block_types(f), f.edge, table)
    return D.bound_conflicts(lower, D.type_bounds(block_types(f), back, table, upper=True), table)


@query("type_join", f"""with {BOUND},
e as (select distinct unit, src, dst from v_edge),
p as (select e.*, a.type as a, b.type as b, x.family = y.family as same from e
  join ty a on a.unit = e.unit and a.node = e.src join ty b on b.unit = e.unit and b.node = e.dst
  join fam x on x.type = a.type join fam y on y.type = b.type)
select p.unit, p.src, p.dst, case when p.same then exists (select 1 from le where le.lo = p.b and le.hi = p.a) and p.a <> p.b end as a_above_b,
  (select arg_min(u.hi, wt.w) from le u join le v on v.hi = u.hi join wt on wt.hi = u.hi where u.lo = p.a and v.lo = p.b) as "join",
  (select arg_max(u.lo, wt.w) from le u join le v on v.lo = u.lo join wt on wt.hi = u.lo where u.hi = p.a and v.hi = p.b) as meet from p""")
def type_join(f):
    types = cut(block_types(f))
    a = types.select("unit", F.col("node").alias("src"), F.col("type").alias("a"))
    b = types.select("unit", F.col("node").alias("dst"), F.col("type").alias("b"))
    edges = f.edge.select("unit", "src", "dst").distinct().join(a, ["unit", "src"]).join(b, ["unit", "dst"])
    return edges.join(D.pairwise(D.lattice(f.spark)), ["a", "b"], "left").select(
        "unit", "src", "dst", "a_above_b", "join", "meet")


# ---------------------------------------------------------------- exception flow


def exc_closure(f):
    parents = f.exc_type.filter("super is not null").select(
        F.col("exc").alias("node"), F.col("super").alias("parent"), F.lit(0).alias("pos"))
    return cut(H.closure(parents, f.exc_type.select(F.col("exc").alias("node"))))


@query("checked_exceptions", """
with t as (select exc from v_exc_type union select concat(p_type, case p_partkey % 3 when 0 then 'Exception' when 1 then 'Error' else 'RuntimeException' end) from part)
select t.exc, case when exists (select 1 from o_exc_up u where u.exc = t.exc and u.anc in ('X2', 'X3')) then false
  when exists (select 1 from v_exc_type x where x.exc = t.exc) then true
  else t.exc like '%Exception' and t.exc not like '%RuntimeException' end as checked from t""")
def checked_exceptions(f):
    p = f.table("part")
    tail = F.when(F.col("p_partkey") % 3 == 0, "Exception").when(F.col("p_partkey") % 3 == 1, "Error").otherwise("RuntimeException")
    types = f.exc_type.select("exc").unionByName(p.select(F.concat("p_type", tail).alias("exc")))
    return E.is_checked(types, exc_closure(f), ["X0"], ["X2", "X3"])


def near_types(f):
    up = f.raised.select(F.col("node").alias("dst"), "exc")
    return f.call.join(up, "dst").select(F.col("src").alias("node"), "exc", F.col("dst").alias("ord"))


NEAR = "nr as (select c.src as node, r.exc, c.dst as ord from v_call c join v_raise r on r.node = c.dst)"


@query("covered_types", f"""with {NEAR}
select distinct n.node, n.exc from nr n join o_exc_up u on u.exc = n.exc join v_exc x on x.src = n.node and x.caught = u.anc""")
def covered_types(f):
    declared = f.exc.filter("caught is not null").select(F.col("src").alias("node"), F.col("caught").alias("exc")).distinct()
    return E.covered(near_types(f).select("node", "exc").distinct(), declared, exc_closure(f))


@query("shadowed_catches", """
with c as (select src as site, dst as ord, caught as exc from v_exc where caught is not null)
select distinct c.site, c.ord, c.exc from c join o_exc_up u on u.exc = c.exc join c d on d.site = c.site and d.exc = u.anc and d.ord < c.ord""")
def shadowed_catches(f):
    catches = f.exc.filter("caught is not null").select(
        F.col("src").alias("site"), F.col("dst").alias("ord"), F.col("caught").alias("exc"))
    return E.shadowed(catches, exc_closure(f))


@query("escaping_type_sets", f"with {NEAR} select node, list_sort(list(distinct exc)) as types from nr group by node")
def escaping_type_sets(f):
    return E.type_sets(near_types(f))


@query("irredundant_types", f"""with {NEAR}, s as (select distinct node, exc from nr)
select node, exc from s where not exists (select 1 from o_exc_up u join s t on t.node = s.node and t.exc = u.anc where u.exc = s.exc and u.anc <> s.exc)""")
def irredundant_types(f):
    return E.drop_redundant(near_types(f).select("node", "exc").distinct(), exc_closure(f))


@query("specific_types_first", f"""with {NEAR},
s as (select node, exc, min(ord) as ord from nr group by all),
below as (select list(concat(exc, '<', anc)) as pairs from o_exc_up where exc <> anc),
st as (select node, list(exc order by ord, exc) as rem, cast(-1 as bigint) as place, ''::varchar as pick from s group by node),
w as (select node, rem, place, pick from st
  union all select node, list_filter(rem, lambda x: x <> nxt), place + 1, nxt from
    (select w.node, w.rem, w.place, list_filter(w.rem, lambda x: len(list_filter(w.rem, lambda y: list_contains(below.pairs, concat(y, '<', x)))) = 0)[1] as nxt
     from w, below where len(w.rem) > 0) q)
select w.node, w.pick as exc, s.ord, w.place from w join s on s.node = w.node and s.exc = w.pick where w.place >= 0""")
def specific_types_first(f):
    return E.specific_first(near_types(f), exc_closure(f))


PROPAGATION = """
dc as (select p_partkey as node, concat('X', cast(p_partkey % 5 as varchar)) as exc from part where p_partkey % 10 = 0),
lm as (select p_partkey as node, 0 as decl, concat('X', cast(p_partkey % 2 as varchar)) as exc from part where p_partkey % 7 = 0
  union all select p_partkey, 1, concat('X', cast(p_partkey % 3 as varchar)) from part where p_partkey % 14 = 0),
ty as (select exc from v_exc_type),
deny as (select distinct lm.node, ty.exc from lm join ty on not exists (select 1 from lm k join o_exc_up u on u.exc = ty.exc and u.anc = k.exc
    where k.node = lm.node and k.decl = lm.decl)
  union select dc.node, u.exc from dc join o_exc_up u on u.anc = dc.exc
  union select p_partkey, ty.exc from part, ty where p_partkey % 50 = 7),
go as (select distinct x.src, x.dst, ty.exc from v_exc x, ty where not exists
    (select 1 from o_exc_up u where u.exc = ty.exc and u.anc = x.caught)
  except select d.node, c.dst, d.exc from deny d join v_call c on c.src = d.node),
es as (select r.node, r.exc from v_raise r where not exists (select 1 from deny d where d.node = r.node and d.exc = r.exc)
  union select node, exc from dc
  union select g.src, es.exc from es join go g on g.dst = es.node and g.exc = es.exc)"""


@query("exception_propagation", f"""with {PROPAGATION}
select node, exc from es where not exists (select 1 from dc where dc.node = es.node and dc.exc = es.exc)""")
def exception_propagation(f):
    p = f.table("part").select(F.col("p_partkey").alias("node"))
    kind = lambda n: F.concat(F.lit("X"), (F.col("node") % n).cast("string")).alias("exc")
    declared = p.filter("node % 10 = 0").select("node", kind(5))
    limits = p.filter("node % 7 = 0").select("node", F.lit(0).alias("decl"), kind(2)).unionByName(
        p.filter("node % 14 = 0").select("node", F.lit(1).alias("decl"), kind(3)))
    site = F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string")).alias("site")
    calls = f.exc.select(site, "src", "dst")
    catches = f.exc.select(site, F.col("caught").alias("exc"))
    return E.propagate(f.raised, calls, catches, exc_closure(f), declared, limits, p.filter("node % 50 = 7"))


@query("unknown_throwers", """
select distinct src as node from v_exc where dst % 9 = 4 and coalesce(caught not in ('X0', 'X1'), true)""")
def unknown_throwers(f):
    site = F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string")).alias("site")
    known = f.hier.filter("node % 9 <> 4").select("node")
    return E.unknown_flags(
        f.exc.select(site, "src", "dst"), known, f.exc.select(site, F.col("caught").alias("exc")), ["X0", "X1"])


@query("protected_flow", """
with pt as (select src as site, case dst % 3 when 0 then 'body' when 1 then 'handler' else 'final' end as part,
  coalesce(caught, 'X5') as exc, case when dst % 7 = 1 then 'all' else 'typed' end as kind from v_exc)
select distinct site, exc from pt where part <> 'body' or not exists
  (select 1 from pt h where h.site = pt.site and h.part = 'handler' and h.kind = 'all')""")
def protected_flow(f):
    d = F.col("dst")
    parts = f.exc.select(
        F.col("src").alias("site"), F.when(d % 3 == 0, "body").when(d % 3 == 1, "handler").otherwise("final").alias("part"),
        F.coalesce("caught", F.lit("X5")).alias("exc"), F.when(d % 7 == 1, "all").otherwise("typed").alias("kind"))
    return E.protected_flow(parts)


# ---------------------------------------------------------------- regions and lists


@query("duplicate_blocks", """
with fs as (select unit, block, slot, dense_rank() over (partition by unit, block order by min(idx)) as ns
  from v_block where op in ('store', 'load') group by unit, block, slot),
sg as (select b.unit, b.block, count(*) as size, string_agg(concat(b.op, ':', case when b.op in ('store', 'load') then fs.ns else -1 end), ',' order by b.idx) as sig
  from v_block b left join fs on fs.unit = b.unit and fs.block = b.block and fs.slot = b.slot group by b.unit, b.block),
g as (select sig, count(*) as copies, min((unit, block)) as r from sg group by sig having count(*) > 1)
select sg.unit, sg.block, sg.size, g.copies, g.r[1] as rep_unit, g.r[2] as rep_block from sg join g on g.sig = sg.sig""")
def duplicate_blocks(f):
    return R.duplicate_blocks(cut(R.normalised(f.block)))


@query("equal_subgraphs", """
with fs as (select unit, block, slot, dense_rank() over (partition by unit, block order by min(idx)) as ns
  from v_block where op in ('store', 'load') group by unit, block, slot),
sg as (select b.unit, b.block as node, string_agg(concat(b.op, ':', case when b.op in ('store', 'load') then fs.ns else -1 end), ',' order by b.idx) as sig
  from v_block b left join fs on fs.unit = b.unit and fs.block = b.block and fs.slot = b.slot group by b.unit, b.block),
et as (select m.unit, m.block as src, h.block as dst, min((m.from_idx, m.to_idx, m.handler_idx)) as spot,
    string_agg(distinct r.exc_type, ',' order by r.exc_type) as types
  from o_member_of m join v_block h on h.unit = m.unit and h.idx = m.handler_idx
  join v_range r on r.unit = m.unit and r.from_idx = m.from_idx and r.to_idx = m.to_idx and r.handler_idx = m.handler_idx
  group by m.unit, m.block, h.block),
ou as (select unit, src, concat('r', ord) as place, dst from v_edge
  union select unit, src, concat('e', row_number() over (partition by unit, src order by spot), ':', types), dst from et),
pl as (select sg.unit, sg.node, sg.sig, coalesce(string_agg(ou.place, ' ' order by ou.place), '') as places
  from sg left join ou on ou.unit = sg.unit and ou.src = sg.node group by all),
-- pairs of blocks with like instructions and places of successors; struck out where the successors in one place are not such a pair
ca as (select x.unit, x.node as x, y.node as y from pl x join pl y on y.unit = x.unit and y.sig = x.sig and y.places = x.places and x.node <> y.node),
nx as (select ca.unit, ca.x, ca.y, p.dst as nx, q.dst as ny from ca join ou p on p.unit = ca.unit and p.src = ca.x
  join ou q on q.unit = ca.unit and q.src = ca.y and q.place = p.place),
bad as (select unit, x, y from nx where nx <> ny and not exists (select 1 from ca where ca.unit = nx.unit and ca.x = nx.nx and ca.y = nx.ny)
  union select nx.unit, nx.x, nx.y from bad join nx on nx.unit = bad.unit and nx.nx = bad.x and nx.ny = bad.y),
eq as (select unit, x, y from ca where not exists (select 1 from bad where bad.unit = ca.unit and bad.x = ca.x and bad.y = ca.y)),
-- both walked in step: the slots on the way have to correspond one to one
wk as (select unit, x as a, y as b, x, y from eq
  union select w.unit, w.a, w.b, p.dst, q.dst from wk w join ou p on p.unit = w.unit and p.src = w.x
    join ou q on q.unit = w.unit and q.src = w.y and q.place = p.place),
mp as (select distinct w.unit, w.a, w.b, s.slot as s, t.slot as t from wk w join fs s on s.unit = w.unit and s.block = w.x
  join fs t on t.unit = w.unit and t.block = w.y and t.ns = s.ns),
un as (select unit, a, b from mp group by unit, a, b, s having count(*) > 1 union select unit, a, b from mp group by unit, a, b, t having count(*) > 1)
select unit, min(x) as a, y as b from eq where not exists (select 1 from un where un.unit = eq.unit and un.a = eq.x and un.b = eq.y)
group by unit, y having min(x) < y""")
def equal_subgraphs(f):
    outs = cut(R.successors(f.block, f.edge, f.range))
    return R.analogous_subgraphs(
        R.equal_subgraphs(R.block_classes(f.block), outs), outs, R.local_slots(f.block))


def type_uses(f):
    o, p = F.col("owner"), lambda c: F.concat(F.lit("p"), (F.col(c) % 7).cast("string"))
    return f.ref.select(
        F.col("caller").alias("class"), F.when(o % 7 == 0, "").when(o % 7 == 1, "java.lang").otherwise(p("owner")).alias("package"),
        F.concat(F.lit("C"), (o % 5).cast("string")).alias("simple"), o.alias("ord"))


USES = """
us as (select distinct caller as class, case when owner % 7 = 0 then '' when owner % 7 = 1 then 'java.lang' else concat('p', cast(owner % 7 as varchar)) end as package,
  concat('C', cast(owner % 5 as varchar)) as simple, owner as ord from v_ref),
fp as (select class, simple, arg_min(package, (ord, package)) as package from us group by all)"""


@query("import_table", f"""with {USES}
select class, package, simple from fp where package not in ('', 'java.lang') and package <> concat('p', cast(class % 7 as varchar))""")
def import_table(f):
    own = f.ref.select(
        F.col("caller").alias("class"), F.concat(F.lit("p"), (F.col("caller") % 7).cast("string")).alias("own_package")).distinct()
    return R.import_table(type_uses(f), own, "java.lang")


@query("qualified_names", f"""with {USES}
select distinct us.class, us.package, us.simple from us join fp on fp.class = us.class and fp.simple = us.simple where us.package <> fp.package""")
def qualified_names(f):
    return R.qualified_uses(type_uses(f))


@query("append_chains", """
with b as (select unit, idx, event_id, case when op in ('store', 'general') then 'new' when op = 'load' then 'operand' when op in ('jump', 'goto', 'call') then 'end' else 'other' end as op from v_seq),
i as (select *, sum(case when op = 'operand' then 0 else 1 end) over (partition by unit order by idx) as isl from b),
h as (select unit, isl, min(idx) as chain, arg_min(op, idx) as op from i where op <> 'operand' group by all),
g as (select a.unit, a.isl, a.chain from h a join h z on z.unit = a.unit and z.isl = a.isl + 1 and z.op = 'end' where a.op = 'new')
select i.unit, g.chain, i.idx - g.chain as pos, i.event_id as value from i join g on g.unit = i.unit and g.isl = i.isl where i.op = 'operand'""")
def append_chains(f):
    kind = (
        F.when(F.col("op").isin("store", "general"), "new").when(F.col("op") == "load", "operand")
        .when(F.col("op").isin("jump", "goto", "call"), "end").otherwise("other"))
    rows = f.seq.select("unit", "idx", kind.alias("op"), F.col("event_id").alias("value"))
    return R.append_chains(rows, "new", "operand", "end")


@query("agreeing_parameters", """
with l as (select unit % 10 as grp, unit as list, idx as pos, n as size, op as value from v_seq),
p as (select *, case when pos = 0 then -1 else size - pos end as place from l),
t as (select grp, count(distinct list) as lists, min(list) as list from l group by grp),
s as (select grp, place, count(*) as n, count(distinct value) as d from p group by all)
select p.grp, p.pos, case when s.n = t.lists and s.d = 1 then p.value end as value from p
join t on t.grp = p.grp and t.list = p.list join s on s.grp = p.grp and s.place = p.place""")
def agreeing_parameters(f):
    lists = f.seq.select(
        (F.col("unit") % 10).alias("grp"), F.col("unit").alias("list"), F.col("idx").alias("pos"),
        F.col("n").alias("size"), F.col("op").alias("value"))
    return R.agreeing_positions(lists, "grp")
