"""Protected ranges bound to the event-derived instruction streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from classlake.operators import blocks as B
from classlake.operators import ranges as R
from classlake.plans.graph_queries import handler_edges, live_dominators, live_flow
from classlake.plans.registry import query


@query("range_members", "select unit, from_idx, to_idx, handler_idx, block from o_member_of")
def range_members(f):
    return R.members(f.block, f.range)


@query("exception_edges", "select unit, src, dst, exc_type from o_exc_edge")
def exception_edges(f):
    return R.exception_edges(f.block, f.range)


@query("merged_handlers", """
select unit, from_idx, to_idx, handler_idx, list_sort(list(distinct exc_type)) as exc_types from v_range group by all""")
def merged_handlers(f):
    return R.merged_handlers(f.range)


@query("logical_ranges", """
select unit, handler_idx, types, count(distinct (from_idx, to_idx)) as parts, count(distinct block) as blocks
from o_logical group by all""")
def logical_ranges(f):
    return R.logical_summary(R.logical_ranges(f.block, f.range))


@query("type_set_equality", """
with h as (select unit, from_idx, to_idx, handler_idx, list_sort(list(distinct exc_type)) as t from v_range group by all),
f as (select unit, handler_idx, t from h qualify row_number() over (partition by unit, handler_idx order by from_idx, to_idx) = 1)
select h.unit, h.from_idx, h.to_idx, h.handler_idx, h.t = f.t as same from h join f
on f.unit = h.unit and f.handler_idx = h.handler_idx""")
def type_set_equality(f):
    return R.first_type_set(R.merged_handlers(f.range))


@query("range_entries", "select unit, handler_idx, types, block from o_entry")
def range_entries(f):
    return R.range_entries(R.logical_ranges(f.block, f.range), f.node, f.edge)


@query("malformed_ranges", """
select unit, handler_idx, types, count(*) as entries from o_entry group by all having count(*) > 1""")
def malformed_ranges(f):
    return R.malformed_ranges(R.range_entries(R.logical_ranges(f.block, f.range), f.node, f.edge))


def safe_blocks(f):
    return f.block.groupBy("unit", F.col("block").alias("node")).agg(
        F.max(F.col("op") == "call").alias("c")).filter("not c").select("unit", "node")


@query("split_range_merge", """
with wide as (select distinct unit, from_idx, to_idx, 0 as handler_idx, 'E' as types from v_range),
lg as (select distinct w.*, b.block from wide w join v_block b on b.unit = w.unit and b.idx >= w.from_idx and b.idx < w.to_idx),
safe as (select unit, block from v_block group by unit, block having not bool_or(op = 'call')),
lr as (select unit, handler_idx, types from lg group by all having count(distinct (from_idx, to_idx)) > 1),
ins as (select distinct l.unit, l.handler_idx, l.types, l.block from lg l
  join lr on lr.unit = l.unit and lr.handler_idx = l.handler_idx and lr.types = l.types),
cand as (select lr.*, s.block from lr join safe s on s.unit = lr.unit where not exists
  (select 1 from ins i where i.unit = lr.unit and i.handler_idx = lr.handler_idx and i.types = lr.types and i.block = s.block)),
u as (select unit, src as a, dst as b from v_edge union select unit, dst, src from v_edge),
cc as (select unit, handler_idx, types, block, block as r from cand
  union select cc.unit, cc.handler_idx, cc.types, cc.block, c.block from cc join u on u.unit = cc.unit and u.a = cc.r
    join cand c on c.unit = cc.unit and c.handler_idx = cc.handler_idx and c.types = cc.types and c.block = u.b),
grp as (select unit, handler_idx, types, block, min(r) as g from cc group by all),
ext as (select g.unit, g.handler_idx, g.types, g.g, e.src as o, 'in' as way from grp g join v_edge e on e.unit = g.unit and e.dst = g.block
    where not exists (select 1 from grp k where k.unit = g.unit and k.handler_idx = g.handler_idx and k.types = g.types and k.g = g.g and k.block = e.src)
  union all select g.unit, g.handler_idx, g.types, g.g, e.dst, 'out' from grp g join v_edge e on e.unit = g.unit and e.src = g.block
    where not exists (select 1 from grp k where k.unit = g.unit and k.handler_idx = g.handler_idx and k.types = g.types and k.g = g.g and k.block = e.dst)),
bad as (select g.unit, g.handler_idx, g.types, g.g from grp g where not exists (select 1 from v_edge e where e.unit = g.unit and e.src = g.block)
    or not exists (select 1 from v_edge e where e.unit = g.unit and e.dst = g.block)
  union select x.unit, x.handler_idx, x.types, x.g from ext x where not exists
    (select 1 from ins i where i.unit = x.unit and i.handler_idx = x.handler_idx and i.types = x.types and i.block = x.o)),
good as (select unit, handler_idx, types, g from ext group by all having bool_or(way = 'in') and bool_or(way = 'out')
  except select unit, handler_idx, types, g from bad),
gain as (select g.unit, g.handler_idx, g.types, g.block from grp g join good on good.unit = g.unit
  and good.handler_idx = g.handler_idx and good.types = g.types and good.g = g.g),
grown as (select * from ins union select * from gain),
ent as (select * from grown where block = 1 union
  select g.unit, g.handler_idx, g.types, g.block from grown g join v_edge e on e.unit = g.unit and e.dst = g.block
  where not exists (select 1 from grown k where k.unit = g.unit and k.handler_idx = g.handler_idx and k.types = g.types and k.block = e.src)),
wild as (select unit, handler_idx, types from ent group by all having count(*) > 1)
select * from gain g where not exists (select 1 from wild w where w.unit = g.unit and w.handler_idx = g.handler_idx and w.types = g.types)""")
def split_range_merge(f):
    return R.merge_split(R.logical_ranges(f.block, f.wide), f.node, f.edge, safe_blocks(f))


@query("circular_range_parts", """
with hb as (select m.*, h.block as hb from o_member_of m join v_block h on h.unit = m.unit and h.idx = m.handler_idx),
ok as (select hb.* from hb join o_dom d on d.unit = hb.unit and d.n = hb.block and d.d = hb.hb),
allsucc as (select unit, src, dst from o_live_edge union select x.unit, x.src, x.dst from o_exc_edge x
  join o_reach r on r.unit = x.unit and r.node = x.src),
w as (select unit, from_idx, to_idx, handler_idx, block from ok where block = hb
  union select w.unit, w.from_idx, w.to_idx, w.handler_idx, ok.block from w join allsucc a on a.unit = w.unit and a.src = w.block
    join ok on ok.unit = w.unit and ok.from_idx = w.from_idx and ok.to_idx = w.to_idx and ok.handler_idx = w.handler_idx and ok.block = a.dst)
select w.* from w where (select count(*) from w k where k.unit = w.unit and k.from_idx = w.from_idx and k.to_idx = w.to_idx and k.handler_idx = w.handler_idx)
    < (select count(*) from o_member_of m where m.unit = w.unit and m.from_idx = w.from_idx and m.to_idx = w.to_idx and m.handler_idx = w.handler_idx)
  or (select count(*) from o_member_of m where m.unit = w.unit and m.from_idx = w.from_idx and m.to_idx = w.to_idx and m.handler_idx = w.handler_idx) = 1""")
def circular_range_parts(f):
    return R.circular_parts(f.block, f.range, live_flow(f), live_dominators(f))


@query("empty_ranges", """
with filled as (select distinct unit, block from v_block where op <> 'store' and op <> 'general')
select distinct unit, from_idx, to_idx, handler_idx from o_member_of m where not exists
  (select 1 from o_member_of k join filled b on b.unit = k.unit and b.block = k.block
   where k.unit = m.unit and k.from_idx = m.from_idx and k.to_idx = m.to_idx and k.handler_idx = m.handler_idx)""")
def empty_ranges(f):
    filled = f.block.filter("op <> 'store' and op <> 'general'").select("unit", "block").distinct()
    return R.empty_ranges(R.members(f.block, f.range), filled)


@query("inert_clone_ranges", """
with st as (select r.unit, r.from_idx, r.to_idx, r.handler_idx, r.exc_type, bool_or(s.op = 'call') as can_throw
  from (select distinct * from v_range) r join v_seq s on s.unit = r.unit and s.idx >= r.from_idx and s.idx < r.to_idx group by all),
g as (select unit, exc_type from st group by all having count(distinct handler_idx) >= 2 and bool_or(can_throw))
select unit, from_idx, to_idx, handler_idx, exc_type from st join g using (unit, exc_type) where not can_throw""")
def inert_clone_ranges(f):
    return R.inert_clones(f.seq, f.range, "exc_type", ["call"])


@query("all_edges", """
select distinct unit, src, dst, 'regular' as etype from v_edge
union all select distinct unit, src, dst, 'exception' from o_exc_edge""")
def all_edges(f):
    return R.all_edges(f.edge, handler_edges(f))


@query("common_handlers", """
with nb as (select unit, src as node, dst as nb from v_edge union select unit, dst, src from v_edge),
c as (select unit, node, count(*) as n from nb group by all),
x as (select distinct unit, src, dst from o_exc_edge)
select nb.unit, nb.node, x.dst as handler from nb join x on x.unit = nb.unit and x.src = nb.nb
join c on c.unit = nb.unit and c.node = nb.node group by nb.unit, nb.node, x.dst, c.n having count(*) = c.n""")
def common_handlers(f):
    return R.common_handlers(f.node, f.edge, handler_edges(f))


@query("range_membership_xor", """
with p as (select distinct unit, src, dst from v_edge),
a as (select p.*, m.from_idx, m.to_idx, m.handler_idx from p join o_member_of m on m.unit = p.unit and m.block = p.src),
b as (select p.*, m.from_idx, m.to_idx, m.handler_idx from p join o_member_of m on m.unit = p.unit and m.block = p.dst)
select distinct unit, src, dst from ((select * from a except select * from b) union all (select * from b except select * from a)) q""")
def range_membership_xor(f):
    return R.split_pairs(f.edge.select("unit", "src", "dst").distinct(), R.members(f.block, f.range))


@query("slot_set_overlap", """
with s as (select distinct unit, block as node, slot as item from v_block where op in ('store', 'load'))
select distinct e.unit, e.src, e.dst from v_edge e join s a on a.unit = e.unit and a.node = e.src
join s b on b.unit = e.unit and b.node = e.dst and b.item = a.item""")
def slot_set_overlap(f):
    sets = f.block.filter("op in ('store', 'load')").select(
        "unit", F.col("block").alias("node"), F.col("slot").alias("item")).distinct()
    return R.overlapping_pairs(f.edge.select("unit", "src", "dst").distinct(), sets)


@query("return_range_alignment", """
with last as (select unit, block, max(idx) as hi, min(idx) as lo, arg_max(op, idx) as op, arg_min(op, idx) as op0 from v_block group by unit, block),
ret as (select unit, block as node from last where op = 'return' and (lo = hi or (hi = lo + 1 and op0 = 'load'))),
p as (select distinct e.unit, e.dst as node, e.src as p from v_edge e join ret on ret.unit = e.unit and ret.node = e.dst),
c as (select unit, node, count(*) as n from p group by all),
x as (select distinct unit, src as node, dst as handler from o_exc_edge),
k as (select p.unit, p.node, x.handler, count(*) as k from p join x on x.unit = p.unit and x.node = p.p group by all),
gain as (select k.unit, k.node, k.handler from k join c on c.unit = k.unit and c.node = k.node and c.n = k.k
  except select unit, node, handler from x),
lose as (select x.* from x join c on c.unit = x.unit and c.node = x.node where not exists
  (select 1 from k where k.unit = x.unit and k.node = x.node and k.handler = x.handler)),
allr as (select unit, handler, count(*) as n from (select * from x union all select * from gain) q group by all),
gone as (select unit, handler, count(*) as n, max(node) as last from lose group by all)
select unit, node, handler, 'add' as change from gain
union all select l.unit, l.node, l.handler, 'drop' from lose l join allr a on a.unit = l.unit and a.handler = l.handler
join gone g on g.unit = l.unit and g.handler = l.handler where not (a.n = g.n and l.node = g.last)""")
def return_range_alignment(f):
    shape = f.block.groupBy("unit", F.col("block").alias("node")).agg(
        F.min("idx").alias("lo"), F.max("idx").alias("hi"),
        F.max_by("op", "idx").alias("op"), F.min_by("op", "idx").alias("op0"))
    returns = shape.filter("op = 'return' and (lo = hi or (hi = lo + 1 and op0 = 'load'))").select("unit", "node")
    return R.align_returns(returns, f.edge, handler_edges(f))
