"""Block graphs: construction, reachability, dominators, loops, contraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from classlake import iterate
from classlake.iterate import cut
from classlake.operators import blocks as B
from classlake.operators import graph as G
from classlake.operators import ranges as R
from classlake.plans.registry import query


def handler_edges(f):
    if not hasattr(f, "_exc_edges"):
        f._exc_edges = cut(R.exception_edges(f.block, f.range))
    return f._exc_edges


def flow(f):
    """Regular and exception successors: (unit, src, dst)."""
    if not hasattr(f, "_flow"):
        f._flow = cut(R.all_edges(f.edge, handler_edges(f)).select("unit", "src", "dst").distinct())
    return f._flow


def live_graph(f):
    """Nodes that either kind of successor reaches, and the regular edges among them."""
    if not hasattr(f, "_live"):
        f._live = G.drop_dead(f.node, f.edge, flow(f))
    return f._live


def live_flow(f):
    return flow(f).join(live_graph(f)[0].withColumnRenamed("node", "src"), ["unit", "src"], "left_semi")


def live_dominators(f):
    """Dominator tree with exception predecessors."""
    if not hasattr(f, "_dom"):
        nodes = live_graph(f)[0]
        f._dom = cut(G.dominator_tree(nodes, live_flow(f), live=nodes))
    return f._dom


def block_sizes(f):
    return f.block.groupBy("unit", F.col("block").alias("node")).agg(F.count(F.lit(1)).alias("size"))


def goto_links(f):
    last = B.last_instructions(f.block).filter("op = 'goto'").select("unit", F.col("block").alias("src"))
    one = f.edge.groupBy("unit", "src").agg(F.min("dst").alias("target"), F.count(F.lit(1)).alias("_n"))
    return one.filter("_n = 1").join(last, ["unit", "src"], "left_semi").select(
        "unit", F.col("src").alias("node"), "target")


def jump_only(f):
    single = (
        f.block.groupBy("unit", F.col("block").alias("node"))
        .agg(F.count(F.lit(1)).alias("_n"), F.max("op").alias("op"))
        .filter("_n = 1 and op = 'goto'").select("unit", "node"))
    handlers = handler_edges(f).select("unit", F.col("dst").alias("node")).distinct()
    return single.join(handlers, ["unit", "node"], "left_anti")


@query("block_ids", "select unit, idx, op, block from v_block")
def block_ids(f):
    return B.block_ids(f.seq, f.jump, f.range).select("unit", "idx", "op", "block")


@query("block_edges", "select unit, src, dst, cast(ord as bigint) as ord from v_edge")
def block_edges(f):
    return B.block_edges(f.block, f.jump).withColumn("ord", F.col("ord").cast("long"))


@query("reachable_blocks", "select unit, node from o_reach")
def reachable_blocks(f):
    return G.reachable(f.node, flow(f))


@query("graph_summary", """
select b.unit, b.blocks, coalesce(e.edges, 0) as edges, b.blocks - r.live as unreachable
from (select unit, count(distinct block) as blocks from v_block group by unit) b
join (select unit, count(*) as live from o_reach group by unit) r on r.unit = b.unit
left join (select unit, count(*) as edges from v_edge group by unit) e on e.unit = b.unit""")
def graph_summary(f):
    blocks = f.node.groupBy("unit").agg(F.count(F.lit(1)).alias("blocks"))
    live = G.reachable(f.node, flow(f)).groupBy("unit").agg(F.count(F.lit(1)).alias("live"))
    edges = f.edge.groupBy("unit").agg(F.count(F.lit(1)).alias("edges"))
    return (
        blocks.join(live, "unit").join(edges, "unit", "left")
        .select("unit", "blocks", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"),
                (F.col("blocks") - F.col("live")).alias("unreachable")))


@query("dead_block_removal", "select unit, src, dst, cast(ord as bigint) as ord from o_live_edge")
def dead_block_removal(f):
    return live_graph(f)[1].withColumn("ord", F.col("ord").cast("long"))


@query("unreachable_blocks", """
select unit, node from v_node n where not exists (select 1 from o_reach r where r.unit = n.unit and r.node = n.node)""")
def unreachable_blocks(f):
    return G.unreachable(f.node, flow(f))


@query("virtual_exit_edges", """
select unit, node as src, cast(-1 as bigint) as dst from v_node n
where not exists (select 1 from v_edge e where e.unit = n.unit and e.src = n.node)""")
def virtual_exit_edges(f):
    return B.exit_edges(f.node, f.edge).select("unit", "src", "dst")


@query("jump_bypass", """
with hop as (
  select unit, node, target as cur from o_goto
  union select h.unit, h.node, g.target from hop h join o_goto g on g.unit = h.unit and g.node = h.cur),
ends as (select distinct unit, node from hop h where not exists
  (select 1 from o_goto g where g.unit = h.unit and g.node = h.cur)),
link as (select g.* from o_goto g join o_removable r on r.unit = g.unit and r.node = g.node
  join ends e on e.unit = g.unit and e.node = g.node),
walk as (
  select unit, node, target as cur from link
  union select w.unit, w.node, l.target from walk w join link l on l.unit = w.unit and l.node = w.cur),
fin as (select unit, node, cur from walk w where not exists
  (select 1 from link l where l.unit = w.unit and l.node = w.cur))
select e.unit, e.src, coalesce(fin.cur, e.dst) as dst, cast(e.ord as bigint) as ord
from v_edge e left join fin on fin.unit = e.unit and fin.node = e.dst
where not exists (select 1 from link l where l.unit = e.unit and l.node = e.src)""")
def jump_bypass(f):
    return G.bypass(f.edge, goto_links(f), jump_only(f)).withColumn("ord", F.col("ord").cast("long"))


@query("chain_merge", """
with one_out as (select unit, src from o_live_edge group by unit, src having count(*) = 1),
one_in as (select unit, dst from o_live_edge group by unit, dst having count(*) = 1),
ok as (select e.unit, e.src, e.dst from o_live_edge e
  join one_out o on o.unit = e.unit and o.src = e.src join one_in i on i.unit = e.unit and i.dst = e.dst
  where e.dst <> 1
    and not exists (select 1 from o_exc_edge x where x.unit = e.unit and x.dst = e.dst)
    and not exists (select 1 from o_member_of m where m.unit = e.unit and m.block = e.src and not exists
      (select 1 from o_member_of k where k.unit = m.unit and k.from_idx = m.from_idx and k.to_idx = m.to_idx
         and k.handler_idx = m.handler_idx and k.block = e.dst))
    and not exists (select 1 from o_member_of m where m.unit = e.unit and m.block = e.dst and not exists
      (select 1 from o_member_of k where k.unit = m.unit and k.from_idx = m.from_idx and k.to_idx = m.to_idx
         and k.handler_idx = m.handler_idx and k.block = e.src))),
walk as (
  select unit, node as head, cast(0 as bigint) as pos, node from o_reach r
  where not exists (select 1 from ok where ok.unit = r.unit and ok.dst = r.node)
  union all select w.unit, w.head, w.pos + 1, ok.dst from walk w join ok on ok.unit = w.unit and ok.src = w.node)
select * from walk""")
def chain_merge(f):
    nodes, edges = live_graph(f)
    inside = R.members(f.block, f.range)
    pairs = edges.select("unit", "src", "dst").distinct()
    handlers = handler_edges(f).select("unit", F.col("dst").alias("node")).distinct()
    return G.chains(nodes, edges, handlers, R.split_pairs(pairs, inside))


@query("dominator_pairs", "select unit, n, d from o_dom")
def dominator_pairs(f):
    return G.tree_pairs(live_dominators(f))


@query("immediate_dominators", """
with c as (select unit, n, count(*) as k from o_dom group by unit, n)
select o.unit, o.n as node, arg_max(o.d, c.k) as idom from o_dom o
join c on c.unit = o.unit and c.n = o.d where o.n <> o.d group by o.unit, o.n""")
def immediate_dominators(f):
    return G.nearest_dominators(live_dominators(f))


@query("post_dominators", """
with cl as (select unit, node as a, node as b from o_reach
  union select cl.unit, cl.a, e.dst from cl join o_live_edge e on e.unit = cl.unit and e.src = cl.b),
ends as (select r.unit, r.node from o_reach r where not exists
  (select 1 from cl where cl.unit = r.unit and cl.a = r.node and not exists
    (select 1 from cl k where k.unit = cl.unit and k.a = cl.b and k.b = cl.a))),
w as (select x.unit, m.node as m, x.node as n from ends x join o_reach m on m.unit = x.unit
    where not exists (select 1 from cl c1 join cl c2 on c2.unit = c1.unit and c2.a = c1.b and c2.b = c1.a
       where c1.unit = x.unit and c1.a = x.node and c1.b = m.node)
  union select w.unit, w.m, e.src from w join o_live_edge e on e.unit = w.unit and e.dst = w.n where e.src <> w.m)
select p.unit, p.n, p.d from o_pair p where not exists
  (select 1 from w where w.unit = p.unit and w.m = p.d and w.n = p.n)""")
def post_dominators(f):
    nodes, edges = live_graph(f)
    return G.post_dominators(nodes, edges)


@query("back_edges", "select unit, src, dst from o_back")
def back_edges(f):
    return G.back_edges(live_graph(f)[1], live_dominators(f))


LOOPS = """
body as (select unit, dst as head, src as node from o_back union select unit, dst, dst from o_back
  union select b.unit, b.head, e.src from body b join o_live_flow e on e.unit = b.unit and e.dst = b.node
  where b.node <> b.head)"""


@query("natural_loops", f"with {LOOPS} select unit, head, node from body")
def natural_loops(f):
    return G.natural_loops(live_flow(f), G.back_edges(live_graph(f)[1], live_dominators(f)))


@query("loop_depth", f"with {LOOPS} select unit, node, count(*) as depth from body group by unit, node")
def loop_depth(f):
    return G.loop_depth(G.natural_loops(live_flow(f), G.back_edges(live_graph(f)[1], live_dominators(f))))


@query("irreducible_units", "select unit from o_irreducible")
def irreducible_units(f):
    return G.irreducible_units(live_graph(f)[1], handler_edges(f))


CANDIDATE = """
sz as (select unit, block as node, count(*) as size from v_block group by unit, block),
pe as (select distinct unit, src, dst from o_live_edge),
pc as (select unit, dst as node, count(*) as p from pe group by unit, dst having count(*) > 1),
sc as (select unit, src as node, count(*) as s from pe group by unit, src),
cand as (select pc.unit, pc.node, coalesce(sc.s, 0) as succs, sz.size * (pc.p - 1) as cost from pc
  join sz on sz.unit = pc.unit and sz.node = pc.node left join sc on sc.unit = pc.unit and sc.node = pc.node),
pick as (select unit, node, succs, cast(cost as bigint) as cost from cand
  qualify row_number() over (partition by unit order by succs, cost, node) = 1)"""


@query("split_candidate", f"with {CANDIDATE} select * from pick")
def split_candidate(f):
    nodes, edges = live_graph(f)
    return G.split_candidate(nodes, edges, block_sizes(f))


@query("node_split_once", f"""
with {CANDIDATE},
bad as (select unit from o_irreducible),
ch as (select p.unit, p.node, (select max(r.node) + 1 from o_reach r where r.unit = p.unit) as copy,
    (select min(src) from pe where pe.unit = p.unit and pe.dst = p.node) as first
  from pick p join bad on bad.unit = p.unit),
into_ as (select pe.unit, pe.src, coalesce(ch.copy, pe.dst) as dst from pe
  left join ch on ch.unit = pe.unit and ch.node = pe.dst and ch.first = pe.src)
select unit, src, dst from into_
union select i.unit, ch.copy, i.dst from into_ i join ch on ch.unit = i.unit and ch.node = i.src""")
def node_split_once(f):
    nodes, edges = live_graph(f)
    plain = edges.select("unit", "src", "dst").distinct()
    bad = cut(G.irreducible_units(edges, handler_edges(f)))
    return G.split_once(nodes, plain, block_sizes(f), bad)[1]


@query("graph_text", """
with hb as (select distinct m.unit, m.from_idx, m.to_idx, m.handler_idx, m.block, h.block as handler
  from o_member_of m join v_block h on h.unit = m.unit and h.idx = m.handler_idx),
nr as (select *, dense_rank() over (partition by unit order by from_idx, to_idx, handler_idx) - 1 as i from hb)
select unit, 0 as part, 0 as a, 0 as b, 0 as c, concat('digraph u', cast(unit as string), ' {') as line from (select distinct unit from v_block) q
union all select unit, 1, node, -1, 0, concat(cast(node as string), ' [shape=box,label="Block ', cast(node as string), '"];') from v_node
union all select distinct unit, 1, src, dst, 0, concat(cast(src as string), ' -> ', cast(dst as string), ';') from v_edge
union all select distinct unit, 1, src, dst, 1, concat(cast(src as string), ' -> ', cast(dst as string), ' [style=dotted];') from o_exc_edge
union all select distinct unit, 2, i, -1, 0, concat('subgraph cluster_ex_', i, ' {') from nr
union all select distinct unit, 2, i, -1, 1, concat(chr(9), 'label="Exception range for Block ', handler, ' ";') from nr
union all select unit, 2, i, block, 0, concat(chr(9), block, ';') from nr
union all select distinct unit, 2, i, 4611686018427387904, 0, concat(chr(9), '}') from nr
union all select distinct unit, 3, 0, 0, 0, '}' from v_block""")
def graph_text(f):
    at = f.block.select("unit", F.col("idx").alias("handler_idx"), F.col("block").alias("handler"))
    held = R.members(f.block, f.range).join(at, ["unit", "handler_idx"])
    return G.dot_lines(f.node, f.edge, handler_edges(f), held)


@query("graph_audit", """
with bad_edge as (select unit, src, dst from v_edge where (src * 7 + dst) % 11 <> 0),
pred as (select unit, src, dst from v_edge where (src * 5 + dst) % 13 <> 0
  union select unit, src, dst + 100000 from v_edge where (src + dst) % 17 = 0),
r as (select distinct unit, cast(1 as bigint) as node from v_block
  union select e.unit, e.dst from r join bad_edge e on e.unit = r.unit and e.src = r.node),
ex as (select distinct unit, block as node, event_id % 50 as expr from v_block)
select unit, 'not seen from target' as rule, src as a, dst as b from (select * from bad_edge except select * from pred) q
union all select unit, 'not seen from source', src, dst from (select * from pred except select * from bad_edge) q
union all select unit, 'unreachable', node, node from v_node n where not exists
  (select 1 from r where r.unit = n.unit and r.node = n.node)
union all select unit, 'expression in two nodes', min(node), max(node) from ex group by unit, expr having min(node) <> max(node)""")
def graph_audit(f):
    succ = f.edge.select("unit", "src", "dst").filter("(src * 7 + dst) % 11 <> 0").distinct()
    pred = (
        f.edge.select("unit", "src", "dst").filter("(src * 5 + dst) % 13 <> 0")
        .unionByName(f.edge.filter("(src + dst) % 17 = 0").select("unit", "src", (F.col("dst") + 100000).alias("dst")))
        .distinct())
    expr = f.block.select("unit", F.col("block").alias("node"), (F.col("event_id") % 50).alias("expr"))
    return G.audit(f.node, succ, pred, expr)


@query("phi_groups", """
with u as (select unit, src as a, dst as b from v_edge union select unit, dst, src from v_edge),
c as (select unit, node, node as r from v_node union select c.unit, c.node, u.b from c join u on u.unit = c.unit and u.a = c.r)
select unit, node, min(r) as representative from c group by unit, node""")
def phi_groups(f):
    key = lambda c: F.struct(F.col("unit").alias("unit"), F.col(c).alias("node"))
    comp = iterate.components(
        f.edge.select(key("src").alias("a"), key("dst").alias("b")), "a", "b", f.node.select(key("node").alias("node")))
    return comp.select("node.unit", "node.node", F.col("component.node").alias("representative"))


@query("call_components", """
with n as (select src as node from v_call union select dst from v_call),
cl as (select src as a, dst as b from v_call union select cl.a, c.dst from cl join v_call c on c.src = cl.b)
select n.node, coalesce(least(n.node, min(cl.b)), n.node) as component from n
left join cl on cl.a = n.node and exists (select 1 from cl k where k.a = cl.b and k.b = n.node)
group by n.node""")
def call_components(f):
    nodes = f.call.select(F.col("src").alias("node")).unionByName(f.call.select(F.col("dst").alias("node"))).distinct()
    return iterate.strong_components(f.call, nodes)


@query("component_levels", """
with n as (select src as node from v_call union select dst from v_call),
cl as (select src as a, dst as b from v_call union select cl.a, c.dst from cl join v_call c on c.src = cl.b),
comp as (select n.node, coalesce(least(n.node, min(cl.b)), n.node) as component from n
  left join cl on cl.a = n.node and exists (select 1 from cl k where k.a = cl.b and k.b = n.node) group by n.node),
ce as (select distinct a.component as s, b.component as t from v_call c join comp a on a.node = c.src
  join comp b on b.node = c.dst where a.component <> b.component),
lv as (select distinct component as node, cast(0 as bigint) as level from comp
  union select ce.t, lv.level + 1 from lv join ce on ce.s = lv.node)
select node as component, max(level) as level from lv group by node""")
def component_levels(f):
    nodes = f.call.select(F.col("src").alias("node")).unionByName(f.call.select(F.col("dst").alias("node"))).distinct()
    comp = cut(iterate.strong_components(f.call, nodes))
    s = comp.select(F.col("node").alias("src"), F.col("component").alias("cs"))
    d = comp.select(F.col("node").alias("dst"), F.col("component").alias("cd"))
    folded = (
        f.call.join(s, "src").join(d, "dst").filter("cs <> cd")
        .select(F.col("cs").alias("src"), F.col("cd").alias("dst")).distinct())
    tops = comp.select(F.col("component").alias("node")).distinct()
    return iterate.levels(folded, tops).withColumnRenamed("node", "component")
