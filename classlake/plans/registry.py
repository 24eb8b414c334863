"""Query registry and the SQL text of the fact tables for the oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from classlake.plans.facts import Facts, facts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VIEW_SQL: dict[str, str] = {
    "v_seq": """
select user_id as unit, row_number() over (partition by user_id order by ts, event_id) - 1 as idx,
  count(*) over (partition by user_id) as n, event_id,
  case when event_type = 'error' and event_id % 3 = 0 then 'goto' when event_type = 'error' then 'jump'
       when event_type = 'purchase' and event_id % 5 = 0 then 'return' when event_type = 'purchase' then 'call'
       when event_type = 'signup' then 'store' when event_type = 'click' then 'load' when event_id % 7 = 0 then 'switch' else 'general' end as op,
  event_id % 4 as slot
from events""",
    "v_jump": """
select unit, idx, 0 as ord, event_id % n as dest from v_seq where op in ('jump', 'goto')
union all select unit, idx, 0, (event_id * 3 + 1) % n from v_seq where op = 'switch'
union all select unit, idx, 1, event_id % n from v_seq where op = 'switch'
union all select unit, idx, 2, (event_id * 5 + 2) % n from v_seq where op = 'switch'""",
    "v_range": """
select unit, idx as from_idx, least(idx + 5, n) as to_idx, (idx * 3 + 7) % n as handler_idx,
  concat('E', cast(event_id % 3 as string)) as exc_type
from v_seq where op = 'store' and event_id % 5 = 0
union all
select unit, idx, least(idx + 5, n), (idx * 3 + 7) % n, concat('E', cast(3 + event_id % 2 as string))
from v_seq where op = 'store' and event_id % 10 = 0""",
    "v_block": """
select unit, idx, n, event_id, op, slot,
  cast(sum(f) over (partition by unit order by idx rows between unbounded preceding and current row) as bigint) as block
from (
  select s.*, case when s.idx = 0
      or lag(s.op) over (partition by s.unit order by s.idx) in ('jump', 'goto', 'return', 'switch')
      or j.dest is not null or b.b is not null then 1 else 0 end as f
  from v_seq s
  left join (select distinct unit, dest from v_jump) j on s.unit = j.unit and s.idx = j.dest
  left join (select unit, from_idx as b from v_range union select unit, to_idx from v_range
             union select unit, handler_idx from v_range) b on s.unit = b.unit and s.idx = b.b) q""",
    "v_last": """
select unit, block, max(idx) as idx, arg_max(op, idx) as op from v_block group by unit, block""",
    "v_edge": """
select l.unit, l.block as src, t.block as dst, j.ord as ord from v_last l
  join v_jump j on l.unit = j.unit and l.idx = j.idx join v_block t on t.unit = j.unit and t.idx = j.dest
union
select l.unit, l.block, t.block, 1 from v_last l join v_block t on t.unit = l.unit and t.idx = l.idx + 1
where l.op not in ('return', 'goto', 'switch')""",
    "v_node": "select distinct unit, block as node from v_block",
    "v_hier": """
select p_partkey as node, cast(floor(p_partkey / 2) as bigint) as super,
  case when p_partkey % 3 = 0 and p_partkey > 3 then cast(floor(p_partkey / 3) as bigint) end as iface,
  p_partkey % 5 <> 0 as is_own, p_partkey % 7 = 0 as is_iface
from part where p_partkey > 1
union all select p_partkey, null, null, true, false from part where p_partkey <= 1""",
    "v_parent": """
select node, super as parent, 0 as pos from v_hier where super is not null
union all select node, iface, 1 from v_hier where iface is not null""",
    "v_member": """
select l_partkey as class, concat('m', cast(l_linenumber as string)) as name,
  concat('(', l_returnflag, ')') as params, l_linestatus as ret,
  min(l_suppkey % 4) as access, min(l_orderkey) as ord
from lineitem
group by l_partkey, l_linenumber, l_returnflag, l_linestatus""",
    "v_method": """
select m.class, m.name, m.params, m.ret, m.ord, h.is_iface as in_iface,
  m.access <> 1 and m.ord % 13 <> 5 as overridable, m.ord % 7 = 1 as final,
  m.ord % 7 <> 1 and m.ord % 3 = 0 as abstract, m.access = 3 as public, m.access in (2, 3) as visible,
  m.class % 4 as package, case when m.access = 3 or h.is_iface then 3 when m.access = 2 then 2 else 1 end as access_rank
from v_member m join v_hier h on h.node = m.class""",
    "v_returns": "select 'F' as child, 'O' as parent",
    "v_fits": """
select a.r as child, b.r as parent from (values ('F'), ('O')) a(r), (values ('F'), ('O')) b(r)
where a.r = b.r or (a.r = 'F' and b.r = 'O')""",
    "v_concrete": """
select node, node % 4 as package from v_hier where is_own and not is_iface and node % 11 <> 0""",
    "v_ref": """
select distinct caller, owner, name, params, ret from (
  select l_partkey as caller,
    lead(l_partkey) over w as owner, concat('m', cast(lead(l_linenumber) over w as string)) as name,
    concat('(', lead(l_returnflag) over w, ')') as params, lead(l_linestatus) over w as ret
  from lineitem
  window w as (partition by l_orderkey
    order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) q
where owner is not null and owner <> caller""",
    "v_call": "select distinct caller as src, owner as dst from v_ref",
    "v_exc": """
select distinct src, dst, case when (src * dst) % 4 = 0 then concat('X', cast((src + dst) % 6 as string)) end as caught
from v_call""",
    "v_raise": """
select p_partkey as node, concat('X', cast(p_partkey % 6 as string)) as exc from part where p_partkey % 3 = 0""",
    "v_exc_type": """
select concat('X', cast(p_partkey as string)) as exc,
  case when p_partkey > 0 then concat('X', cast(cast(floor(p_partkey / 2) as bigint) as string)) end as super
from part where p_partkey < 6""",
    "v_map": """
select 'class' as kind, p_partkey as owner, null::varchar as name, null::varchar as params,
  concat(p_brand, '_', cast(p_partkey as string)) as target
from part where p_partkey % 4 = 0
union all
select 'method', class, name, params, concat('r_', name, '_', cast(min(ord) as string)) from v_member where class % 4 = 1
group by class, name, params""",
    "v_path": """
select page_id as ord, url as path, page_id % 2 = 0 as is_own,
  regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') as base_path from pages""",
    "v_art": "select md5(text) as k, source as unit, doc_id % 2 = 0 as is_own, doc_id as ord from documents",
    "v_name": """
select p_partkey as ord, p_brand as scope, p_name as raw, replace(p_name, ' ', '_') as base,
  split_part(p_name, ' ', 1) as word from part""",
    "v_turn": "select conv_id as file, turn as line, role, text from conversations",
    "v_tok": """
select class, text, cast(unnest(list_transform(range(1, len(p)), lambda k:
  list_sum(list_transform(p[1:k], lambda s: length(s))) + k - 1)) as bigint) as start
from (select doc_id as class, text, string_split(text, '.') as p from documents) q""",
    # closures and graph answers several oracles share
    "o_up": """
select node, node as anc from v_hier union select o_up.node, p.parent from o_up join v_parent p on p.node = o_up.anc""",
    "o_paths": """
select node, node as anc, []::bigint[] as path from v_hier
union select o.node, p.parent, list_append(o.path, p.pos) from o_paths o join v_parent p on p.node = o.anc""",
    "o_dfs": "select node, anc, min(path) as path from o_paths group by node, anc",
    "o_bfs": """
select node, anc, min((len(path), path)) as rank, min(len(path)) as depth from o_paths group by node, anc""",
    "o_override": """
select m.class, m.name, m.params, m.ret, s.class as sup, s.ret as sup_ret from v_method m
join o_up u on u.node = m.class and u.anc <> m.class
join v_method s on s.class = u.anc and s.name = m.name and s.params = m.params
join v_fits f on f.child = m.ret and f.parent = s.ret
where m.overridable and s.overridable and not s.final""",
    "o_inherited": """
select distinct m.class, m.name, m.params, m.ret, s.class as sup, s.ret as sup_ret
from v_hier c join o_up u on u.node = c.node join o_up v on v.node = c.node
join v_method m on m.class = u.anc and not m.in_iface and m.overridable
join v_method s on s.class = v.anc and s.in_iface and s.overridable and s.name = m.name and s.params = m.params
where c.is_own and not c.is_iface
  and not exists (select 1 from o_up x where x.node = m.class and x.anc = s.class)
  and not exists (select 1 from o_up x where x.node = s.class and x.anc = m.class)
  and ((m.public and (m.ret, s.ret) in (select (child, parent) from v_fits))
    or (not m.final and ((m.ret, s.ret) in (select (child, parent) from v_fits) or (s.ret, m.ret) in (select (child, parent) from v_fits))))""",
    "o_link": """
select concat_ws(' ', class, name, params, ret) as a, concat_ws(' ', sup, name, params, sup_ret) as b from o_override
union select concat_ws(' ', class, name, params, ret), concat_ws(' ', sup, name, params, sup_ret) from o_inherited""",
    "o_both": "select a, b from o_link union select b, a from o_link",
    # the least member that each one is linked with: labels fall along links until none does
    "o_linked": """
select distinct a as k, a as r from o_both
union select b.b, min(l.r) from o_linked l join o_both b on b.a = l.k join recurring.o_linked c on c.k = b.b
where l.r < c.r group by b.b""",
    "o_family": """
select m.class, m.name, m.params, m.ret, coalesce(q.r, concat_ws(' ', m.class, m.name, m.params, m.ret)) as family
from v_method m left join o_linked q
  on q.k = concat_ws(' ', m.class, m.name, m.params, m.ret) where m.overridable""",
    "o_found": """
select r.owner, r.name, r.params, r.ret, arg_min(m.class, d.path) as found
from (select distinct owner, name, params, ret from v_ref) r join o_dfs d on d.node = r.owner
join v_member m on m.class = d.anc and m.name = r.name and m.params = r.params and m.ret = r.ret
group by r.owner, r.name, r.params, r.ret""",
    # regular and exception successors, as the search for dead blocks and the dominators follow them
    "o_flow": "select unit, src, dst from v_edge union select unit, src, dst from o_exc_edge",
    "o_reach": """
select distinct unit, cast(1 as bigint) as node from v_block
union select e.unit, e.dst from o_reach r join o_flow e on e.unit = r.unit and e.src = r.node""",
    "o_pair": "select r.unit, r.node as n, q.node as d from o_reach r join o_reach q on r.unit = q.unit",
    "o_avoid": """
select unit, node as d, cast(1 as bigint) as n from o_reach where node <> 1
union select w.unit, w.d, e.dst from o_avoid w join o_flow e on e.unit = w.unit and e.src = w.n where e.dst <> w.d""",
    "o_dom": """
select p.unit, p.n, p.d from o_pair p where not exists
  (select 1 from o_avoid w where w.unit = p.unit and w.d = p.d and w.n = p.n)""",
    "o_back": """
select distinct e.unit, e.src, e.dst from v_edge e join o_dom on o_dom.unit = e.unit and o_dom.n = e.src and o_dom.d = e.dst""",
    "o_exc_edge": """
select distinct m.unit, m.block as src, h.block as dst, r.exc_type
from o_member_of m join v_block h on h.unit = m.unit and h.idx = m.handler_idx
join v_range r on r.unit = m.unit and r.from_idx = m.from_idx and r.to_idx = m.to_idx and r.handler_idx = m.handler_idx""",
    "o_live_edge": """
select e.* from v_edge e join o_reach r on r.unit = e.unit and r.node = e.src""",
    "o_live_flow": "select e.* from o_flow e join o_reach r on r.unit = e.unit and r.node = e.src",
    "o_goto": """
select l.unit, l.block as node, min(e.dst) as target from v_last l join v_edge e on e.unit = l.unit and e.src = l.block
where l.op = 'goto' group by l.unit, l.block having count(*) = 1""",
    "o_removable": """
select unit, block as node from v_block b group by unit, block having count(*) = 1 and max(op) = 'goto'
and not exists (select 1 from o_exc_edge x where x.unit = b.unit and x.dst = b.block)""",
    # a unit with exception edges counts as reducible; another is reducible iff, from some root that reaches
    # everything, no cycle is left without back edges
    "o_live_up": """
select unit, node as a, node as b from o_reach where unit not in (select unit from o_exc_edge)
union select c.unit, c.a, e.dst from o_live_up c join o_live_edge e on e.unit = c.unit and e.src = c.b""",
    "o_root": "select distinct unit, a as r from o_live_up where b = 1",
    "o_root_avoid": """
select t.unit, t.r, n.node as d, t.r as n from o_root t join o_reach n on n.unit = t.unit and n.node <> t.r
union select w.unit, w.r, w.d, e.dst from o_root_avoid w join o_live_edge e on e.unit = w.unit and e.src = w.n where e.dst <> w.d""",
    "o_forward": """
select distinct t.unit, t.r, e.src, e.dst from o_root t join o_live_edge e on e.unit = t.unit
where e.src <> e.dst and e.dst <> t.r and exists
  (select 1 from o_root_avoid w where w.unit = t.unit and w.r = t.r and w.d = e.dst and w.n = e.src)""",
    "o_forward_up": """
select unit, r, src as a, dst as b from o_forward
union select c.unit, c.r, c.a, f.dst from o_forward_up c join o_forward f on f.unit = c.unit and f.r = c.r and f.src = c.b""",
    "o_irreducible": """
select t.unit from o_root t left join (select distinct unit, r from o_forward_up where a = b) c on c.unit = t.unit and c.r = t.r
group by t.unit having count(*) = count(c.r)""",
    "o_types": """
select unit, from_idx, to_idx, handler_idx, string_agg(distinct exc_type, ',' order by exc_type) as types
from v_range group by all""",
    "o_logical": """
select m.unit, m.handler_idx, t.types, m.from_idx, m.to_idx, m.block from o_member_of m
join o_types t on t.unit = m.unit and t.from_idx = m.from_idx and t.to_idx = m.to_idx and t.handler_idx = m.handler_idx""",
    "o_entry": """
select unit, handler_idx, types, block from o_logical l where block = 1
union
select l.unit, l.handler_idx, l.types, l.block from o_logical l join v_edge e on e.unit = l.unit and e.dst = l.block
where not exists (select 1 from o_logical k where k.unit = l.unit and k.handler_idx = l.handler_idx
  and k.types = l.types and k.block = e.src)""",
    "o_exc_up": """
select exc, exc as anc from v_exc_type
union select u.exc, t.super from o_exc_up u join v_exc_type t on t.exc = u.anc where t.super is not null""",
    "o_member_of": """
select distinct r.unit, r.from_idx, r.to_idx, r.handler_idx, b.block
from (select distinct unit, from_idx, to_idx, handler_idx from v_range) r
join v_block b on b.unit = r.unit and b.idx >= r.from_idx and b.idx < r.to_idx""",
}


#: Views that keep one row for each key while they recur.
KEYED = {"o_linked": "(k, r) using key (k)"}


def with_views(body: str) -> str:
    """Prefix ``body`` with the CTEs it names, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in VIEW_SQL:
            if name not in order and re.search(rf"\b{name}\b", text):
                if re.search(rf"\b{name}\b", VIEW_SQL[name]):
                    rest = re.sub(rf"\b{name}\b", "", VIEW_SQL[name])
                    visit(rest)
                else:
                    visit(VIEW_SQL[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    ctes = ",\n".join(f"{n}{KEYED.get(n, '')} as ({VIEW_SQL[n].strip()})" for n in order)
    own = body.strip()
    if own.lower().startswith("with "):
        own_body = own[len("with "):]
        if own_body.lower().startswith("recursive "):
            own_body = own_body[len("recursive "):]
        return f"WITH RECURSIVE {ctes},\n{own_body}"
    return f"WITH RECURSIVE {ctes}\n{own}"


def query(name: str, oracle: str | None = None):
    """Register ``fn(facts) -> DataFrame`` under ``name`` with its SQL twin."""

    def register(fn: Callable[[Facts], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(facts(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return register
