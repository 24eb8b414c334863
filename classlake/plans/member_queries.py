"""Type hierarchy, member resolution and override queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from classlake.functions import flags
from classlake.iterate import cut
from classlake.operators import hierarchy as H
from classlake.operators import members as M
from classlake.plans.registry import query


@query("subtype_closure", "select node, anc from o_up")
def subtype_closure(f):
    return H.closure(f.parent, f.hier.select("node"))


@query("subtype_test", """
with p as (select distinct caller as a, owner as b from v_ref union select distinct caller + 1000000, 1 from v_ref
  union select distinct owner, 1 from v_ref union select null, 1)
select p.a, p.b, coalesce(exists (select 1 from o_up u where u.node = p.a and u.anc = p.b)
  or (p.b = 1 and p.a is not null and not exists (select 1 from v_hier h where h.node = p.a and h.super is not null)), false) as is_sub
from p""")
def subtype_test(f):
    own = f.ref.select(F.col("caller").alias("a"), F.col("owner").alias("b"))
    root = F.lit(1).cast("long")
    pairs = (
        own.unionByName(f.ref.select((F.col("caller") + 1000000).alias("a"), root.alias("b")))
        .unionByName(f.ref.select(F.col("owner").alias("a"), root.alias("b")))
        .unionByName(f.hier.filter("node = 1").select(F.lit(None).cast("long").alias("a"), root.alias("b")))
        .distinct())
    return H.subtype_test(pairs, f.up, f.hier, 1)


@query("common_ancestor", """
with p as (select distinct caller as a, owner as b from v_ref)
select p.a, p.b, (select arg_min(x.anc, x.path) from o_dfs x join o_up y on y.anc = x.anc
  where x.node = p.a and y.node = p.b and (x.anc <> 1 or x.anc = p.a)) as common from p""")
def common_ancestor(f):
    pairs = f.ref.select(F.col("caller").alias("a"), F.col("owner").alias("b")).distinct()
    return H.common_ancestor(pairs, f.depth_first, 1)


@query("inheritance_levels", """
select node, max(len(path)) as level from (select node, path from o_paths p
  where not exists (select 1 from v_parent q where q.node = p.anc)) q group by node""")
def inheritance_levels(f):
    return H.inheritance_levels(f.parent, f.hier)


@query("nested_forest", """
with ok as (select node as inner_, super as encloser from v_hier where super is not null and node % 6 <> 0),
roots as (select node from v_hier h where not exists (select 1 from ok where ok.inner_ = h.node)),
w as (select node as root, node, cast(0 as bigint) as depth from roots
  union select w.root, ok.inner_, w.depth + 1 from w join ok on ok.encloser = w.node)
select * from w""")
def nested_forest(f):
    claims = f.hier.filter("super is not null").select(
        F.col("node").alias("inner"), F.col("super").alias("encloser"),
        F.when(F.col("node") % 6 != 0, F.col("super")).alias("recorded"))
    nested = claims.filter("encloser = recorded").select(F.col("inner").alias("node"))
    return H.nested_forest(claims, f.hier.select("node").join(nested, "node", "left_anti"))


@query("nested_classes", """
with cl as (
  select node as inner_, p.parent as encloser, super as recorded, p.pos as ord,
    case node % 3 when 0 then 'anonymous' when 1 then 'member' else 'local' end as kind, node * 37 % 8192 as flags,
    node % 5 <> 0 as shape, node % 7 = 0 as named, node % 2 = 0 as outer_named
  from v_hier join v_parent p using (node) where node % 6 <> 0),
roots as (select node, node * 37 % 8192 as flags from v_hier where node % 6 = 0 or super is null),
k1 as (select *, case when kind = 'anonymous' and not shape then 'local' else kind end as k from cl where encloser = recorded
  qualify row_number() over (partition by inner_ order by ord) = 1),
k2 as (select *, k = 'anonymous' and named as pr from k1),
k3 as (select inner_, encloser, flags, pr and outer_named as st, case when pr and outer_named then 'member' when pr then 'local' else k end as kind from k2),
k4 as (select inner_, encloser, kind, case when st then flags | 8 when kind = 'anonymous' then flags & ~8 when kind = 'local' then flags & 1040 else flags end as flags from k3),
w as (
  select node as root, node, null::bigint as parent, 0::bigint as depth, 'root' as kind, flags::bigint as flags, ((flags & 4098) | 8)::bigint as context from roots
  union all
  select w.root, k4.inner_, k4.encloser, w.depth + 1, k4.kind, k4.flags::bigint,
    ((case when k4.kind <> 'member' then w.context when k4.flags & 8 <> 0 then w.context | 8 else w.context & ~8 end) | (k4.flags & 4098))::bigint
  from w join k4 on k4.encloser = w.node)
select * from w""")
def nested_classes(f):
    n = F.col("node")
    flags = n * 37 % 8192
    claims = f.parent.join(f.hier.select("node", "super"), "node").filter("node % 6 <> 0").select(
        n.alias("inner"), F.col("parent").alias("encloser"), F.col("super").alias("recorded"), F.col("pos").alias("ord"),
        F.when(n % 3 == 0, "anonymous").when(n % 3 == 1, "member").otherwise("local").alias("kind"), flags.alias("flags"),
        (n % 5 != 0).alias("anonymous_shape"), (n % 7 == 0).alias("named"), (n % 2 == 0).alias("outer_named"))
    return H.nested_classes(claims, f.hier.filter("node % 6 = 0 or super is null").select("node", flags.alias("flags")))


@query("member_resolution", """
select r.owner, r.name, r.params, r.ret, o.found from (select distinct owner, name, params, ret from v_ref) r
left join o_found o on o.owner = r.owner and o.name = r.name and o.params = r.params and o.ret = r.ret""")
def member_resolution(f):
    start = f.ref.select(F.col("owner").alias("node")).distinct()
    return M.resolve(f.ref, H.ranked_closure(f.parent, start), f.member)


@query("renamed_member_lookup", """
with k as (select distinct owner, name, params from v_ref),
ren as (select owner as class, name, params, target from v_map where kind = 'method'),
hit as (select k.owner, k.name, k.params, min(b.rank) as r, arg_min(n.target, b.rank) as target from k
  join o_bfs b on b.node = k.owner join ren n on n.class = b.anc and n.name = k.name and n.params = k.params group by all),
stop as (select k.owner, k.name, k.params, min(b.rank) as r from k join o_bfs b on b.node = k.owner
  join v_member m on m.class = b.anc and m.name = k.name and m.params = k.params group by all)
select k.owner, k.name, k.params, case when s.r is null or h.r <= s.r then h.target end as target
from k left join hit h on h.owner = k.owner and h.name = k.name and h.params = k.params
left join stop s on s.owner = k.owner and s.name = k.name and s.params = k.params""")
def renamed_member_lookup(f):
    renames = f.map.filter("kind = 'method'").select("owner", "name", "params", "target")
    start = f.ref.select(F.col("owner").alias("node")).distinct()
    return M.resolve_rename(f.ref, H.ranked_closure(f.parent, start, breadth_first=True), f.member, renames)


@query("missing_targets", """
with asked as (select caller, owner, case when caller % 4 = 0 then 'm1' else name end as name, params, ret from v_ref)
select r.owner, r.name, r.params, r.ret, min(r.caller) as witness from asked r
join v_hier h on h.node = r.owner and h.is_own and not h.is_iface
where not exists (select 1 from o_up u join v_member m on m.class = u.anc
  where u.node = r.owner and m.name = r.name and m.params = r.params and m.ret = r.ret)
group by r.owner, r.name, r.params, r.ret""")
def missing_targets(f):
    asked = f.ref.withColumn("name", F.when(F.col("caller") % 4 == 0, "m1").otherwise(F.col("name")))
    return M.missing_targets(asked, f.depth_first, f.member, f.hier)


@query("missing_classes", """
select distinct node from (select owner as node from v_ref union select caller from v_ref union select parent from v_parent) q
where node % 10 = 3""")
def missing_classes(f):
    named = (
        f.ref.select(F.col("owner").alias("node")).unionByName(f.ref.select(F.col("caller").alias("node")))
        .unionByName(f.parent.select(F.col("parent").alias("node"))))
    return M.missing_classes(named, f.hier.filter("node % 10 <> 3"))


@query("override_pairs", "select * from o_override")
def override_pairs(f):
    return M.override_pairs(f.method, f.up, f.returns)


def own_classes(f):
    return f.hier.filter("is_own and not is_iface").select("node")


@query("inherited_implementations", "select * from o_inherited")
def inherited_implementations(f):
    return M.inherited_implementations(f.method, f.up, f.returns, own_classes(f))


def family_table(f):
    if not hasattr(f, "_family"):
        also = M.inherited_implementations(f.method, f.up, f.returns, own_classes(f), f.parent)
        f._family = cut(M.flowing_families(f.method, f.parent, f.levels, f.returns, also))
    return f._family


@query("override_families", "select class, name, params, ret, family from o_family")
def override_families(f):
    return family_table(f)


@query("override_hierarchy", """
select m.class, m.name, m.params, m.ret, s.class as sup, s.ret as sup_ret from v_method m
join o_up u on u.node = m.class and u.anc <> m.class
join v_method s on s.class = u.anc and s.name = m.name and s.params = m.params
join v_fits f on f.child = m.ret and f.parent = s.ret
where m.overridable and s.overridable and (s.visible or s.package = m.package)""")
def override_hierarchy(f):
    return M.override_hierarchy(f.method, f.up, f.returns)


@query("override_ancestry", """
with kn as (select node from v_hier where node % 9 <> 4),
pk as (
  select node, node as anc, []::bigint[] as path from kn
  union select o.node, p.parent, list_append(o.path, p.pos) from pk o join kn on kn.node = o.anc join v_parent p on p.node = o.anc),
dk as (select node, anc, min(path) as path from pk where node <> anc group by node, anc),
lost as (select node, anc, path from pk where anc not in (select node from kn)),
gap as (select kn.node, coalesce(max(case when list_sum(path) = 0 then 2 when lost.anc is not null then 1 end), 0) as gap
  from kn left join lost on lost.node = kn.node group by kn.node),
able as (select m.* from v_method m join kn on kn.node = m.class where m.overridable),
r as (
  select m.class, m.name, m.params, m.ret, s.class as sup, s.ret as sup_ret, dk.path, true as resolved
  from able m join dk on dk.node = m.class join able s on s.class = dk.anc and s.name = m.name and s.params = m.params
  join v_fits f on f.child = m.ret and f.parent = s.ret where s.visible or s.package = m.package
  union all
  select m.class, m.name, m.params, m.ret, dk.anc, null, dk.path, false from able m join dk on dk.node = m.class
  where dk.anc not in (select node from kn)),
q as (select *, row_number() over (partition by class, name, params, ret order by path, sup, sup_ret) as pos from r)
select m.class, m.name, m.params, m.ret, q.pos, q.sup, q.sup_ret, q.resolved, gap.gap::bigint as gap
from able m join gap on gap.node = m.class
left join q on q.class = m.class and q.name = m.name and q.params = m.params and q.ret = m.ret""")
def override_ancestry(f):
    return M.override_ancestry(f.method, f.parent, f.hier.filter("node % 9 <> 4").select("node"), f.returns)


OBLIGATION = """
ob as (select c.node, m.name, m.params, m.class as owner, m.ret, b.rank, m.ord, m.access_rank from v_concrete c
  join o_bfs b on b.node = c.node and b.anc <> c.node join v_method m on m.class = b.anc
  where m.overridable and m.abstract and (m.visible or m.in_iface or m.package = c.package)),
fit as (select distinct o.node, o.name, o.params, o.ret from ob o where not exists
  (select 1 from ob p where p.node = o.node and p.name = o.name and p.params = o.params
   and not exists (select 1 from v_fits f where f.child = o.ret and f.parent = p.ret))),
acc as (select node, name, params, max(access_rank) as access_rank from ob group by all),
req as (select o.node, o.name, o.params, o.owner, o.ret, acc.access_rank from ob o
  join fit on fit.node = o.node and fit.name = o.name and fit.params = o.params and fit.ret = o.ret
  join acc on acc.node = o.node and acc.name = o.name and acc.params = o.params
  qualify row_number() over (partition by o.node, o.name, o.params order by o.rank, o.ord, o.owner, o.ret) = 1)"""


def obligations(f):
    return M.abstract_obligations(f.concrete, None, f.method, f.parent, f.levels)


def required(f):
    return M.most_specific_return(cut(obligations(f)), f.returns)


@query("most_specific_return", f"with {OBLIGATION} select * from req")
def most_specific_return(f):
    return required(f)


@query("unmet_obligations", f"""
with {OBLIGATION},
chain as (select node, node as anc, cast(0 as bigint) as depth from v_concrete
  union select c.node, h.super, c.depth + 1 from chain c join v_hier h on h.node = c.anc where h.super is not null),
near as (select r.node, r.name, r.params, m.abstract from req r join chain c on c.node = r.node
  join v_method m on m.class = c.anc and m.name = r.name and m.params = r.params and m.overridable
    and m.access_rank >= r.access_rank
  join v_fits f on f.child = m.ret and f.parent = r.ret
  qualify row_number() over (partition by r.node, r.name, r.params order by c.depth, m.ord, m.ret) = 1),
off_ as (select r.node, r.name, r.params, m.class, m.ret, m.abstract from req r join o_up u on u.node = r.node and u.anc <> r.node
  join v_method m on m.class = u.anc and m.in_iface and m.overridable and m.name = r.name and m.params = r.params),
best as (select * from off_ a where not exists (select 1 from off_ b join o_up u on u.node = b.class and u.anc = a.class
  where b.node = a.node and b.name = a.name and b.params = a.params and b.class <> a.class)),
dflt as (select node, name, params from best group by all having count(*) = 1 and not bool_or(abstract))
select r.node, r.name, r.params, r.ret, r.access_rank from req r
left join near n on n.node = r.node and n.name = r.name and n.params = r.params
where coalesce(n.abstract, true) and not (n.abstract is null and exists
  (select 1 from dflt d where d.node = r.node and d.name = r.name and d.params = r.params))""")
def unmet_obligations(f):
    need = cut(required(f))
    chain = H.super_chain(f.parent, f.concrete)
    return M.unmet_obligations(need, chain, f.up, f.method, f.returns)


@query("package_relocation", """
with pk as (select node, case when node % 4 = 0 then '' else concat('p', cast(node % 4 as string)) end as package from v_hier where is_own),
uses as (select caller as node, owner as used from v_ref union select node, parent from v_parent),
ask as (select distinct p.package from uses u join pk p on p.node = u.node and p.package <> ''
  join pk q on q.node = u.used and q.package = '')
select node, (select case when count(*) = 1 then min(package) else 'relocated' end from ask having count(*) > 0) as target
from pk where package = '' and exists (select 1 from ask)""")
def package_relocation(f):
    package = F.when(F.col("node") % 4 == 0, "").otherwise(
        F.concat(F.lit("p"), (F.col("node") % 4).cast("string")))
    classes = f.hier.filter("is_own").select("node", package.alias("package"))
    uses = f.ref.select(F.col("caller").alias("node"), F.col("owner").alias("used")).unionByName(
        f.parent.select("node", F.col("parent").alias("used")))
    return M.relocations(classes, uses, "relocated")


@query("inner_class_claims", """
with c as (select owner as inner_, caller as claimant, cast(floor(owner / 2) as bigint) as encloser, caller as ord, concat(name, params) as info from v_ref
  union all select class, class, cast(floor(class / 2) as bigint), ord, concat(name, params) from v_member where class % 3 = 0)
select inner_ as "inner", arg_min(claimant, k) as claimant, arg_min(info, k) as info, min(info) <> max(info) as inconsistent
from (select *, (case when claimant = inner_ then 0 when claimant = encloser then 1 else 2 end, ord, claimant, info) as k from c) q
group by inner_""")
def inner_class_claims(f):
    half = lambda c: F.floor(F.col(c) / 2).cast("long").alias("encloser")
    claims = f.ref.select(
        F.col("owner").alias("inner"), F.col("caller").alias("claimant"), half("owner"),
        F.col("caller").alias("ord"), F.concat("name", "params").alias("info"))
    own = f.member.filter("class % 3 = 0").select(
        F.col("class").alias("inner"), F.col("class").alias("claimant"), half("class"), "ord",
        F.concat("name", "params").alias("info"))
    return M.inner_claims(claims.unionByName(own))


@query("member_docs", """
select m.class, m.name, m.params, m.ret, p.target as doc from v_member m left join v_map p
on p.kind = 'method' and p.owner = m.class and p.name = m.name and p.params = m.params""")
def member_docs(f):
    docs = f.map.filter("kind = 'method'").select(
        F.col("owner").alias("class"), "name", "params", F.col("target").alias("doc"))
    return M.attach_docs(f.member.select(*M.KEY), docs, ["class", "name", "params"])


@query("switch_decoding", """
with lab as (select unit, idx, event_id % 6 - 1 as label from v_seq where op = 'load'),
tab as (select unit, event_id % 40 as key, min(concat('C', cast(slot as string))) as constant from v_seq where op in ('store', 'call') group by all),
dec as (select l.*, case when label = -1 then 'null' else
  (select arg_min(t.constant, t.key) from tab t where t.unit = l.unit and t.key >= l.label) end as constant from lab l)
select unit, idx, label, constant from dec d where not exists
  (select 1 from dec e where e.unit = d.unit and e.constant is null)""")
def switch_decoding(f):
    labels = f.seq.filter("op = 'load'").select("unit", "idx", (F.col("event_id") % 6 - 1).alias("label"))
    table = f.seq.filter("op in ('store', 'call')").select(
        "unit", (F.col("event_id") % 40).alias("key"), F.concat(F.lit("C"), F.col("slot").cast("string")).alias("constant"))
    return M.decode_switch(labels, table)


@query("platform_lookup", """
with api as (select m.*, concat('X', cast(m.ord % 3 as string)) as declared from v_member m join v_hier h on h.node = m.class and not h.is_own)
select r.owner, r.name, r.params, r.ret,
  case when h.node is null then 'UNKNOWN' when a.class is not null then 'RESOLVED' else 'ABSENT' end as state, a.declared
from (select distinct owner, name, params, ret from v_ref) r
left join v_hier h on h.node = r.owner and not h.is_own
left join api a on a.class = r.owner and a.name = r.name and a.params = r.params and a.ret = r.ret""")
def platform_lookup(f):
    classes = f.hier.filter("not is_own").select("node")
    api = f.member.join(classes.withColumnRenamed("node", "class"), "class", "left_semi").select(
        *M.KEY, F.concat(F.lit("X"), (F.col("ord") % 3).cast("string")).alias("declared"))
    return M.platform_lookup(f.ref, classes, api, f.hier.filter("node = 5 and is_own and false"))


@query("library_lookup", """
select h.node, h.super from v_hier h where not h.is_own and h.node in (select owner from v_ref)""")
def library_lookup(f):
    used = f.ref.select(F.col("owner").alias("node")).distinct()
    return f.hier.filter("not is_own").join(used, "node", "left_semi").select("node", "super")


# ---------------------------------------------------------------- predicates over members


@query("flag_test", """
select class, name, params, ret, (access & 1) <> 0 as low_bit, (access & 2) <> 0 as high_bit from v_member""")
def flag_test(f):
    return f.member.select(*M.KEY, flags.has_flag(F.col("access"), 1).alias("low_bit"),
                           flags.has_flag(F.col("access"), 2).alias("high_bit"))


@query("hidden_members", """
select class, name, params, ret from v_member m where (access & 1) = 0 or exists
  (select 1 from v_ref r where r.owner = m.class and r.name = m.name and r.params = m.params and r.ret = m.ret)""")
def hidden_members(f):
    used = f.ref.select(F.col("owner").alias("class"), "name", "params", "ret").distinct()
    synthetic = flags.has_flag(F.col("access"), 1)
    needed = f.member.filter(synthetic).join(used, M.KEY, "left_semi")
    return f.member.filter(~synthetic).unionByName(needed).select(*M.KEY)


@query("overridable_members", """
select class, name, params, ret from v_member where access <> 1 and ord % 13 <> 5""")
def overridable_members(f):
    return f.member.filter(
        flags.overridable(F.col("name"), F.col("access") == 1, F.col("ord") % 13 == 5)).select(*M.KEY)


@query("visible_members", """
select h.node, m.class, m.name, m.params, m.ret from v_hier h join v_member m on m.class = h.super
where m.access <> 1 and (m.access in (2, 3) or m.class % 4 = h.node % 4)""")
def visible_members(f):
    a = F.col("access")
    pairs = f.hier.filter("super is not null").select("node", F.col("super").alias("class")).join(f.member, "class")
    return pairs.filter(flags.visible_to_subclass(
        a == 3, a == 2, a == 1, F.col("class") % 4, F.col("node") % 4)).select("node", *M.KEY)


@query("access_ranks", """
select class, name, params, ret, case when access = 3 then 3 when access = 2 then 2 else 1 end as rank,
  case when access = 3 then 1 when access = 2 then 4 else 0 end as flag from v_member""")
def access_ranks(f):
    a = F.col("access")
    rank = flags.access_rank(a == 3, a == 2, F.lit(False))
    return f.member.select(*M.KEY, rank.alias("rank"), flags.rank_flag(rank).alias("flag"))


@query("strongest_access", f"with {OBLIGATION} select node, name, params, access_rank from acc")
def strongest_access(f):
    return obligations(f).groupBy("node", "name", "params").agg(F.max("access_rank").alias("access_rank"))


@query("methods_in_key_order", "select class, name, params, ret from v_member order by class, name, params, ret")
def methods_in_key_order(f):
    return f.member.select(*M.KEY).orderBy(*M.KEY)
