import itertools

from conftest import rows
from pyspark.sql import functions as F

from classlake.operators import dataflow as D
from classlake.operators import effects as E
from classlake.operators import hierarchy as H
from classlake.operators import lines as L
from classlake.operators import regions as R


def test_lattice_of_integers(spark):
    t = {(a, b): (up, j, m) for a, b, up, j, m in rows(D.pairwise(D.lattice(spark)), "a", "b", "a_above_b", "join", "meet")}
    assert t[("int", "byte")][1] == "int" and t[("byte", "char")][1] == "int" and t[("shortchar", "byte")][1] == "short"
    assert t[("char", "short")][2] == "shortchar" and t[("byte", "char")][2] == "bytechar"
    assert t[("object", "null")] == (True, "object", "null") and ("int", "float") not in t


def test_join_of_arrays_and_classes(spark):
    ranked = H.ranked_closure(
        spark.createDataFrame([("String", "java/lang/Object", 0), ("Integer", "Number", 0), ("Long", "Number", 0), ("Number", "java/lang/Object", 0)],
                              "node string, parent string, pos int"),
        spark.createDataFrame([(x,) for x in ("String", "Integer", "Long", "java/lang/Object")], "node string"))
    o = "java/lang/Object"
    cases = [("int", 0, "byte", 0, "int", 0), ("byte", 1, "int", 1, o, 0), ("byte", 1, o, 1, o, 0), ("String", 1, o, 1, o, 1),
             ("byte", 2, "int", 2, o, 1), ("Integer", 0, "Long", 0, "Number", 0), ("Integer", 1, "Long", 1, "Number", 1),
             ("null", 0, "String", 0, "String", 0), ("null", 0, "int", 1, "int", 1), ("int", 0, "String", 0, None, None),
             ("String", 0, "int", 1, o, 0), ("int", 1, "java/lang/Cloneable", 0, "java/lang/Cloneable", 0), ("String", 2, "byte", 1, o, 0)]
    df = spark.createDataFrame([c[:4] for c in cases], "a string, a_dims int, b string, b_dims int")
    got = {r[:4]: r[4:] for r in rows(D.join_types(df, D.lattice(spark), ranked), "a", "a_dims", "b", "b_dims", "join", "join_dims")}
    assert got == {c[:4]: c[4:] for c in cases}


def test_type_bounds_rise_to_the_higher_family(spark):
    start = spark.createDataFrame([("u", 1, "byte"), ("u", 2, "char"), ("u", 3, "boolean"), ("u", 5, "float")], "unit string, node long, type string")
    flows = spark.createDataFrame([("u", 1, 4), ("u", 2, 4), ("u", 3, 4), ("u", 4, 6), ("u", 5, 6), ("u", 6, 4)], "unit string, src long, dst long")
    low = dict(rows(D.type_bounds(start, flows, D.lattice(spark)), "node", "type"))
    assert low == {1: "byte", 2: "char", 3: "boolean", 5: "float", 6: "float", 4: "float"}
    high = dict(rows(D.type_bounds(start, flows, D.lattice(spark), upper=True), "node", "type"))
    assert high[4] == "boolean" and high[6] == "boolean"


def test_handlers_see_the_state_before_a_block(spark):
    blocks = spark.createDataFrame([("u", 1, 0, "store", 0), ("u", 2, 1, "store", 0), ("u", 3, 2, "load", 0)],
                                   "unit string, block long, idx long, op string, slot long")
    edges = spark.createDataFrame([("u", 1, 2)], "unit string, src long, dst long")
    exc = spark.createDataFrame([("u", 2, 3)], "unit string, src long, dst long")
    assert rows(D.reaching_definitions(blocks, edges, exc), "block", "slot", "def") == [(2, 0, 0), (3, 0, 0)]
    assert rows(D.live_slots(blocks, edges, exc), "block", "slot") == [(2, 0), (3, 0)]


TREE = [("Throwable", None), ("Exception", "Throwable"), ("Error", "Throwable"), ("RuntimeException", "Exception"), ("IO", "Exception"),
        ("File", "IO"), ("Sql", "Exception")]


def closed(spark):
    p = spark.createDataFrame([(a, b, 0) for a, b in TREE if b], "node string, parent string, pos int")
    return H.closure(p, spark.createDataFrame([(a,) for a, _ in TREE], "node string"))


def test_checked_types_and_name_fallback(spark):
    df = spark.createDataFrame([(x,) for x in ("IO", "RuntimeException", "Error", "x/FooException", "x/FooError", "x/BarRuntimeException", "x/Foo")], "exc string")
    got = dict(rows(E.is_checked(df, closed(spark), ["Throwable"], ["RuntimeException", "Error"]), "exc", "checked"))
    assert [k for k, v in sorted(got.items()) if v] == ["IO", "x/FooException"]


def test_redundant_order_and_shadowing(spark):
    c = closed(spark)
    df = spark.createDataFrame([(1, "Exception", 0), (1, "File", 1), (1, "IO", 2), (1, "Error", 3)], "node long, exc string, ord long")
    assert rows(E.drop_redundant(df.select("node", "exc"), c), "exc") == [("Error",), ("Exception",)]
    assert rows(E.specific_first(df, c), "place", "exc") == [(0, "File"), (1, "IO"), (2, "Exception"), (3, "Error")]
    assert rows(E.shadowed(df.withColumnRenamed("node", "site"), c), "exc") == [("File",), ("IO",)]


def test_exceptions_through_mutual_recursion(spark):
    calls = spark.createDataFrame([("s1", "a", "b"), ("s2", "b", "a"), ("s3", "b", "c"), ("s4", "top", "a"), ("s5", "quiet", "a")], "site string, src string, dst string")
    raised = spark.createDataFrame([("a", "IO"), ("c", "Sql"), ("c", "File")], "node string, exc string")
    catches = spark.createDataFrame([("s4", "IO"), ("s5", "Throwable"), ("s1", None)], "site string, exc string")
    got = rows(E.propagate(raised, calls, catches, closed(spark)), "node", "exc")
    assert got == [("a", "File"), ("a", "IO"), ("a", "Sql"), ("b", "File"), ("b", "IO"), ("b", "Sql"), ("c", "File"), ("c", "Sql"), ("top", "Sql")]


def test_declared_and_limited_throws(spark):
    calls = spark.createDataFrame([("s1", "m", "c"), ("s2", "n", "m"), ("s3", "init", "c")], "site string, src string, dst string")
    raised = spark.createDataFrame([("c", "Sql"), ("c", "File")], "node string, exc string")
    none = spark.createDataFrame([("x", None)], "site string, exc string")
    declared = spark.createDataFrame([("m", "IO")], "node string, exc string")
    limits = spark.createDataFrame([("n", 0, "Exception"), ("n", 1, "IO"), ("n", 1, "Error")], "node string, decl long, exc string")
    got = rows(E.propagate(raised, calls, none, closed(spark), declared, limits, spark.createDataFrame([("init",)], "node string")), "node", "exc")
    # m declares IO, so File is covered and Sql is inferred; n may only pass on what both declarations allow
    assert got == [("c", "File"), ("c", "Sql"), ("m", "Sql"), ("n", "IO")]


def test_unknown_flag_and_protected_flow(spark):
    calls = spark.createDataFrame([("s1", "a", "gone"), ("s2", "b", "gone"), ("s3", "c", "known")], "site string, src string, dst string")
    known = spark.createDataFrame([("known",)], "node string")
    catches = spark.createDataFrame([("s2", "Exception")], "site string, exc string")
    assert rows(E.unknown_flags(calls, known, catches, ["Exception", "Throwable"]), "node") == [("a",)]
    parts = spark.createDataFrame(
        [("t", "body", "IO", "typed"), ("t", "final", "Sql", "finally"), ("u", "body", "IO", "typed"), ("u", "handler", "Sql", "all")],
        "site string, part string, exc string, kind string")
    assert rows(E.protected_flow(parts), "site", "exc") == [("t", "IO"), ("t", "Sql"), ("u", "Sql")]


def test_line_lookup_and_mapping(spark):
    # the offset table of one method: 0 -> 4, 25 -> 5, 26 -> 5, 33 -> 7 (hex offsets)
    table = spark.createDataFrame([("m", 0x0, 4, 0), ("m", 0x25, 5, 1), ("m", 0x26, 5, 2), ("m", 0x33, 7, 3)], "unit string, start_pc long, line long, ord long")
    pcs = spark.createDataFrame([("m", x) for x in (-1, 0, 0x24, 0x25, 0x32, 0x99)], "unit string, pc long")
    assert rows(L.line_of(pcs, table), "pc", "line") == [(-1, -1), (0, 4), (0x24, 4), (0x25, 5), (0x32, 5), (0x99, 7)]
    mapped = L.offset_map(spark.createDataFrame([("m", 0, 40, 1), ("m", 0, 41, 0), ("m", 0x27, 50, 2), ("m", 0x28, 51, 3)], "unit string, offset long, new_line long, ord long"))
    original = L.original_lines(table, mapped)
    assert rows(original, "line", "new_line") == [(4, 41), (5, 50)]
    assert rows(L.unmapped_lines(table, original), "line") == [(7,)]
    assert rows(L.line_comments(original.withColumn("new_line", F.lit(1))), "comment") == [("// 4 5",)]


def test_unsorted_line_table_is_searched_from_its_end(spark):
    table = spark.createDataFrame([("m", 10, 1, 0), ("m", 0, 2, 1), ("m", 20, 3, 2)], "unit string, start_pc long, line long, ord long")
    pcs = spark.createDataFrame([("m", 5), ("m", 15), ("m", 25)], "unit string, pc long")
    assert rows(L.line_of(pcs, table), "pc", "line") == [(5, 2), (15, 2), (25, 3)]


def test_frames_do_not_fall_back(spark):
    frames = spark.createDataFrame([("m", 0, 1, "A"), ("m", 8, 2, "B")], "unit string, offset long, slot long, type string")
    uses = spark.createDataFrame([("m", 4, 1), ("m", 9, 1), ("m", 9, 2)], "unit string, pc long, slot long")
    assert rows(L.slot_type(uses, frames), "pc", "slot", "type") == [(4, 1, "A"), (9, 1, None), (9, 2, "B")]


def test_text_positions(spark):
    text = "ab\n\ncd\nx"
    df = spark.createDataFrame([(text, i) for i in range(len(text))] + [("\n\nq", 2)], "t string, i long")
    got = {(t, i): p for t, i, p in rows(df.select("t", "i", L.text_position(F.col("t"), F.col("i")).alias("p")), "t", "i", "p")}
    want = {}
    for t, i in [(text, i) for i in range(len(text))] + [("\n\nq", 2)]:
        before = t[:i]
        parts = before.split("\n")
        while parts and parts[-1] == "" and before:
            parts.pop()
        at = before.rfind("\n")
        want[(t, i)] = f"{len(parts)}:{i + 1 - (at + 1 if at >= 0 else 0)}"
    assert got == want


def test_marks_of_texts(spark):
    texts = ["a.b..\n\n.c\n\n\n", "", "..", "\n\n.\n.x", "no mark", "é.\n.é中.", None, ".\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "class long, text string")
    each = spark.createDataFrame([(k, i, t) for k, t in enumerate(texts) for i, c in enumerate(t or "") if c == "."],
                                 "class long, start long, text string")
    want = each.select("class", "start", L.text_position(F.col("text"), F.col("start")).alias("pos"))
    assert rows(L.mark_positions(df, "."), "class", "start", "pos") == rows(want, "class", "start", "pos")


def test_token_dump(spark):
    lines = spark.createDataFrame([("(3:14, 3:28) class [declaration] pkg/Tokens",), ("(5:4, 5:9) field pkg/A#count:I",),
                                   ("(2:1, 2:6) field [declaration] pkg/A#count:I",), ("noise",)], "value string")
    t = L.parse_token_dump(lines)
    assert rows(t, "line", "kind", "is_decl", "owner", "name") == [
        (2, "field", True, "pkg/A", "count"), (3, "class", True, "pkg/Tokens", ""), (5, "field", False, "pkg/A", "count")]
    linked = L.token_links(t.withColumn("class", F.lit("X")).withColumn("start", F.col("line")))
    assert rows(linked, "line", "decl_start") == [(5, 2)]


def test_duplicates_are_verified_row_by_row(spark):
    data = []
    for block, ops in enumerate([["store", "load", "call"], ["store", "load", "call"], ["store", "load", "jump"], ["load", "store", "call"]]):
        for i, op in enumerate(ops):
            data.append(("u", block, block * 3 + i, op, block + (1 if op == "call" else 0)))
    blocks = spark.createDataFrame(data, "unit string, block long, idx long, op string, slot long")
    got = R.duplicate_blocks(R.normalised(blocks))
    assert rows(got, "block", "copies", "rep_block") == [(0, 2, 0), (1, 2, 0)]


def test_append_chains_break_on_other_rows(spark):
    ops = ["new", "operand", "operand", "end", "new", "operand", "other", "operand", "end", "operand", "end"]
    df = spark.createDataFrame([("u", i, o, i) for i, o in enumerate(ops)], "unit string, idx long, op string, value long")
    assert rows(R.append_chains(df, "new", "operand", "end"), "chain", "pos", "value") == [(0, 1, 1), (0, 2, 2)]


def test_parameter_agreement_is_aligned_from_the_end(spark):
    lists = {1: ["this", "x", "a", "b"], 2: ["this", "a", "b"], 3: ["this", "c", "b"]}
    df = spark.createDataFrame([("g", k, i, len(v), x) for k, v in lists.items() for i, x in enumerate(v)],
                               "g string, list long, pos long, size long, value string")
    assert rows(R.agreeing_positions(df, "g"), "pos", "value") == [(0, "this"), (1, None), (2, None), (3, "b")]


def test_slice_follows_effects_and_declarations(spark):
    # 0 declares s; 1 s = r; 2 touches s; 3 t = 1; 4 reads s
    t = [(0, 0, "declare"), (1, 0, "assign"), (1, 1, "read"), (2, 0, "effect"), (3, 2, "assign"), (4, 0, "effect")]
    touches = spark.createDataFrame([("u", i, s, r) for i, s, r in t], "unit string, idx long, slot long, role string")
    seeds = spark.createDataFrame([("u", 4)], "unit string, idx long")
    assert rows(D.backward_slice(seeds, D.slice_links(touches)), "idx") == [(0,), (1,), (2,), (4,)]


def test_closure_is_reflexive_and_transitive(spark):
    pairs = set(rows(closed(spark), "node", "anc"))
    names = {a for a, _ in TREE}
    assert all((n, n) in pairs for n in names)
    assert all((a, d) in pairs for (a, b), (c, d) in itertools.product(pairs, pairs) if b == c)


def equal_by_definition(classes, outs):
    """Least equal block of each block that has one: pairs are struck out until none differs."""
    place = {}
    for u, s, p, d in outs:
        place.setdefault((u, s), []).append((p, d))
    blocks = sorted(classes)
    same = {(x, y) for x in blocks for y in blocks if x[0] == y[0] and classes[x] == classes[y]}
    while True:
        bad = set()
        for x, y in same:
            px, py = dict(place.get(x, [])), dict(place.get(y, []))
            if px.keys() != py.keys() or any(((x[0], px[p]), (y[0], py[p])) not in same for p in px):
                bad.add((x, y))
        if not bad:
            break
        same -= bad
    least = {y: min(x[1] for x, z in same if z == y) for y in blocks}
    return sorted((u, a, n) for (u, n), a in least.items() if a != n)


def subgraphs(spark, classes, outs):
    nodes = spark.createDataFrame([(*k, v) for k, v in classes.items()], "unit string, node long, cls string")
    return rows(R.equal_subgraphs(nodes, spark.createDataFrame(outs, "unit string, src long, place string, dst long")), "unit", "a", "b")


def test_equal_subgraphs_beside_the_least_block(spark):
    # calls 1, 3 and 5 lead to a return, a store and a store
    classes = {("u", n): c for n, c in {1: "call", 2: "return", 3: "call", 4: "store", 5: "call", 6: "store"}.items()}
    outs = [("u", 1, "r1", 2), ("u", 3, "r1", 4), ("u", 5, "r1", 6)]
    assert subgraphs(spark, classes, outs) == [("u", 3, 5), ("u", 4, 6)] == equal_by_definition(classes, outs)
    # a handler of another type, or in another place, parts them
    assert subgraphs(spark, classes, outs + [("u", 4, "e1:E", 2), ("u", 6, "e1:F", 2)]) == []
    # loops of one and of two blocks are alike
    ring = {("v", n): "load" for n in range(1, 4)}
    assert subgraphs(spark, ring, [("v", 1, "r1", 1), ("v", 2, "r1", 3), ("v", 3, "r1", 2)]) == [("v", 1, 2), ("v", 1, 3)]


def test_equal_subgraphs_by_definition(spark, rng):
    classes = {(f"u{u}", n): rng.choice("abc") for u in range(6) for n in range(1, 30)}
    outs = [(u, n, p, rng.randrange(1, 30)) for u, n in classes for p in ("r0", "r1", "e1:E") if rng.random() < 0.3]
    # a chain, equal to another one but for its last block
    classes.update({("w", n): "z" if n == 40 else "x" for n in range(1, 61)})
    outs += [("w", n, "r1", n + 1) for n in range(1, 60) if n not in (20, 40)]
    want = equal_by_definition(classes, outs)
    assert len(want) > 40 and subgraphs(spark, classes, outs) == want


def test_successors_of_both_kinds(spark):
    blocks = spark.createDataFrame([("u", i, i // 2 + 1) for i in range(8)], "unit string, idx long, block long")
    edges = spark.createDataFrame([("u", 1, 2, 1), ("u", 1, 4, 0)], "unit string, src long, dst long, ord int")
    ranges = spark.createDataFrame(
        [("u", 0, 4, 6, "F"), ("u", 0, 4, 6, "E"), ("u", 2, 4, 4, None)],
        "unit string, from_idx long, to_idx long, handler_idx long, exc_type string")
    assert rows(R.successors(blocks, edges, ranges), "src", "place", "dst") == [
        (1, "e1:E,F", 4), (1, "r0", 4), (1, "r1", 2), (2, "e1:E,F", 4), (2, "e2:", 3)]
    instr = spark.createDataFrame(
        [("u", 0, "store", 5, 1), ("u", 1, "load", 5, 1), ("u", 2, "store", 7, 2), ("u", 3, "load", 7, 2), ("u", 4, "store", 7, 3), ("u", 5, "load", 8, 3)],
        "unit string, idx long, op string, slot long, block long")
    got = {n: tuple(c) for n, c in rows(R.block_classes(instr), "node", "cls")}
    assert got[1] == got[2] != got[3]


def analogous_by_definition(classes, outs, slots):
    """Least analogous block of each block that has one: all equal pairs are walked in step."""
    place = {}
    for u, s, p, d in outs:
        place.setdefault((u, s), {})[p] = d
    groups = {}
    for u, a, b in equal_by_definition(classes, outs):
        groups.setdefault((u, a), {a}).add(b)
    least = {}
    for (u, _), members in groups.items():
        for a, b in itertools.permutations(sorted(members), 2):
            seen, todo, there, back, ok = {(a, b)}, [(a, b)], {}, {}, True
            while todo and ok:
                x, y = todo.pop()
                for k, s in slots.get((u, x), {}).items():
                    t = slots[u, y][k]
                    ok = ok and there.setdefault(s, t) == t and back.setdefault(t, s) == s
                for p, d in place.get((u, x), {}).items():
                    pair = d, place[u, y][p]
                    if pair not in seen:
                        seen.add(pair)
                        todo.append(pair)
            if ok and a < b:
                least[u, b] = min(a, least.get((u, b), a))
    return sorted((u, a, b) for (u, b), a in least.items())


def analogous(spark, classes, outs, slots):
    nodes = spark.createDataFrame([(*k, v) for k, v in classes.items()], "unit string, node long, cls string")
    o = spark.createDataFrame(outs, "unit string, src long, place string, dst long")
    local = spark.createDataFrame([(*k, n, s) for k, m in slots.items() for n, s in m.items()], "unit string, node long, nslot int, slot long")
    return rows(R.analogous_subgraphs(R.equal_subgraphs(nodes, o), o, local), "unit", "a", "b")


def test_slots_correspond_throughout(spark, rng):
    # two stores and the loads behind them: 1-2 and 3-4 rename consistently, 5-6 loads what it did not store
    classes = {("u", n): "store" if n % 2 else "load" for n in range(1, 9)}
    outs = [("u", n, "r1", n + 1) for n in (1, 3, 5, 7)]
    slots = {("u", n): {1: s} for n, s in zip(range(1, 9), (0, 0, 3, 3, 0, 2, 5, 6))}
    got = analogous(spark, classes, outs, slots)
    assert got == analogous_by_definition(classes, outs, slots) and ("u", 1, 3) in got and ("u", 5, 7) in got and ("u", 1, 5) not in got
    # on the way back, two slots may not become one
    assert ("u", 1, 7) not in got and ("u", 2, 8) in got
    many = {(f"v{u}", n): rng.choice("ab") for u in range(5) for n in range(1, 20)}
    more = [(u, n, p, rng.randrange(1, 20)) for u, n in many for p in ("r0", "e1:E") if rng.random() < 0.35]
    more += [("w", n, "r1", n + 1) for n in range(1, 30) if n not in (10, 20)]
    many.update({("w", n): "s" for n in range(1, 31)})
    local = {k: {1: rng.randrange(3)} if v != "b" else {1: rng.randrange(2), 2: 2} for k, v in many.items()}
    want = analogous_by_definition(many, more, local)
    assert len(want) > 10 and len(want) != len(equal_by_definition(many, more))
    assert analogous(spark, many, more, local) == want
    assert analogous(spark, {("u", 1): "a"}, [], {}) == []


def test_equal_subgraphs_of_the_tables(spark):
    from classlake.plans.facts import facts
    from classlake.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    f = facts(spark, sf)
    classes = {(u, n): tuple(c) for u, n, c in R.block_classes(f.block).collect()}
    outs = [tuple(r) for r in R.successors(f.block, f.edge, f.range).collect()]
    slots = {}
    for u, n, k, s in R.local_slots(f.block).collect():
        slots.setdefault((u, n), {})[k] = s
    assert rows(QUERIES["equal_subgraphs"](spark, sf), "unit", "a", "b") == analogous_by_definition(classes, outs, slots)
