from conftest import rows
from pyspark.sql import functions as F

from classlake.operators import hierarchy as H
from classlake.operators import members as M
from classlake.operators import rename as R

METHOD = ("class string, name string, params string, ret string, ord long, in_iface boolean, overridable boolean, "
          "final boolean, abstract boolean, public boolean, visible boolean, package string, access_rank int, own boolean")


def method(cls, name, ord_, iface=False, final=False, abstract=False, own=True, rank=3, ret="V", params="()"):
    return (cls, name, params, ret, ord_, iface, True, final, abstract, True, True, "p", rank, own)


def parents(spark, data):
    return spark.createDataFrame(data, "node string, parent string, pos int")


def returns(spark):
    return spark.createDataFrame([("String", "Object")], "child string, parent string")


def test_subtype_test_of_unknown_and_null(spark):
    known = spark.createDataFrame([("A", "B"), ("B", None)], "node string, super string")
    closed = H.closure(parents(spark, [("A", "B", 0)]))
    pairs = spark.createDataFrame([("A", "B"), ("B", "A"), ("X", "Object"), ("X", "B"), (None, "Object"), ("A", None), ("A", "Object"), ("B", "Object")], "a string, b string")
    got = {(a, b): s for a, b, s in rows(H.subtype_test(pairs, closed, known, "Object"), "a", "b", "is_sub")}
    assert got == {("A", "B"): True, ("B", "A"): False, ("X", "Object"): True, ("X", "B"): False, (None, "Object"): False,
                   ("A", None): False, ("A", "Object"): False, ("B", "Object"): True}


def test_closure_survives_a_cycle_and_is_transitive(spark):
    closed = set(rows(H.closure(parents(spark, [("A", "B", 0), ("B", "C", 0), ("C", "A", 0), ("D", "A", 0)])), "node", "anc"))
    assert all((a, d) in closed for a, b in closed for c, d in closed if b == c)
    assert {x for n, x in closed if n == "D"} == {"A", "B", "C", "D"}


def test_depth_first_against_breadth_first(spark):
    # A extends S implements I; S implements J; both I and J hold the member
    p = parents(spark, [("A", "S", 0), ("A", "I", 1), ("S", "J", 1), ("J", "K", 1)])
    start = spark.createDataFrame([("A",)], "node string")
    refs = spark.createDataFrame([("A", "f", "()", "V"), ("A", "<init>", "()", "V")], "owner string, name string, params string, ret string")
    members = spark.createDataFrame([("I", "f", "()", "V"), ("K", "f", "()", "V"), ("S", "<init>", "()", "V")], "class string, name string, params string, ret string")
    got = dict(rows(M.resolve(refs, H.ranked_closure(p, start), members), "name", "found"))
    assert got == {"f": "K", "<init>": None}
    ren = spark.createDataFrame([("I", "f", "()", "fi"), ("K", "f", "()", "fk")], "owner string, name string, params string, target string")
    none = members.filter("false")
    breadth = H.ranked_closure(p, start, breadth_first=True)
    assert dict(rows(M.resolve_rename(refs, breadth, none, ren), "name", "target"))["f"] == "fi"
    stop = spark.createDataFrame([("S", "f", "()", "V")], "class string, name string, params string, ret string")
    assert dict(rows(M.resolve_rename(refs, breadth, stop, ren), "name", "target"))["f"] is None


def test_resolution_retries_under_the_new_name(spark):
    p = parents(spark, [("A", "S", 0)])
    start = spark.createDataFrame([("A",)], "node string")
    refs = spark.createDataFrame([("A", "old", "()", "V")], "owner string, name string, params string, ret string")
    members = spark.createDataFrame([("S", "new", "()", "V")], "class string, name string, params string, ret string")
    ren = spark.createDataFrame([("A", "old", "()", "new")], "owner string, name string, params string, target string")
    assert rows(M.resolve(refs, H.ranked_closure(p, start), members, ren), "name", "found") == [("old", "S")]


def family_fixture(spark):
    p = parents(spark, [("Base", "Object", 0), ("Impl", "Base", 0), ("Impl", "Face", 1), ("Other", "Face", 1)])
    methods = spark.createDataFrame(
        [method("Base", "a", 1, abstract=True), method("Impl", "a", 2), method("Face", "a", 3, iface=True, abstract=True),
         method("Other", "a", 4), method("Impl", "b", 5)], METHOD)
    return p, methods, H.closure(p)


def test_override_family_shares_one_name(spark):
    p, methods, closed = family_fixture(spark)
    pairs = M.override_pairs(methods, closed, returns(spark))
    fam = M.families(methods, pairs)
    assert len({f for c, n, f in rows(fam, "class", "name", "family") if n == "a"}) == 1
    mapping = spark.createDataFrame([("Face", "a", "()", "fromFace"), ("Impl", "a", "()", "run")], "owner string, name string, params string, target string")
    out = rows(R.rename_members(methods, fam, closed, mapping), "class", "name", "new_name")
    assert out == [("Base", "a", "run"), ("Face", "a", "run"), ("Impl", "a", "run"), ("Impl", "b", "b"), ("Other", "a", "run")]


def test_conflicting_names_keep_one_keeper(spark):
    p = parents(spark, [("Sub", "Base", 0), ("Sub", "Face", 1)])
    closed = H.closure(p)
    methods = spark.createDataFrame(
        [method("Base", "x", 1), method("Base", "y", 2), method("Face", "z", 3, iface=True, abstract=True), method("Lib", "q", 4, own=False)], METHOD)
    fam = M.families(methods, M.override_pairs(methods, closed, returns(spark)))
    mapping = spark.createDataFrame(
        [("Base", "x", "()", "same"), ("Base", "y", "()", "same"), ("Face", "z", "()", "same"), ("Lib", "q", "()", "same")],
        "owner string, name string, params string, target string")
    got = {(c, n): t for c, n, t in rows(R.rename_members(methods, fam, closed, mapping), "class", "name", "new_name")}
    assert got[("Base", "x")] == "same" and got[("Lib", "q")] == "q"
    assert len({got[("Base", "x")], got[("Base", "y")], got[("Face", "z")]}) == 3


def test_missing_implementation_and_defaults(spark):
    p = parents(spark, [("C", "Base", 0), ("D", "Object", 0), ("D", "Face", 1), ("D", "Deft", 1), ("Deft", "Face", 1), ("E", "Base", 0)])
    methods = spark.createDataFrame(
        [method("Base", "a", 1, abstract=True), method("Face", "f", 2, iface=True, abstract=True),
         method("Deft", "f", 3, iface=True), method("E", "a", 4, rank=3)], METHOD)
    targets = spark.createDataFrame([("C", "p"), ("D", "p"), ("E", "p")], "node string, package string")
    breadth = H.ranked_closure(p, targets, breadth_first=True)
    need = M.most_specific_return(M.abstract_obligations(targets, breadth, methods), returns(spark))
    assert rows(need, "node", "name") == [("C", "a"), ("D", "f"), ("E", "a")]
    unmet = M.unmet_obligations(need, H.super_chain(p, targets), H.closure(p), methods, returns(spark))
    assert rows(unmet, "node", "name", "access_rank") == [("C", "a", 3)]


def test_relocation_to_one_or_the_fixed_package(spark):
    classes = spark.createDataFrame([("A", ""), ("B", "p"), ("C", "q")], "node string, package string")
    one = spark.createDataFrame([("B", "A"), ("C", "B")], "node string, used string")
    two = spark.createDataFrame([("B", "A"), ("C", "A")], "node string, used string")
    none = spark.createDataFrame([("C", "B")], "node string, used string")
    assert rows(M.relocations(classes, one, "fixed"), "node", "target") == [("A", "p")]
    assert rows(M.relocations(classes, two, "fixed"), "node", "target") == [("A", "fixed")]
    assert rows(M.relocations(classes, none, "fixed"), "node", "target") == []


def test_platform_lookup_is_unknown_when_the_input_has_the_root(spark):
    refs = spark.createDataFrame([("P", "m", "()", "V"), ("P", "n", "()", "V"), ("Q", "m", "()", "V")], "owner string, name string, params string, ret string")
    classes = spark.createDataFrame([("P",)], "node string")
    api = spark.createDataFrame([("P", "m", "()", "V", "IO")], "class string, name string, params string, ret string, declared string")
    none = classes.filter("false")
    assert rows(M.platform_lookup(refs, classes, api, none), "owner", "name", "state", "declared") == [
        ("P", "m", "RESOLVED", "IO"), ("P", "n", "ABSENT", None), ("Q", "m", "UNKNOWN", None)]
    assert {s for s, in rows(M.platform_lookup(refs, classes, api, classes), "state")} == {"UNKNOWN"}


def test_switch_decoding(spark):
    labels = spark.createDataFrame([(1, 0, -1), (1, 1, 3), (1, 2, 4), (2, 0, 9)], "unit long, idx long, label long")
    table = spark.createDataFrame([(1, 3, "A"), (1, 6, "B"), (2, 5, "C")], "unit long, key long, constant string")
    assert rows(M.decode_switch(labels, table), "unit", "label", "constant") == [(1, -1, "null"), (1, 3, "A"), (1, 4, "B")]


def test_nested_forest_needs_agreement(spark):
    claims = spark.createDataFrame([("A$B", "A", "A"), ("A$B$C", "A$B", "A$B"), ("A$X", "A", "Z")], "inner string, encloser string, recorded string")
    roots = spark.createDataFrame([("A",)], "node string")
    assert rows(H.nested_forest(claims, roots), "node", "depth") == [("A", 0), ("A$B", 1), ("A$B$C", 2)]


def test_accessor_inlining(spark):
    instr = spark.createDataFrame(
        [("O.acc", 0, "load", 1, None), ("O.acc", 1, "get", 1, "O"), ("O.acc", 2, "return", 1, None),
         ("O.big", 0, "get", 1, "O"), ("O.big", 1, "get", 1, "O")],
        "unit string, idx long, op string, block int, owner string").withColumn("name", F.lit("f")).withColumn("params", F.lit("")).withColumn("ret", F.lit("I"))
    ms = spark.createDataFrame([("O.acc", True, True), ("O.big", True, True)], "unit string, static boolean, synthetic boolean")
    shapes = R.accessor_shapes(instr, ms)
    assert rows(shapes, "unit", "to_owner", "to_name") == [("O.acc", "O", "f")]
    acc = shapes.select(F.lit("O").alias("owner"), F.lit("acc").alias("name"), F.lit("()").alias("params"), F.lit("I").alias("ret"),
                        "to_owner", "to_name", "to_params", "to_ret")
    refs = spark.createDataFrame([("O$I", "O", "acc", "()", "I"), ("Far", "O", "acc", "()", "I")], "caller string, owner string, name string, params string, ret string")
    nests = spark.createDataFrame([("O", "O"), ("O$I", "O"), ("Far", "Far")], "node string, root string")
    assert rows(R.inline_accessors(refs, acc, nests), "caller", "name", "inlined") == [("Far", "acc", False), ("O$I", "f", True)]
