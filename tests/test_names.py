import random

from conftest import rows
from pyspark.sql import functions as F

from classlake.functions import descriptors as D
from classlake.functions import filters
from classlake.functions import names as N


def test_identifier_rules(spark):
    names = ["ok", "_x", "$", "", "1a", "a-b", "class", "é", "a\u0000b", "\U0001d400", "con", "<init>"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    bad = {n for n, m in rows(df.select("name", N.must_rename_member(F.col("name"), F.lit(True)).alias("m")), "name", "m") if m}
    assert bad == {"", "1a", "a-b", "class", "a\u0000b", "\U0001d400"}
    classes = ["pkg/Name", "pkg//Name", "pkg/int", "a/CON", "a", "ab$c", "abcd$c", "abc$defg", "x" * 250, "abcd", "abcd/", "/"]
    df = spark.createDataFrame([(n,) for n in classes], "name string")
    hit = {n for n, m in rows(df.select("name", N.rename_class(F.col("name")).alias("m")), "name", "m") if m}
    assert hit == {"pkg//Name", "pkg/int", "a/CON", "a", "ab$c", "x" * 250, "/"}


def greedy(data):
    """Names chosen one after another inside each scope."""
    used, out = {}, []
    for scope, base, o, letters in sorted(data, key=lambda r: r[2]):
        taken = used.setdefault(scope, set())
        if base in N.KEYWORDS:
            taken.add(base + "_")
            out.append((scope, o, base + "_"))
            continue
        k = 0
        while True:
            name = letter(ord(base) - 97 + k) if letters else base + (str(k) if k else "")
            if name not in taken:
                break
            k += 1
        taken.add(name)
        out.append((scope, o, name))
    return sorted(out)


def letter(i):
    text = ""
    while True:
        text = chr(97 + i % 26) + text
        i //= 26
        if i == 0:
            return text


def test_free_names_match_choosing_in_turn(spark, rng):
    bases = [("a", False), ("a1", False), ("a2", False), ("a11", False), ("do", False), ("do_", False), ("i", True), ("l", True), ("j", False), ("z", True)]
    data = [(s, *rng.choice(bases), 0) for s in ("p", "q") for _ in range(45)]
    data = [(s, b, n, le) for n, (s, b, le, _) in enumerate(data)]
    df = spark.createDataFrame([(s, b, n, le) for s, b, n, le in data], "scope string, base string, ord long, letters boolean")
    assert rows(N.free_names(df), "scope", "ord", "new_name") == greedy(data)


def test_reserved_names_are_skipped(spark):
    df = spark.createDataFrame([("s", "a", 0, False), ("s", "a", 1, False)], "scope string, base string, ord long, letters boolean")
    held = spark.createDataFrame([("s", "a"), ("s", "a2")], "scope string, name string")
    assert rows(N.free_names(df, held), "ord", "new_name") == [(0, "a1"), (1, "a3")]


def test_scope_clashes_with_natural_x_names(spark):
    data = [("u", "v", 0, 100, 0), ("u", "v", 10, 50, 1), ("u", "vx", 20, 40, 2), ("u", "v", 60, 90, 3), ("u", "v", 25, 30, 4), ("w", "v", 5, 6, 0)]
    df = spark.createDataFrame(data, "unit string, name string, start long, end long, ord long")
    got = rows(N.scope_clashes(df), "unit", "start", "new_name")
    want = []
    for u in ("u", "w"):
        live = []
        for _, name, s, e, _ in sorted((d for d in data if d[0] == u), key=lambda d: d[2]):
            live = [(n, x) for n, x in live if x > s]
            while name in {n for n, _ in live}:
                name += "x"
            live.append((name, e))
            want.append((u, s, name))
    assert got == sorted(want)


def test_counter_skips_taken_numbers(spark):
    wanted = spark.createDataFrame([(i, f"n{i}") for i in range(6)], "ord long, name string")
    held = spark.createDataFrame([("class_0",), ("class_2",), ("class_3",), ("class_03",), ("x",)], "name string")
    assert [n for _, n in rows(N.counter_names(wanted, held, ["ord"], "class_"), "ord", "new_name")] == [
        "class_1", "class_4", "class_5", "class_6", "class_7", "class_8"]


def test_class_names_with_digits(spark):
    wanted = spark.createDataFrame([(0, "1Foo"), (1, "2Foo"), (2, "12"), (3, "bad"), (4, "3Bar")], "ord long, name string")
    held = spark.createDataFrame([("InnerBar",)], "name string")
    assert rows(N.class_names(wanted, held, ["ord"]), "ord", "new_name") == [
        (0, "InnerFoo"), (1, "InnerFoo_0"), (2, "class_1"), (3, "class_2"), (4, "InnerBar_3")]


def test_typed_names(spark):
    kinds = ["int", "long", "int", "int", "int", "short", "File", "String", "foo", "Foo", "foo", "Foo[][]", "boolean", "double"]
    df = spark.createDataFrame([("u", i, 0, k) for i, k in enumerate(kinds)], "unit string, var int, version int, type string")
    assert [n for _, n in rows(N.typed_names(df), "var", "new_name")] == [
        "i", "j", "k", "l", "i1", "short1", "file1", "s", "foo", "foo", "foo1", "afoo", "flag", "d0"]


def test_descriptors(spark):
    df = spark.createDataFrame([("m", "(IJ[La/B;D)[[La/C;", False), ("n", "x", True)], "name string, d string, s boolean")
    d = F.col("d")
    got = rows(df.select("name", D.parameters(d).alias("p"), D.return_type(d).alias("r"),
                         D.slot_offsets(D.parameters(d), F.col("s")).alias("o"), D.source_signature(F.col("name"), d).alias("g")),
               "name", "p", "r", "o", "g")
    assert got == [("m", ["I", "J", "[La/B;", "D"], "[[La/C;", [1, 2, 4, 5], "m (IJ[La/B;D)"), ("n", [], "x", [], "n x")]
    ren = spark.createDataFrame([("a/B", "z/Y")], "old string, new string")
    assert rows(D.remap_descriptors(df, "d", ren, "m2"), "m2") == [("(IJ[Lz/Y;D)[[La/C;",), ("x",)]


def test_filters(spark):
    df = spark.createDataFrame([("com/a/X",), ("org/b/Y",)], "name string")
    keep = lambda c: rows(df.filter(c), "name")
    assert keep(filters.allowed(F.col("name"), [])) == [("com/a/X",), ("org/b/Y",)]
    assert keep(filters.allowed(F.col("name"), ["com/"])) == [("com/a/X",)]
    assert keep(filters.excluded(F.col("name"), "a")) == []
    assert keep(filters.excluded(F.col("name"), ".*/Y|q")) == [("org/b/Y",)]


def test_policy_and_provider(spark):
    df = spark.createDataFrame([(1, "bad-name"), (2, "good")], "ord long, name string")
    got = N.apply_policy(df, lambda d: N.must_rename_member(F.col("name"), F.lit(False)),
                         lambda d: d.withColumn("new_name", F.concat(F.lit("n"), F.col("ord").cast("string"))))
    assert rows(got, "ord", "new_name") == [(1, "n1"), (2, "good")]


def test_providers_see_slices(spark, monkeypatch):
    """Places and counts go on over slices; no call gets more than a slice, unless it asks for the unit."""
    monkeypatch.setattr(N, "SLICE", 4)
    rng = random.Random(3)
    data = [(u, v, w, rng.choice("abc")) for u, n in ((1, 30), (2, 3)) for v in range(n) for w in range(rng.randint(1, 2))]
    df = spark.createDataFrame(data, "unit long, var int, version int, kind string").repartition(5)
    seen = {}
    want = []
    for u in (1, 2):
        for at, (_, v, w, k) in enumerate(sorted(r for r in data if r[0] == u)):
            want.append((u, v, w, k, f"{k}{seen.setdefault((u, k), 0)}@{at}"))
            seen[u, k] += 1

    def name(pdf):
        assert len(pdf) <= 4 and pdf["at"].is_monotonic_increasing
        return pdf["kind"] + pdf["seen"].astype(str) + "@" + pdf["at"].astype(str)

    got = N.provide_names(df, name, counted=F.col("kind"))
    assert got.columns == ["unit", "var", "version", "kind", "new_name"] and sorted(map(tuple, got.collect())) == want
    sizes = N.provide_names(df, lambda pdf: [str(len(pdf))] * len(pdf), whole=True).collect()
    assert {(r.unit, int(r.new_name)) for r in sizes} == {(u, sum(r[0] == u for r in data)) for u in (1, 2)}
