import zipfile

import pytest
from conftest import rows
from pyspark.sql import functions as F

from classlake.sources import entries as S
from classlake.sources import mappings as M
from classlake.sources import results as R

MAGIC = bytes.fromhex("CAFEBABE")


def test_archive_and_directory_list_the_same_entries(spark, tmp_path):
    files = {"a/A.class": MAGIC + b"x", "a/b/B.class": MAGIC, "a/fake.class": b"nope", "META-INF/versions/11/a/A.class": MAGIC}
    tree = tmp_path / "tree"
    for name, body in files.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_bytes(body)
    jar = tmp_path / "lib.jar"
    with zipfile.ZipFile(jar, "w") as z:
        z.writestr("a/", "")
        for name, body in files.items():
            z.writestr(name, body)
    bare = tmp_path / "archive.bin"
    bare.write_bytes(jar.read_bytes())
    kind = S.entry_kind(F.col("path"), F.col("magic")).alias("entry")
    listed = {}
    for key, path in (("tree", tree), ("jar", jar), ("bin", bare)):
        df = S.scan_spaces(spark, str(path)).filter("not is_dir").select("kind", "path", kind)
        listed[key] = [(p, e) for _, p, e in rows(df, "kind", "path", "entry")]
        assert {k for k, _, _ in rows(df, "kind", "path", "entry")} == {"directory" if key == "tree" else "archive"}
    assert listed["tree"] == listed["jar"] == listed["bin"]
    assert dict(listed["jar"])["a/fake.class"] == "other"
    versions = S.split_version(S.scan_spaces(spark, str(jar)).filter("not is_dir").withColumn("kind", kind), "path")
    assert rows(versions.filter("multirelease <> -1"), "base_path", "multirelease") == [("/a/A.class", 11)]
    assert len(rows(S.base_classes(versions), "path")) == 2
    dirs = S.directories(versions.filter("multirelease = -1"), ["unit_id"], "path", S.scan_spaces(spark, str(jar)).filter("is_dir"))
    assert [d for d, in rows(dirs, "dir")] == ["a", "a/", "a/b"]


def test_archive_in_directory_is_a_child_space_and_single_file(spark, tmp_path):
    inner = tmp_path / "root" / "lib.zip"
    inner.parent.mkdir()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("X.class", MAGIC)
        z.writestr("deep.jar", b"PK")
    (tmp_path / "root" / "Y.class").write_bytes(MAGIC)
    got = rows(S.scan_spaces(spark, str(tmp_path / "root")), "kind", "path", "nested")
    assert got == [("archive", "X.class", True), ("archive", "deep.jar", True), ("directory", "Y.class", False)]
    assert rows(S.scan_spaces(spark, str(tmp_path / "root" / "Y.class")), "kind", "path") == [("file", "Y.class")]


def test_version_rules(spark):
    df = spark.createDataFrame([("META-INF/versions/9/x",), ("META-INF/versions/q/x",), ("META-INF/versions/9",), ("x",)], "path string")
    got = rows(S.split_version(df, "path"), "path", "base_path", "multirelease")
    assert ("META-INF/versions/9/x", "/x", 9) in got and all(v == -1 for p, _, v in got if p != "META-INF/versions/9/x")
    low = spark.createDataFrame([("META-INF/versions/8/x",)], "path string")
    with pytest.raises(Exception, match="version below 9"):
        S.split_version(low, "path").collect()


def test_own_beats_library_and_misfiled_classes_register_twice(spark):
    df = spark.createDataFrame(
        [("A", "lib", False, 0, "A"), ("A", "own1", True, 1, "A"), ("A", "own2", True, 2, "A"), ("B", "lib", False, 3, "C"), ("C", "own", True, 9, "C")],
        "k string, unit string, is_own boolean, ord long, declared string")
    assert rows(S.precedence(df), "k", "unit") == [("A", "own1"), ("B", "lib"), ("C", "own")]
    assert rows(S.register_misfiled(df.filter("k <> 'C'")), "k", "unit") == [("A", "own1"), ("B", "lib"), ("C", "lib")]


MAPPING = """tiny\t2\t0\tofficial\tnamed
# comment
c\ta\tpkg/Alpha
\tf\tI\tx\tcount
\tm\t(I)V\tm\trun

\t\tp\t1\tp\tamount
\t\tx\tignored
\tx\todd
\t\tp\t2\tq\torphan
k\tnot a class
\tm\t()V\tn\tlost
c\tb\tpkg/Beta
\tm\t()V\tn\tkept
"""


def test_mapping_file(spark, tmp_path):
    path = tmp_path / "names.tiny"
    path.write_text(MAPPING)
    got = M.parse_mapping(M.read_lines(spark, str(path)), "official", "named")
    assert rows(got, "kind", "owner", "name", "descriptor", "lv_index", "target") == [
        ("class", "a", None, None, None, "pkg/Alpha"), ("class", "b", None, None, None, "pkg/Beta"),
        ("field", "a", "x", "I", None, "count"), ("method", "a", "m", "(I)V", None, "run"), ("method", "b", "n", "()V", None, "kept"),
        ("param", "a", "m", "(I)V", 1, "amount")]


def test_mapping_errors(spark):
    schema = "file string, line long, value string"
    head = ("f", 1, "tiny\t2\t0\ta\tb")
    with pytest.raises(Exception, match="short mapping row"):
        M.parse_mapping(spark.createDataFrame([head, ("f", 2, "c\tonly")], schema)).collect()
    with pytest.raises(Exception, match="namespaces not found"):
        M.parse_mapping(spark.createDataFrame([head, ("f", 2, "c\tx\ty")], schema), "a", "zzz").collect()


def test_mapping_escapes_and_descriptor_namespaces(spark):
    schema = "file string, line long, value string"
    text = ["tiny\t2\t0\traw\told\tnew", "\tescaped-names", "c\tr\ta/B\ta\\\\nX", "\tf\tLr;\tx\ty\tz", "\tm\t(Lr;)V\tq\tm\tk", "\t\tp\t1\t\t\targ"]
    got = M.parse_mapping(spark.createDataFrame([("f", i + 1, v) for i, v in enumerate(text)], schema), "old", "new")
    assert rows(got, "kind", "owner", "name", "descriptor", "target") == [
        ("class", "a/B", None, None, "a\\nX"), ("field", "a/B", "y", "La/B;", "z"), ("method", "a/B", "m", "(La/B;)V", "k"),
        ("param", "a/B", "m", "(La/B;)V", "arg")]
    phases = rows(M.parameter_names_in_phases(got), "owner", "name", "descriptor")
    assert len(phases) == 8 and ("a\\nX", "k", "(La\\nX;)V") in phases and ("a/B", "m", "(La/B;)V") in phases


def test_contradicting_renames(spark):
    schema = "file string, line long, value string"
    text = ["tiny\t2\t0\ta\tb", "c\tx\ty", "c\tx\tz"]
    with pytest.raises(Exception, match="contradicting"):
        M.parse_mapping(spark.createDataFrame([("f", i + 1, v) for i, v in enumerate(text)], schema)).collect()


def test_parameter_names(spark):
    df = spark.createDataFrame([("C m (JI)V a b",), ("C m (I)V",), ("short row here",)], "value string")
    assert rows(M.parse_parameter_names(df), "slot", "param") == [(0, "a"), (1, "a"), (2, "b")]


def test_safe_paths(spark):
    cases = {"a/b": True, "../a": False, "a/../../b": False, "/a": False, "C:x": False, "a\\b": False, "a\x00b": False,
             "a/..": True, "a/./b/../c": True, "1:x": True}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert dict(rows(df.select("p", R.safe_path(F.col("p")).alias("ok")), "p", "ok")) == cases


def test_sinks_keep_first_write_and_order(spark, tmp_path):
    df = spark.createDataFrame([("u", "e", 2, "late"), ("u", "e", 1, "first"), ("v", "e", 1, "other")], "unit_id string, entry string, ord long, line string")
    assert rows(R.first_writes(df, ["unit_id", "entry"], ["ord"]), "unit_id", "line") == [("u", "first"), ("v", "other")]
    assert rows(R.repeated_writes(df, ["unit_id", "entry"]), "unit_id", "writes") == [("u", 2)]
    many = spark.range(200).select(F.lit("u").alias("unit_id"), F.col("id").alias("ord"), F.col("id").cast("string").alias("line"))
    R.SINKS["text"](many, str(tmp_path / "text"))
    parts = sorted((tmp_path / "text" / "unit_id=u").glob("part-*"))
    assert len(parts) > 1 and [x for p in parts for x in p.read_text().split()] == [str(i) for i in range(200)]
    R.save_table(df, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 3
    R.register_source("lines", lambda s, p: s.read.text(p))
    assert R.SOURCES["lines"](spark, str(tmp_path / "text")).count() == 200
