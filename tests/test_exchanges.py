import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from classlake.operators import members as M
from classlake.operators import rename as R
from classlake.operators.hierarchy import closure


def exchanges(monkeypatch, module):
    """Exchanges of each table that ``module`` writes, by the table's columns."""
    found = []
    old = module.cut

    def write(df):
        found.append((df.columns, df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")))
        return old(df)

    monkeypatch.setattr(module, "cut", write)
    return found


@pytest.fixture
def line(spark):
    parents = spark.createDataFrame([(2, 1, 0), (3, 2, 0), (4, 3, 0), (4, 2, 1)], "node int, parent int, pos int")
    levels = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 3)], "node int, level long")
    return parents, levels


def test_a_level_of_names_is_dealt_out_once(spark, monkeypatch, line):
    kinds = "class int, name string, params string, ret string, proposed string, fixed boolean, overridable boolean, ord int"
    methods = spark.createDataFrame([
        (1, "a", "()", "V", "b", False, True, 1), (2, "a", "()", "V", "c", False, True, 2), (2, "b", "()", "V", "b", False, True, 3),
        (3, "c", "()", "V", "b", False, True, 4), (4, "a", "()", "V", "a", False, True, 5), (4, "d", "()", "V", "b", False, True, 6)], kinds)
    found = exchanges(monkeypatch, R)
    got = rows(R.flowing_names(methods, *line), "class", "name", "new_name", "how")
    assert got == [
        (1, "a", "b", "kept"), (2, "a", "b", "inherited"), (2, "b", "b_1", "renamed"), (3, "c", "b_2", "renamed"),
        (4, "a", "b", "inherited"), (4, "d", "b_3", "renamed")]
    placed = [n for columns, n in found if "_loses" in columns]
    assert len(placed) == 4 and max(placed) == 1


def test_a_level_of_families_writes_what_it_meets_alone(spark, monkeypatch, line):
    methods = spark.createDataFrame(
        [(c, "a", "()", r, True, False) for c, r in ((1, "O"), (2, "F"), (3, "F"), (4, "O"))] + [(3, "x", "()", "O", True, False)],
        "class int, name string, params string, ret string, overridable boolean, final boolean")
    returns = spark.createDataFrame([("F", "O")], "child string, parent string")
    none = spark.createDataFrame([], "class int, name string, params string, ret string, sup int, sup_ret string")
    found = exchanges(monkeypatch, M)
    got = rows(M.flowing_families(methods, *line, returns, none), "class", "name", "family")
    assert got == [(c, "a", "1 a () O") for c in (1, 2, 3)] + [(3, "x", "3 x () O"), (4, "a", "1 a () O")]
    # what a class meets is written, what was sent to it is not written again
    assert sum("_k" in columns and "final" in columns for columns, _ in found) == 4
    assert [columns for columns, _ in found if columns == [*M.KEY, "root"]] == []


def test_classes_meet_where_they_first_do(spark):
    rng = random.Random(3)
    for turn in range(3):
        nodes = range(16)
        arcs = sorted({(n, rng.randrange(n), pos) for n in nodes if n for pos in range(rng.choice([1, 1, 2, 3]))})
        parents = spark.createDataFrame(arcs, "node int, parent int, pos int")
        intf = {n for n in nodes if rng.random() < 0.4}
        own = spark.createDataFrame([(n,) for n in nodes if n not in intf and rng.random() < 0.5], "node int")
        methods = spark.createDataFrame(
            [(n, "a", "()", "V", True, False, True, n in intf) for n in nodes if rng.random() < 0.8],
            "class int, name string, params string, ret string, overridable boolean, final boolean, public boolean, in_iface boolean")
        returns = spark.createDataFrame([("F", "O")], "child string, parent string")
        closed = closure(parents).cache()
        ask = lambda *more: rows(M.inherited_implementations(methods, closed, returns, own, *more), "class", "sup")
        assert ask(parents) == ask()
        only = spark.createDataFrame([(n, n // 2, 0) for n in range(1, 16)], "node int, parent int, pos int")
        assert M.first_meetings(only, closure(only), only.select("node"), methods.select("class"),
                                methods.select(F.col("class").alias("sup"))).isEmpty()
