"""Every registered query of the subpackage, against its SQL where there is one."""

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, rows
from classlake.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_registry():
    names = list(Q.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(names) | {"pipeline"} <= set(contract.queries()) and set(Q.ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, name):
    df = Q.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    if name in Q.ORACLES:
        db = duckdb.connect()
        for t in TABLES:
            db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
        cur = db.execute(Q.ORACLES[name])
        assert got == rows([c[0] for c in cur.description], cur.fetchall())
