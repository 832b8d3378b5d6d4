"""Every registered query against its SQL on the smallest tables."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location("check_oracle", Path(__file__).parents[1] / "tools" / "check_oracle.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_flagship(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, tables, name):
    df = entry.queries()[name](spark, SF)
    got = check.canonical(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    result = tables.execute(sql)
    assert got == check.canonical([d[0] for d in result.description], result.fetchall())
