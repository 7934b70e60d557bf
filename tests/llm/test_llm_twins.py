"""Every query of the subpackage with a SQL twin against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from corpusloom.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(FOLDER + "/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_llm_twin(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted("|".join(map(str, r)) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    twin = duck.sql(queries.SQL[name])
    assert sorted(twin.columns) == cols
    assert got == sorted("|".join(map(str, r)) for r in twin.project(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_llm_queries_without_twins(spark):
    for name in sorted(set(queries.QUERIES) - set(queries.SQL)):
        df = queries.QUERIES[name](spark, FOLDER)
        assert df.columns and df.count() >= 0
