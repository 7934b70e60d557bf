"""Every core query with a SQL twin against DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from corpusloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 7) + 0.0)
    return f"{type(v).__name__}:{v}"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(FOLDER + "/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_twin(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted("|".join(map(normal, r)) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    twin = duck.sql(registry.SQL[name])
    assert sorted(twin.columns) == cols
    want = sorted("|".join(map(normal, r)) for r in twin.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert got == want


def test_queries_without_twins(spark):
    for name in sorted(set(registry.QUERIES) - set(registry.SQL)):
        df = registry.QUERIES[name](spark, FOLDER)
        assert df.columns and df.count() >= 1
