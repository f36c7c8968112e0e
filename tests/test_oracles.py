"""Each query with SQL gives DuckDB's rows on the smallest tables."""

import functools
import glob

import duckdb
import pytest

from roadlens.plans import queries
from roadlens.plans.oracles import SQL
from roadlens.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def value(x):
    return round(x, 5) if isinstance(x, float) else x


@pytest.fixture(scope="module", autouse=True)
def one_graph():
    """The road graph and the routes are written once for all queries on them."""
    kept = queries._road_graph, queries._routes
    queries._road_graph, queries._routes = map(functools.cache, kept)
    yield
    queries._road_graph, queries._routes = kept


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(value(r[c]) for c in columns) for r in df.collect()), key=repr)
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {f.split('/')[-1][:-8]} as select * from '{f}'")
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(value(r[i]) for i in at) for r in rel.fetchall()), key=repr)
