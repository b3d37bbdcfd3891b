"""Every registered query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

from plumbline import catalog
from plumbline.plans.views import TABLES

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(map(repr, zip(*[table.column(n).to_pylist() for n in names])))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toArrow()
    assert rows(got) == rows(duck.execute(ORACLES[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_every_section_is_covered():
    prefixes = {n.split("_")[0] for n in QUERIES}
    assert {"join", "agg", "win", "set", "rsh", "sel", "cas", "str", "jsn", "geo", "math", "hash", "stat", "gen", "sco", "chk", "prj"} <= prefixes
