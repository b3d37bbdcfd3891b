import duckdb
import pytest

from plumbline.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    got = queries.queries()[name](spark, FOLDER).toArrow()
    want = con.execute(queries.oracle_sql()[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    rows = lambda t: sorted(map(repr, zip(*[t.column(n).to_pylist() for n in names])))
    assert rows(got) == rows(want)
    assert [str(got.schema.field(n).type) for n in names] == [str(want.schema.field(n).type).replace("large_", "") for n in names]


def test_one_query_per_operator():
    numbers = [int(n[2:].split("_")[0]) for n in queries.queries()]
    assert sorted(numbers) == [*range(1, 14)]
