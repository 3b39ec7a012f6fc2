"""Every query that has SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from parchment import queries as engine

SF = "/root/testdata/sf0.001"
NAMES = sorted(engine.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(rows):
    return sorted(repr({k: round(v, 6) if isinstance(v, float) else v for k, v in sorted(r.items())}) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = engine.queries()[name](spark, SF).toArrow()
    sql = engine.oracle_sql().get(name)
    if sql is None:
        assert got.num_rows > 0
        return
    cursor = duck.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    assert sorted(got.column_names) == sorted(columns)
    assert plain(got.to_pylist()) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "title", "filename", "status", "created_at"]
    assert set(engine.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
