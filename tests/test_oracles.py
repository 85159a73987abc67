"""Every query that SQL can express, held against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from weftline.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, db, tmp_path, name):
    QUERIES[name](spark, SF).write.parquet(out := str(tmp_path / name))
    got, want = db.sql(f"SELECT * FROM '{out}/*.parquet'"), db.sql(ORACLES[name])
    assert dict(zip(got.columns, map(str, got.types))) == dict(zip(want.columns, map(str, want.types)))
    columns = ", ".join(f'"{c}"' for c in sorted(got.columns))
    rows = lambda source: sorted(map(repr, db.sql(f"SELECT {columns} FROM {source}").fetchall()))
    assert rows(f"'{out}/*.parquet'") == rows(f"({ORACLES[name]})")


def test_queries_without_sql_are_few_and_run(spark):
    rest = sorted(set(QUERIES) - set(ORACLES))
    assert rest == []
    for name in rest:
        assert QUERIES[name](spark, SF).count() > 0
