"""Every query with SQL gives DuckDB's rows on the driver's smallest tables."""

import os

import duckdb
import pytest

from lodewell.plans import all_queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n, (_, sql) in all_queries().items() if sql])
def test_same_rows(spark, duck, tmp_path, name):
    query, sql = all_queries()[name]
    df = query(spark, DATA)
    df.write.parquet(str(tmp_path / "got"))
    cols = ", ".join(f'"{c}"' for c in sorted(df.columns))
    duck.sql(f"CREATE OR REPLACE TABLE want AS {sql}")
    got = f"SELECT {cols} FROM '{tmp_path}/got/*.parquet'"
    want = f"SELECT {cols} FROM want"
    assert duck.sql(f"SELECT count(*) FROM ({want} EXCEPT ALL {got})").fetchall() == [(0,)]
    assert duck.sql(f"SELECT count(*) FROM ({got} EXCEPT ALL {want})").fetchall() == [(0,)]


@pytest.mark.parametrize("name", [n for n, (_, sql) in all_queries().items() if not sql])
def test_runs(spark, name):
    assert all_queries()[name][0](spark, DATA).count() > 0
