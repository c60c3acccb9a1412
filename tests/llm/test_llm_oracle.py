"""The training-data plans with SQL give the rows of their SQL."""

import os

import duckdb
import pytest

from lexmill.llm import queries


@pytest.fixture(scope="module")
def tables(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_plan(spark, tables, data, tmp_path, name):
    df = queries.QUERIES[name](spark, data)
    path = str(tmp_path / "out")
    df.write.parquet(path)
    tables.execute(f"CREATE OR REPLACE TEMP TABLE want AS {queries.ORACLE[name].strip()}")
    columns = [r[0] for r in tables.execute("DESCRIBE want").fetchall()]
    assert sorted(columns) == sorted(df.columns)
    tables.execute(f"CREATE OR REPLACE TEMP TABLE got AS SELECT {', '.join(columns)} FROM '{path}/*.parquet'")
    assert tables.execute("SELECT * FROM want EXCEPT ALL SELECT * FROM got").fetchall() == []
    assert tables.execute("SELECT * FROM got EXCEPT ALL SELECT * FROM want").fetchall() == []
