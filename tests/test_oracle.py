"""Every plan with SQL gives the rows of its SQL; the others run."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

ORACLE = entry.oracle_sql()
CORE = entry.registry.QUERIES


@pytest.fixture(scope="module")
def tables(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(CORE))
def test_plan(spark, tables, data, tmp_path, name):
    df = CORE[name](spark, data)
    path = str(tmp_path / "out")
    df.write.parquet(path)
    if name not in ORACLE:
        assert spark.read.parquet(path).columns == df.columns
        return
    tables.execute(f"CREATE OR REPLACE TEMP TABLE want AS {ORACLE[name].strip()}")
    columns = [r[0] for r in tables.execute("DESCRIBE want").fetchall()]
    assert sorted(columns) == sorted(df.columns)
    tables.execute(f"CREATE OR REPLACE TEMP TABLE got AS SELECT {', '.join(columns)} FROM '{path}/*.parquet'")
    assert tables.execute("SELECT * FROM want EXCEPT ALL SELECT * FROM got").fetchall() == []
    assert tables.execute("SELECT * FROM got EXCEPT ALL SELECT * FROM want").fetchall() == []


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
