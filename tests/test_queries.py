"""Every query of the catalog against its SQL in DuckDB, over whole tables."""

import os

import duckdb
import pytest

from tessella.plans.catalog import FLAGSHIP, QUERIES, SQL

#: Results whose comparison has no SQL: they must run and give their columns.
PLAIN = sorted(set(QUERIES) - set(SQL))


def _one(x):
    if x is None or (isinstance(x, float) and x != x):
        return "NULL"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_one(r[i]) for i in order) for r in values)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    got = rows(df.columns, df.collect())
    cursor = duck.execute(SQL[name])
    assert got == rows([c[0] for c in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", PLAIN)
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert FLAGSHIP in __spark_entry__.queries()
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = spark.read.parquet(f"{small}/documents.parquet").where("lang = 'en'").select("doc_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan
    urls = QUERIES["n7_source_type"](spark, small)._jdf.queryExecution().toString()
    assert "html" not in urls.split("ReadSchema")[-1]
