"""Every registered query of the delimited-text engine against its SQL."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__
from rowsmith import queries, queries_more  # noqa: F401  (registers its queries with the others)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr(tuple(float(x) if isinstance(x, decimal.Decimal) else x for x in r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sql, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = sql.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(tuple(r[i] for i in at) for r in want.fetchall())


def test_entry_registers_them():
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pruning_reaches_the_scan(spark):
    plan = queries.QUERIES["only_columns"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("n", [0, 3, 7])
def test_rows_gathered_on_the_driver_in_pieces(spark, n):
    rows = [(i, None if i == 2 else f"e{i}") for i in range(n)]
    with queries_more._Pieces(spark, "line long, error string", size=3) as seen:
        for r in rows:
            seen.add(r)
            assert len(seen.rows) < 3
    assert sorted(tuple(r) for r in seen.dataframe().collect()) == rows and seen.dataframe().dtypes == [("line", "bigint"), ("error", "string")]
