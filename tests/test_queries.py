"""Every query with an SQL counterpart gives the same rows in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()
# Queries of the training-data operators are checked in their own tests.
OPTIONAL = {q for q in contract.queries() if q not in contract.QUERIES}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return connection


def rows(table, columns):
    return sorted(repr(tuple(r.values())) for r in table.select(columns).to_pylist())


def test_every_query_has_sql():
    assert set(contract.queries()) - OPTIONAL == set(contract.oracle_sql()) - OPTIONAL


@pytest.mark.parametrize("name", sorted(set(contract.oracle_sql()) - OPTIONAL))
def test_same_rows_and_types_as_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got, want = df.toArrow(), duck.sql(contract.oracle_sql()[name]).to_arrow_table()
    assert sorted(want.column_names) == columns
    assert got.num_rows == want.num_rows
    assert rows(got, columns) == rows(want, columns)
    for column in columns:
        assert got.schema.field(column).type == want.schema.field(column).type, column


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() == 1500 and df.columns == ["Customer_ID", "loan_id", "prediction_date", "label"]
