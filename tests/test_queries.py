"""Every registered query against its SQL, value by value, on whole tables."""

import datetime as dt
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
ORACLE = contract.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    yield con
    con.close()


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def comparable(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date",
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, oracle, name):
    df = contract.queries()[name](spark, FOLDER)
    cursor = oracle.execute(ORACLE[name])
    expected_types = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in cursor.description}
    expected = comparable([d[0] for d in cursor.description], cursor.fetchall())
    got = comparable(df.columns, df.collect())
    assert sorted(df.columns) == sorted(expected_types)
    assert len(got) == len(expected)
    assert got == expected
    assert len(got) > 0
    assert {f.name: f.dataType.simpleString() for f in df.schema.fields} == expected_types


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    rows = contract.queries()[name](spark, FOLDER).collect()
    assert rows
    if name == "file_checksums":
        assert {r["status"] for r in rows} == {"MATCH"} and len(rows) == len(TABLES)


def test_entry(spark):
    assert contract.entry(spark).first()["status"] == "FAIL"
