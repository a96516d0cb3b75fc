"""Every query of the core against its SQL, on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from gradeveil.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "array<string>": "VARCHAR[]"}


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "asDict"):
        value = tuple(value)
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, database, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = Counter(plain(tuple(r)) for r in got.select(*columns).collect())
    if name in registry.ORACLE_SQL:
        quoted = ", ".join(f'"{c}"' for c in columns)
        relation = database.sql(registry.ORACLE_SQL[name])
        assert {f.name: TYPES[f.dataType.simpleString()] for f in got.schema} == dict(zip(relation.columns, map(str, relation.types), strict=True))
        expected = database.sql(f"SELECT {quoted} FROM ({registry.ORACLE_SQL[name]})").fetchall()
        assert rows == Counter(map(plain, expected))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
