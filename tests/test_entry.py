"""The registered queries against their SQL, on the smallest tables."""

import importlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

from pricelens.session import shared_dir
from workload.queries import QUERIES

entry = importlib.import_module("__spark_entry__")


@pytest.fixture(scope="module")
def tables(sf_dir):
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_every_query_has_its_sql():
    assert QUERIES.keys() <= entry.queries().keys()
    assert QUERIES.keys() == entry.oracle_sql().keys() & QUERIES.keys()


def test_flagship(spark: SparkSession):
    assert entry.entry(spark).columns[:3] == ["brand", "retailer", "products"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, tables, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    relation = tables.execute(entry.oracle_sql()[name])
    names = [column[0] for column in relation.description]
    assert sorted(names) == columns
    places = [names.index(column) for column in columns]
    expected = [tuple(row[place] for place in places) for row in relation.fetchall()]
    got = [tuple(row) for row in df.select(*[f"`{column}`" for column in columns]).collect()]

    def key(row):
        return [(value is None, str(value)) for value in row]

    assert sorted(got, key=key) == sorted(expected, key=key)


def test_shared_dir_follows_the_cluster(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert first.startswith(base) and first != second
