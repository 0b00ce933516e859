"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, normal

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(entry.queries()))
def test_query(spark, duck, key):
    df = entry.queries()[key](spark, FOLDER)
    columns = sorted(df.columns)
    mine = sorted(tuple(normal(row[c]) for c in columns) for row in df.collect())
    sql = entry.oracle_sql().get(key)
    if sql is None:
        assert mine
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert mine == sorted(tuple(normal(row[p]) for p in places) for row in cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_source_lists_of_a_large_nation_are_many_rows(spark):
    import json

    from pyspark.sql import functions as F

    from marketloom.plans.text_queries import source_lists
    from marketloom.session import scratch_path
    from marketloom.sources import tables

    raw = spark.range(2500).select(
        F.col("id").cast("string").alias("id"), F.lit("x").alias("company_name"), F.lit(True).alias("enabled"),
        F.lit(3).alias("nation"), F.floor(F.col("id") / 1000).alias("dump"),
    )
    rows = [json.loads(r.value) for r in source_lists(raw).collect()]
    assert max(map(len, rows)) <= 1000 and sum(map(len, rows)) == 2500
    path = scratch_path(spark, "lists")
    source_lists(raw).write.partitionBy("nation", "dump").text(path)
    assert tables.source_list(spark, path).select("id").distinct().count() == 2500
