"""Every query of the price-report engine against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from pumpline import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="module", autouse=True)
def one_import():
    """The queries about imports look at one import."""
    made, imported = {}, catalog._imported

    def once(spark, sf):
        if sf not in made:
            made[sf] = imported(spark, sf)
        return made[sf]

    catalog._imported = once
    yield
    catalog._imported = imported


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "NULL"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", [*catalog.NAMES, *catalog.WRITING])
def test_query(spark, duck, name):
    mine = catalog.queries()[name](spark, DIR)
    theirs = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(theirs.columns)
    assert sorted(mine.columns) == columns
    at = [theirs.columns.index(c) for c in columns]
    assert sorted(tuple(value(r[c]) for c in columns) for r in mine.collect()) == sorted(tuple(value(r[i]) for i in at) for r in theirs.fetchall())


def test_percentiles_of_a_large_group(spark, duck):
    """Of 120,000 averages in a group, some of them equal and some null, percentiles are those of the SQL, not near ones."""
    from pumpline.operators import aggregates

    entry_of = "struct<price: double>"
    rows = spark.range(120_000).selectExpr("timestamp_ntz '2024-01-01' AS day", "id % 2 AS fuel", "array_repeat(1, cast(id % 3 AS int)) AS prices", f"cast(named_struct('price', 1.0D) AS {entry_of}) AS lowestPrice", f"cast(named_struct('price', 2.0D) AS {entry_of}) AS highestPrice", "CASE WHEN id % 1001 > 0 THEN (id * 7919 % 104729) / 1000D END AS weightedAveragePrice")
    mine = aggregates.by_day_and_fuel(rows).select("fuel", "numChanges", "weightedAveragePrice", "percentiles.*").orderBy("fuel").collect()
    theirs = duck.sql("SELECT id % 2, avg(id % 3), avg(w), " + ", ".join(f"quantile_disc(w, {q})" for q in (0.5, 0.9, 0.95, 0.99)) + " FROM (SELECT id, CASE WHEN id % 1001 > 0 THEN (id * 7919 % 104729) / 1000::DOUBLE END AS w FROM range(120000) t(id)) GROUP BY 1 ORDER BY 1").fetchall()
    assert [tuple(value(x) for x in r) for r in mine] == [tuple(value(x) for x in r) for r in theirs]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert {*catalog.NAMES, *catalog.WRITING} <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
