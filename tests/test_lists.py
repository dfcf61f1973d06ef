"""Price lists: averages, extremes, previous prices, changes, single appended reports."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pumpline.functions import lists

PRICES = "array<struct<id: string, date: timestamp_ntz, price: double>>"
DAY = datetime(2024, 11, 15)
TIE = [("81450", datetime(2024, 1, 25, 10, 27, 0, 171323), 9.46), ("82004", datetime(2024, 1, 25, 14, 25, 0, 170638), 93.01)]


def entry(hour, price, id_="a"):
    return (id_, datetime(2024, 11, 15, hour), price)


@pytest.mark.parametrize(
    ("opening", "prices", "expected"),
    [
        (1.234, [entry(1, 1.234)], 1.234),
        (None, [entry(1, 1.234)], 1.234),
        (1.236, [entry(12, 1.234)], 1.235),
        (1.230, [entry(6, 1.232), entry(12, 1.234), entry(18, 1.236)], 1.233),
    ],
)
def test_weighted_average(spark, opening, prices, expected):
    df = spark.createDataFrame([(DAY, opening, prices)], f"day timestamp_ntz, opening double, prices {PRICES}")
    row = df.select(lists.weighted_average("prices", "day", "opening").alias("w"), lists.validity("prices", "day", "opening").alias("s")).collect()[0]
    assert row.w == expected
    assert sum((s.until - s.start).total_seconds() for s in row.s) == 86400


def test_average_at_half_a_unit(spark):
    """A day of sf0.1 whose average is 50.7335 but for the order of additions: the segment from midnight comes last."""
    day = datetime(2024, 1, 25)
    df = spark.createDataFrame([(day, 27.63, TIE), (day, None, [])], f"day timestamp_ntz, opening double, prices {PRICES}")
    assert [r.w for r in df.select(lists.weighted_average("prices", "day", "opening").alias("w")).collect()] == [50.733, None]
    values = spark.createDataFrame([(2.0125,), (16.1255,), (None,)], "x double").select(lists.rounded("x", 3).alias("x")).collect()
    assert [r.x for r in values] == [round(2.0125 * 1000) / 1000, round(16.1255 * 1000) / 1000, None]


def test_extremes_and_ties(spark):
    day = [("1", datetime(2025, 6, 27, 0), 2.0), ("2", datetime(2025, 6, 27, 1), 1.0), ("3", datetime(2025, 6, 27, 2), 3.0), ("4", datetime(2025, 6, 27, 3), 3.0), ("5", datetime(2025, 6, 27, 4), 1.0)]
    df = spark.createDataFrame([(day,)], f"prices {PRICES}")
    row = df.select(lists.closing("prices").alias("c"), lists.lowest("prices").alias("l"), lists.highest("prices").alias("h"), lists.highest("prices", earliest=True).alias("e")).collect()[0]
    assert (row.c, row.l.id, row.h.id, row.e.id) == (1.0, "2", "4", "3")


def test_without_last(spark):
    df = spark.createDataFrame([([0, 1, 2, 3], ["foo", "bar", "baz"], [])], "a array<int>, b array<string>, c array<int>")
    row = df.select(*[lists.without_last(c).alias(c) for c in "abc"]).collect()[0]
    assert (row.a, row.b, row.c) == ([0, 1, 2], ["foo", "bar"], [])


def test_previous_and_change(spark):
    df = spark.createDataFrame([([entry(1, 1.5), entry(2, 1.25)], 1.0), ([entry(1, 1.5)], None)], f"prices {PRICES}, opening double")
    rows = df.select(lists.with_change(lists.with_opening(lists.with_previous("prices"), "opening")).alias("p"), lists.shifted("prices").alias("s")).collect()
    assert [(p.previousPrice, p.change) for p in rows[0].p] == [(1.0, 0.5), (1.5, -0.25)]
    assert rows[0].s == [None, 1.5]
    assert [(p.previousPrice, p.change) for p in rows[1].p] == [(None, None)]


def test_half_even_and_second_boundaries(spark):
    df = spark.createDataFrame([(1.2345, datetime(2024, 1, 1, 0, 0, 0, 900000), datetime(2024, 1, 1, 0, 0, 2, 100000))], "x double, a timestamp_ntz, b timestamp_ntz")
    row = df.select(lists.rounded("x", 3).alias("x"), lists.seconds_between("a", "b").alias("s")).collect()[0]
    assert (row.x, row.s) == (1.234, 2)


def test_latest_list(spark):
    schema = "list array<struct<day: int, v: string>>, new struct<day: int, v: string>"
    df = spark.createDataFrame([([(3, "c"), (2, "b")], (2, "x")), (None, (1, "y"))], schema)
    rows = [r.l for r in df.select(lists.latest_of("list", "new").alias("l")).collect()]
    assert [[(e.day, e.v) for e in r] for r in rows] == [[(3, "c"), (2, "x")], [(1, "y")]]
    df = spark.createDataFrame([([(i, "o") for i in range(40)], (50, "n"))], schema)
    row = df.select(F.size(lists.latest_of("list", "new")).alias("a"), F.size(lists.latest_of("list", "new", None)).alias("b")).collect()[0]
    assert (row.a, row.b) == (30, 41)
