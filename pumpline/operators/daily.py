"""From single reports to one row per station, product and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pumpline.functions import lists
from pumpline.functions.scalars import day_of, digest

KEY = ("station", "fuel", "day")


def grouped(reports: DataFrame, colocate: bool = True, zone: str | None = None) -> DataFrame:
    """A row per station, product and day with the list of its reports.

    colocate deals reports by station and product, so that the windows over days that follow need no second
    shuffle; without it, days of a station that holds much of all reports are spread over tasks.
    """
    dealt = reports.repartition("station", "fuel") if colocate else reports
    rows = dealt.withColumn("day", day_of("date", zone))
    return rows.groupBy("station", "day", "fuel").agg(F.collect_list(F.struct("id", "date", "price")).alias("prices"))


def reshaped(groups: DataFrame) -> DataFrame:
    """Lists in order of date and of price."""
    return groups.select("station", "day", "fuel", lists.by_date("prices").alias("prices"), lists.by_price("prices").alias("pricesByPrice"))


def with_extremes(rows: DataFrame) -> DataFrame:
    """Closing, lowest and highest price from the two lists; the list by price goes."""
    at = lambda i: F.try_element_at(F.col("pricesByPrice"), F.lit(i))
    return rows.withColumns({"closingPrice": lists.closing("prices"), "lowestPrice": at(1), "highestPrice": at(-1)}).drop("pricesByPrice")


def with_station(rows: DataFrame, stations: DataFrame) -> DataFrame:
    """Rows of known stations, with a part of the station; rows of unknown ones go.

    The stations' side is broadcast where its size allows, by the session's threshold and at run time.
    """
    part = stations.select(
        F.col("id").alias("known"),
        F.struct("id", "name", "brand", "location", F.struct(F.col("address.postCode").alias("postCode")).alias("address")).alias("part"),
    )
    return rows.join(part, rows["station"] == part["known"]).drop("station", "known").withColumnRenamed("part", "station")


def by_day(reports: DataFrame, stations: DataFrame | None = None, colocate: bool = True, zone: str | None = None) -> DataFrame:
    """Daily rows with their extremes and the list with previous prices within the day."""
    rows = with_id(with_extremes(reshaped(grouped(reports, colocate, zone))))
    if stations is not None:
        rows = with_station(rows, stations)
    return rows.withColumn("prices", lists.with_previous("prices"))


def with_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id", digest(_station_key(rows), "fuel", F.col("day").cast("string")))


def completed(rows: DataFrame) -> DataFrame:
    """Daily rows of lists in order of date and opening prices: all else follows from these, so only these need to move."""
    rows = with_extremes(rows.withColumn("pricesByPrice", lists.by_price("prices")))
    return with_averages(with_id(rows).withColumn("prices", lists.with_previous("prices")))


def _station_key(rows: DataFrame) -> Column:
    return F.col("station.id") if rows.schema["station"].dataType.typeName() == "struct" else F.col("station")


def with_opening(rows: DataFrame, colocate: bool = True) -> DataFrame:
    """The opening price: the closing price of the latest earlier day that the station has for the product.

    Without colocate, only keys and closing prices are dealt, by station, product and month; lists stay where they are.
    """
    if colocate:
        days = Window.partitionBy(_station_key(rows), "fuel").orderBy("day")
        return rows.withColumn("openingPrice", F.lag("closingPrice").over(days))
    keys = rows.select(_station_key(rows).alias("station"), "fuel", "day", "closingPrice")
    narrow = opening_as_of(keys.drop("closingPrice"), keys, spread=True).withColumnRenamed("station", "of")
    a, b = rows.alias("a"), narrow.alias("b")
    station = F.col("a.station.id") if rows.schema["station"].dataType.typeName() == "struct" else F.col("a.station")
    joined = a.join(b, (station == F.col("b.of")) & (F.col("a.fuel") == F.col("b.fuel")) & (F.col("a.day") == F.col("b.day")))
    return joined.select("a.*", "b.openingPrice")


def opening_as_of(probes: DataFrame, known: DataFrame, spread: bool = False) -> DataFrame:
    """Opening prices of probes (station, fuel, day) from another table's closing prices, strictly earlier days only.

    The two are put in one order; a probe takes the last closing price before it.  No pairs are made.  spread deals them by
    month as well, for a station that holds much of all rows: a month's last closing price goes on to the next months that have
    probes, so only one row a month of a station and product meets in one task.
    """
    cols = ["station", "fuel", "day"]
    both = probes.select(*cols, F.lit(None).cast("double").alias("closingPrice"), F.lit(0).alias("kind")).unionByName(known.select(*cols, "closingPrice", F.lit(1).alias("kind")))
    last = lambda keys, day: F.last("closingPrice", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(day, "kind").rowsBetween(Window.unboundedPreceding, -1))
    if not spread:
        return both.withColumn("openingPrice", last(cols[:2], "day")).filter("kind = 0").select(*cols, "openingPrice")
    both = both.withColumn("month", F.date_trunc("month", "day"))
    keys = ["station", "fuel", "month"]
    within = both.withColumn("inMonth", last(keys, "day")).filter("kind = 0").select(*cols, "month", "inMonth")
    closing = F.max_by("closingPrice", F.when(F.col("closingPrice").isNotNull(), F.col("day")))
    months = both.groupBy(*keys).agg(closing.alias("closingPrice"), F.min("kind").alias("kind"))
    before = Window.partitionBy("station", "fuel").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    carried = months.withColumn("carried", F.last("closingPrice", ignorenulls=True).over(before)).filter("kind = 0").select(*keys, "carried")
    return within.join(carried, keys).select(*cols, F.coalesce("inMonth", "carried").alias("openingPrice"))


def missing_opening(rows: DataFrame) -> DataFrame:
    """Rows whose opening price was never looked for: openingPriceKnown tells these from known nulls."""
    known = F.col("openingPriceKnown") if "openingPriceKnown" in rows.columns else F.col("openingPrice").isNotNull()
    return rows.filter(~F.coalesce(known, F.lit(False)))


def priced(rows: DataFrame, colocate: bool = True) -> DataFrame:
    """Opening price, previous prices, changes and the day's weighted average."""
    return with_averages(with_opening(rows, colocate))


def with_averages(rows: DataFrame) -> DataFrame:
    """Previous prices, changes and the day's weighted average of rows that have their opening price."""
    rows = rows.withColumn("prices", lists.with_change(lists.with_opening("prices", "openingPrice")))
    return rows.withColumn("weightedAveragePrice", lists.weighted_average("prices", "day", "openingPrice"))


def daily_prices(reports: DataFrame, stations: DataFrame | None = None, colocate: bool = True, zone: str | None = None) -> DataFrame:
    """All of it: reports to complete daily rows."""
    rows = priced(by_day(reports, stations, colocate, zone), colocate)
    return rows.select("id", "day", "fuel", "station", "prices", "openingPrice", "closingPrice", "lowestPrice", "highestPrice", "weightedAveragePrice")
