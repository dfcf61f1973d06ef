"""Data of the charts: station history, differences, extreme times, heat maps, overviews."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from pumpline.operators.daily import _station_key

DEFAULT_RANGE = (datetime(2024, 11, 1), datetime(2024, 11, 30))


def merged_filter(chart: dict, chosen: dict) -> dict:
    """The chosen filter over the chart's own; a chart with a fixed day keeps it."""
    out = {**chart, **chosen}
    if "day" in chart and not isinstance(chart["day"], tuple):
        out["day"] = chart["day"]
    return out


def filtered(rows: DataFrame, station: str | None = None, fuel: str | None = None, day=None) -> DataFrame:
    """day: one day, or the first and last of a range, both included."""
    if station is not None:
        rows = rows.filter(_station_key(rows) == station)
    if fuel is not None:
        rows = rows.filter(F.col("fuel") == fuel)
    if isinstance(day, tuple):
        rows = rows.filter(F.col("day").between(_midnight(day[0]), _midnight(day[1])))
    elif day is not None:
        rows = rows.filter(F.col("day") == _midnight(day))
    return rows


def days_of(span) -> list[date]:
    """The days of a range, given by its first and last one as dates, times or texts."""
    first, last = (datetime.fromisoformat(str(d)).date() for d in span)
    return [first + timedelta(days=i) for i in range((last - first).days + 1)]


def _midnight(d):
    return F.lit(datetime(d.year, d.month, d.day) if isinstance(d, date) else d).cast("timestamp_ntz")


def price_history(daily: DataFrame) -> DataFrame:
    return daily.select("day", "fuel", "openingPrice", "closingPrice", F.col("lowestPrice.price").alias("lowest"), F.col("highestPrice.price").alias("highest"), "weightedAveragePrice")


def price_changes(daily: DataFrame) -> DataFrame:
    return daily.select("day", "fuel", F.explode("prices").alias("p")).select("day", "fuel", "p.date", "p.price", "p.previousPrice", "p.change")


def difference_to_average(daily: DataFrame) -> DataFrame:
    """Per hour, the mean difference of reports to their day's average."""
    rows = daily.select("weightedAveragePrice", F.explode("prices").alias("p"))
    return rows.groupBy(F.hour("p.date").alias("hour")).agg(F.avg(F.col("p.price") - F.col("weightedAveragePrice")).alias("difference"), F.count("*").alias("reports"))


def extreme_times(daily: DataFrame) -> DataFrame:
    """Per hour, how often a day's lowest and highest price were reported in it."""
    side = lambda c: daily.select(F.hour(f"{c}.date").alias("hour"), F.lit(c).alias("kind"))
    count = lambda c: F.count_if(F.col("kind") == c)
    return side("lowestPrice").unionByName(side("highestPrice")).groupBy("hour").agg(count("lowestPrice").alias("cheapest"), count("highestPrice").alias("mostExpensive"))


def heat_map(daily: DataFrame, extreme: str) -> DataFrame:
    """Per day of the week and hour, how often the extreme (lowestPrice, highestPrice) was reported then."""
    at = F.col(f"{extreme}.date")
    return daily.groupBy(F.dayofweek(at).alias("weekday"), F.hour(at).alias("hour")).agg(F.count("*").alias("days"))


def day_overview(daily: DataFrame) -> DataFrame:
    """Every report of the (filtered) day and products."""
    return daily.select("fuel", F.explode("prices").alias("p")).select("fuel", "p.date", "p.price")


def aggregated_overview(aggregates: DataFrame) -> DataFrame:
    return aggregates.select("day", "fuel", "lowestPrice", "highestPrice", "weightedAveragePrice")


def aggregated_history(aggregates: DataFrame, changes: bool = True) -> DataFrame:
    rows = aggregates.select("day", "fuel", "lowestPrice", "highestPrice", "weightedAveragePrice", "numChanges", F.col("percentiles.p50").alias("median"))
    return rows if changes else rows.drop("numChanges")


def difference_to_cheapest(daily: DataFrame) -> DataFrame:
    """Each station's lowest price of a day over the day's lowest of all stations.

    The day's lowest is aggregated and joined back, so a day is never gathered in one task.
    """
    rows = daily.select(_station_key(daily).alias("station"), "day", "fuel", F.col("lowestPrice.price").alias("lowest"))
    least = rows.groupBy("day", "fuel").agg(F.min("lowest").alias("cheapest"))
    return rows.join(least, ["day", "fuel"]).select("station", "day", "fuel", (F.col("lowest") - F.col("cheapest")).alias("difference"))
