"""Latest daily rows per station and product."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pumpline.operators.daily import _station_key

DEPTH = 30


def embedded(daily: DataFrame):
    """A daily row without its station, as stations carry it."""
    return F.struct(*[c for c in daily.columns if c not in ("station", "station_id")])


def ranked(daily: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The latest rows per station and product with their rank; rows beyond the depth don't reach the shuffle."""
    order = Window.partitionBy("station_id", "fuel").orderBy(F.desc("day"), "id")
    rows = daily.withColumn("station_id", _station_key(daily))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)


def latest(daily: DataFrame) -> DataFrame:
    return ranked(daily, 1).drop("rank")


def per_station(daily: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Per station its latest row of each product and the list of the latest ones, as maps by product."""
    rows = ranked(daily, depth)
    value = F.struct(*[c for c in daily.columns if c != "station"])
    fuels = rows.select("station_id", "fuel", "rank", value.alias("value")).groupBy("station_id", "fuel").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("list"))
    fuels = fuels.withColumn("list", F.transform("list", lambda x: x["value"]))
    return fuels.groupBy("station_id").agg(
        F.map_from_entries(F.collect_list(F.struct("fuel", F.get("list", F.lit(0))))).alias("latestPrice"),
        F.map_from_entries(F.collect_list(F.struct("fuel", "list"))).alias("latestPrices"),
    ).withColumnRenamed("station_id", "id")


def of_station(daily: DataFrame, station: str, count: int = 3) -> DataFrame:
    """A station's latest rows over all products; a day's rows by product."""
    return daily.filter(_station_key(daily) == station).orderBy(F.desc("day"), "fuel").limit(count)


def last_days(daily: DataFrame, station: str, fuel: str, count: int = DEPTH) -> DataFrame:
    """A station's latest rows of one product: rows, not calendar days."""
    return daily.filter((_station_key(daily) == station) & (F.col("fuel") == fuel)).orderBy(F.desc("day")).limit(count)


def last_days_diesel(daily: DataFrame, station: str) -> DataFrame:
    return last_days(daily, station, "diesel")


def last_days_e5(daily: DataFrame, station: str) -> DataFrame:
    return last_days(daily, station, "e5")


def last_days_e10(daily: DataFrame, station: str) -> DataFrame:
    return last_days(daily, station, "e10")
