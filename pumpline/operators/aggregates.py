"""Aggregates of daily rows per day and product, and per post code."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from pumpline.functions import lists
from pumpline.functions.scalars import percentile_label

SHARES = (0.5, 0.9, 0.95, 0.99)


def aggregated(daily: DataFrame, keys: list[Column], exact: bool = False) -> DataFrame:
    """Average number of reports, extremes, mean of the weighted averages and percentiles of them.

    A percentile is the least average that has at least its share of all at or below it; exact: interpolated between two averages.
    """
    w = F.col("weightedAveragePrice")
    if exact:
        rows = daily.groupBy(*keys).agg(
            F.avg(F.size("prices")).alias("numChanges"),
            F.min("lowestPrice.price").alias("lowestPrice"),
            F.max("highestPrice.price").alias("highestPrice"),
            F.avg(w).alias("weightedAveragePrice"),
            F.percentile(w, F.array(*[F.lit(s) for s in SHARES])).alias("percentiles"),
        )
    else:
        rows = _ranked(daily, keys)
    return rows.withColumn("percentiles", lists.named_percentiles("percentiles"))


def _ranked(daily: DataFrame, keys: list[Column]) -> DataFrame:
    """Equal averages of a group are counted first, so what is put in order are a group's different averages; no group is held in memory."""
    w = F.col("weightedAveragePrice")
    values = daily.groupBy(*keys, w.alias("value")).agg(
        F.count(w).alias("n"),
        F.sum(F.size("prices")).alias("changes"),
        F.count(F.size("prices")).alias("lists"),
        F.min("lowestPrice.price").alias("lowest"),
        F.max("highestPrice.price").alias("highest"),
    )
    names = [c for c in values.columns if c not in ("value", "n", "changes", "lists", "lowest", "highest")]
    group = Window.partitionBy(*names)
    upto = group.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = values.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(group))
    # In decimals: a share times a count has no error.
    at = lambda s: F.min(F.when(F.col("upto") >= F.lit(Decimal(str(s))) * F.col("all"), F.col("value")))
    return placed.groupBy(*names).agg(
        (F.sum("changes") / F.sum("lists")).alias("numChanges"),
        F.min("lowest").alias("lowestPrice"),
        F.max("highest").alias("highestPrice"),
        (F.sum(F.col("value") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("weightedAveragePrice"),
        F.array(*[at(s) for s in SHARES]).alias("percentiles"),
    )


def by_day_and_fuel(daily: DataFrame, exact: bool = False) -> DataFrame:
    return aggregated(daily, [F.col("day"), F.col("fuel")], exact)


def by_post_code(daily: DataFrame, exact: bool = False) -> DataFrame:
    return aggregated(daily, [F.col("day"), F.col("fuel"), F.col("station.address.postCode").alias("postCode")], exact)


def of_daily(daily: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Daily rows with their day's aggregate, null where there is none, and the label of their average in it."""
    one = aggregates.select("day", "fuel", F.struct(*[c for c in aggregates.columns if c not in ("day", "fuel")]).alias("aggregate"))
    rows = daily.join(one, ["day", "fuel"], "left")
    return rows.withColumn("percentile", F.when(F.col("aggregate").isNotNull(), percentile_label("weightedAveragePrice", "aggregate.percentiles")))


def latest_compound(aggregates: DataFrame, fuels) -> DataFrame:
    """One row: the latest day, and a column per product with that day's aggregate; no row for an empty table."""
    last = aggregates.agg(F.max("day").alias("last"))
    rows = aggregates.join(F.broadcast(last), aggregates["day"] == last["last"]).drop("last")  # the broadcast side is one row
    value = F.struct(*[c for c in aggregates.columns if c not in ("day", "fuel")])
    return rows.groupBy("day").pivot("fuel", list(fuels)).agg(F.first(value))
