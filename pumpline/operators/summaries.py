"""Percentiles that merge: summaries of daily averages per day, product and post code, from which any range is answered.

A group's averages in order are cut into at most RUNS runs of equal length, give or take one; a run is kept as its middle value and its length.  Groups of up
to RUNS rows are so kept exactly.  A percentile of any union of groups is off by at most half a run of each group, that is by a share of
1 / (2 * RUNS) of all ranks, and one rank for each group that isn't exact.  Summaries are kept by day, as aggregates are; a range of
days reads no daily row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pumpline.functions import lists
from pumpline.operators.aggregates import SHARES
from pumpline.operators.daily import _station_key

RUNS = 64
KEYS = ("day", "fuel", "postCode")


def summarised(daily: DataFrame, runs: int = RUNS, salts: int = 1) -> DataFrame:
    """(day, fuel, postCode, value, weight); rows whose station has no post code, or is only an id, have a null one.

    salts: groups are summarised in so many parts by station, for post codes of very many stations; the error's bound stays.
    """
    nested = daily.schema["station"].dataType.typeName() == "struct"
    code = F.col("station.address.postCode") if nested else F.lit(None).cast("string")
    rows = daily.select("day", "fuel", code.alias("postCode"), F.col("weightedAveragePrice").alias("value"), F.pmod(F.xxhash64(_station_key(daily)), F.lit(salts)).alias("salt")).filter("value is not null")
    group = Window.partitionBy(*KEYS, "salt")
    placed = rows.withColumn("n", F.count("*").over(group)).withColumn("r", F.row_number().over(group.orderBy("value")) - 1)
    run = F.floor(F.col("r") * F.least(F.lit(runs), F.col("n")) / F.col("n"))
    middle = F.get(F.array_sort(F.collect_list("value")), F.floor((F.count("*") - 1) / 2).cast("int"))
    return placed.groupBy(*KEYS, "salt", run.alias("run")).agg(middle.alias("value"), F.count("*").alias("weight")).select(*KEYS, "value", "weight")


def percentiles(summaries: DataFrame, *keys: str, shares=SHARES) -> DataFrame:
    """Percentiles of all summarised rows by key; equal values add up before rows move."""
    rows = summaries.groupBy(*keys).agg(F.percentile("value", F.array(*[F.lit(s) for s in shares]), F.col("weight")).alias("percentiles"), F.sum("weight").alias("n"))
    return rows.withColumn("percentiles", lists.named_percentiles("percentiles")) if tuple(shares) == SHARES else rows
