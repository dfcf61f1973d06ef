"""The batch commands: importing reports and stations, and keeping the aggregates up."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from pumpline import schemas
from pumpline.functions import lists
from pumpline.operators import aggregates, daily, stations, summaries
from pumpline.sources import csv
from pumpline.sources.closings import Closings
from pumpline.sources.store import ImportResult, PartTable, Store, merge_fields, replace_matching, result_of, upsert_stations
from pumpline.streaming import incremental

STAGES = ("staged_rows", "staged_reports", "staged_days")


def measured(name: str, step, log=print):
    began = time.time()
    out = step()
    log(f"{name}: {time.time() - began:.1f} s")
    return out


def staged_rows(spark: SparkSession, store: Store, paths, schema: str) -> tuple[DataFrame, int]:
    """The files' rows as a staged table, malformed ones in the table `quarantine` by file; how many these are is counted while they are written."""
    seen = Observation()
    rows = csv.read_csv(spark, paths, schema, quarantine=True)
    rows = store.write("staged_rows", rows.observe(seen, F.count_if(F.col("bad").isNotNull()).alias("failed")))
    failed = 0 if rows.isEmpty() else int(seen.get["failed"])  # nothing is observed where there is nothing
    if failed:
        kind = "stations" if "uuid" in rows.columns else "reports"
        bad = rows.filter("bad is not null").select("file", "bad", F.lit(kind).alias("kind"))
        PartTable(store, "quarantine", F.col("kind")).append(bad)
    return rows.filter("bad is null").drop("bad"), failed


def import_stations(spark: SparkSession, store: Store, paths, clear: bool = False, strict: bool = False) -> ImportResult:
    """Stations of files in place of stored ones; of several rows of a station the last one of the last file counts."""
    if clear:
        store.clear("stations")
    rows, failed = staged_rows(spark, store, paths, schemas.STATION_CSV)
    # Rows of a file that was split come in order of their partitions.
    last = Window.partitionBy("id").orderBy(F.desc("file"), F.desc("place"))
    new = csv.stations(rows).withColumn("place", F.monotonically_increasing_id()).withColumn("n", F.row_number().over(last)).filter("n = 1").drop("n", "place", "file")
    old = store.read("stations", schemas.STATION)
    result = result_of(old, new, ["id"], ["name", "brand", "address", "location"])
    store.write("stations", upsert_stations(old, new, strict))
    store.drop("staged_rows")
    return result + ImportResult(failed=failed)


def import_reports(spark: SparkSession, store: Store, paths=(), recover: bool = False, clear: bool = False, fuels=schemas.FUELS, log=lambda _: None) -> ImportResult:
    """Reports to daily rows, aggregates and the stations' latest prices.

    Each step's rows are a staged table; `recover` goes on from the newest one that a broken run has left.  Days that
    are there already stay: new rows are appended to their days' parts, of which only keys are read, and closing prices of earlier
    imports come from their index.  Counted are reports: those of days that are new, and as skipped those of days that stay as they
    were, or whose station is unknown; malformed rows of files are counted as failed.  The results of each file are in `import_results`.
    """
    table = store.by_day("daily")
    if clear:
        for t in (table, Closings(store).days, Closings(store).months, store.by_day("aggregates"), store.by_day("summaries"), store.by_bucket("latest", "id")):
            t.clear()
    left = [s for s in STAGES if store.exists(s)] if recover else []
    result, failed = ImportResult(), 0
    if not left and paths:
        _, failed = measured("rows", lambda: staged_rows(spark, store, paths, schemas.report_csv(fuels)), log)
        left = ["staged_rows"]
    if left and left[-1] == "staged_rows":
        rows = store.read("staged_rows").filter("bad is null")
        measured("reports", lambda: store.write("staged_reports", csv.reports(rows, fuels)), log)
        left.append("staged_reports")
    if left and left[-1] == "staged_reports":
        measured("days", lambda: store.write("staged_days", _lists_of(store)), log)
        left.append("staged_days")
    if left:
        days = store.read("staged_days")
        marked = store.write("staged_new", _marked(store, table, days))
        new = marked.filter("is_new").select("station", "fuel", "day", "prices", "openingPrice")
        came, given = Observation(), F.count(F.lit(1)).alias("n")
        parts = measured("daily", lambda: table.append(new.observe(came, F.coalesce(F.sum(F.size("prices")), F.lit(0)).alias("n")), _completed), log)
        # Of all staged days, so that a run that broke off behind the append is made up for.
        Closings(store).put(marked.select(F.col("station.id").alias("station"), "fuel", "day", "closingPrice"))
        came = int(came.get["n"]) if parts else 0  # nothing is observed where there is nothing
        if store.exists("staged_reports"):
            of_files = _of_files(store, new)
            result = ImportResult(came, store.read("staged_reports").agg(given).collect()[0]["n"] - came, failed=failed)
            PartTable(store, "import_results", F.lit("files")).append(of_files)
        else:
            result = ImportResult(came, days.agg(F.coalesce(F.sum(F.size("prices")), F.lit(0)).alias("n")).collect()[0]["n"] - came, failed=failed)
        for stage in (*STAGES, "staged_new"):
            store.drop(stage)
        table.compact()
    if table.exists():
        measured("aggregates", lambda: keep_aggregates(store), log)
        measured("latest", lambda: refresh_stations(store), log)
    return result


def _of_files(store: Store, new: DataFrame) -> DataFrame:
    """(file, inserted, skipped, failed): a file's reports whose day came in or not, and its malformed rows."""
    reports = store.read("staged_reports")
    if "file" not in reports.columns:
        return store.spark.createDataFrame([], "file string, inserted bigint, skipped bigint, failed bigint")
    counts = reports.groupBy("file", "station", "fuel", daily.day_of("date").alias("day")).agg(F.count("*").alias("n"))
    came = new.select(F.col("station.id").alias("station"), "fuel", "day", F.lit(True).alias("came"))
    counts = counts.join(came, ["station", "fuel", "day"], "left").groupBy("file").agg(F.sum(F.when(F.col("came"), F.col("n")).otherwise(0)).alias("inserted"), F.sum(F.when(F.col("came"), 0).otherwise(F.col("n"))).alias("skipped"))
    if not store.exists("staged_rows"):
        return counts.withColumn("failed", F.lit(0).cast("bigint"))
    failed = store.read("staged_rows").groupBy("file").agg(F.count("bad").alias("failed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return failed.join(counts, "file", "left").select("file", zero("inserted"), zero("skipped"), "failed")


def _lists_of(store: Store) -> DataFrame:
    """(station, fuel, day, prices): lists in order of date of the staged reports of known stations.

    Reports are dealt by station, for the stations' join and the grouping; or, where the stations' ids are few, by group.
    """
    known = store.read("stations", schemas.STATION).select(F.col("id").alias("station"))
    rows = store.read("staged_reports").select("id", "date", "station", "fuel", "price").join(known, "station", "left_semi")
    return daily.grouped(rows, colocate=False).select("station", "fuel", "day", lists.by_date("prices").alias("prices"))


def _marked(store: Store, table: PartTable, days: DataFrame) -> DataFrame:
    """Staged days with their station, opening price and `is_new`; those that are stored already have the stored closing price and no list.

    Staged days, the stored ones of the same days and the index's closing prices of other days are put in one order, so lists move once.
    """
    touched = [r[0] for r in days.select(table.part).distinct().collect()]  # as many as the files have days
    cols = ["station", "fuel", "day", "closingPrice"]
    rows = days.withColumn("closingPrice", lists.closing("prices")).withColumn("kind", F.lit(2))
    if table.exists():
        stored = table.read(touched).select(F.col("station_id").alias("station"), *cols[1:], F.lit(1).alias("kind"))
        others = Closings(store).touched(days).filter(~table.part.isin(touched)).select(*cols, F.lit(0).alias("kind"))
        rows = rows.unionByName(stored.unionByName(others), allowMissingColumns=True)
    order = Window.partitionBy("station", "fuel").orderBy("day", "kind")
    before = lambda c: F.lag(c).over(order)
    is_new = (F.col("kind") == 2) & ~F.coalesce((before("day") == F.col("day")) & (before("kind") == 1), F.lit(False))
    rows = rows.repartition("station").withColumn("is_new", is_new).withColumn("stored", before("closingPrice"))
    rows = rows.withColumn("closingPrice", F.when((F.col("kind") < 2) | F.col("is_new"), F.col("closingPrice")))
    earlier = F.last("closingPrice", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("openingPrice", earlier).filter("kind = 2")
    rows = rows.withColumn("closingPrice", F.when(F.col("is_new"), F.col("closingPrice")).otherwise(F.col("stored")))
    rows = rows.select(*cols, F.when(F.col("is_new"), F.col("prices")).alias("prices"), F.when(F.col("is_new"), F.col("openingPrice")).alias("openingPrice"), "is_new")
    return daily.with_station(rows, store.read("stations", schemas.STATION))


def _completed(rows: DataFrame) -> DataFrame:
    return daily.completed(rows).withColumn("station_id", F.col("station.id")).withColumn("openingPriceKnown", F.lit(True))


def openings_repaired(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Daily rows whose opening price was never looked for with that of the latest earlier day; known nulls and all else stay.

    known: closing prices (station, fuel, day, closingPrice) to look in, else those of the rows.  Only keys, closing prices and
    the found opening prices move; lists and averages stay as they are.
    """
    station = daily._station_key(rows)
    flat = rows.select(station.alias("station"), "fuel", "day", "closingPrice") if known is None else known
    lacking = daily.missing_opening(rows).select(station.alias("station"), "fuel", "day")
    found = daily.opening_as_of(lacking, flat).select("station", "fuel", "day", F.col("openingPrice").alias("found"), F.lit(True).alias("looked")).dropDuplicates(["station", "fuel", "day"])
    a, b = rows.withColumn("repair_station", station).alias("a"), found.alias("b")
    joined = a.join(b, (F.col("a.repair_station") == F.col("b.station")) & (F.col("a.fuel") == F.col("b.fuel")) & (F.col("a.day") == F.col("b.day")), "left")
    known_ = F.col("a.openingPriceKnown") if "openingPriceKnown" in rows.columns else F.col("a.openingPrice").isNotNull()
    opening = F.when(F.col("b.looked"), F.col("b.found")).otherwise(F.col("a.openingPrice"))
    return joined.select(*[opening.alias(c) if c == "openingPrice" else F.col(f"a.{c}") for c in rows.columns if c != "openingPriceKnown"], (known_ | F.coalesce("b.looked", F.lit(False))).alias("openingPriceKnown"))


def repair_openings(store: Store) -> list[str]:
    """Opening prices of stored rows that never had one looked for; reads the index of closing prices, and writes days with such rows only."""
    table = store.by_day("daily")
    lacking = daily.missing_opening(table.read())
    days = sorted(r[0] for r in lacking.select(table.part).distinct().collect())
    if not days:
        return []
    rows = table.read(days)
    keys = daily.missing_opening(rows).select(daily._station_key(rows).alias("station"), "fuel", "day")
    return table.replace(openings_repaired(rows, Closings(store).around(keys)))


def toggle_favourite(store: Store, station: str) -> bool:
    """Turns a stored station's favourite flag and returns what it is now."""
    return stations.one(store.write("stations", stations.toggled(store.read("stations", schemas.STATION), station.lower())), station).collect()[0]["favorite"]


def keep_aggregates(store: Store) -> list[str]:
    """Aggregates of the days that changed since they were made last, in place of those of the same days; the days.

    The table notes the commit of the daily rows that it was made from, so a run that broke off is made up for by the next.
    """
    rows, table = store.by_day("daily"), store.by_day("aggregates")
    number, seen = rows.manifest().number, table.manifest().seen.get("daily", 0)
    days = rows.changed_since(seen)
    gone = sorted(set(table.parts()) - set(rows.parts()))
    if days or gone:
        table.replace(aggregates.by_day_and_fuel(rows.read(days)), of=[*days, *gone], seen={"daily": number})
    return days


def keep_summaries(store: Store) -> list[str]:
    """Percentile summaries of the days that changed since they were made last; as `keep_aggregates`."""
    rows, table = store.by_day("daily"), store.by_day("summaries")
    number, seen = rows.manifest().number, table.manifest().seen.get("daily", 0)
    days = rows.changed_since(seen)
    gone = sorted(set(table.parts()) - set(rows.parts()))
    if days or gone:
        table.replace(summaries.summarised(rows.read(days)), of=[*days, *gone], seen={"daily": number})
    return days


def recompute_aggregates(store: Store) -> None:
    """Aggregates of all daily rows in place of those of the same day and product."""
    rows, table = store.by_day("daily"), store.by_day("aggregates")
    new = aggregates.by_day_and_fuel(rows.read())
    old = table.read() if table.exists() else new.limit(0)
    table.replace(replace_matching(old.select(*new.columns), new, ["day", "fuel"]), seen={"daily": rows.manifest().number})


def keep_latest(store: Store) -> list[str]:
    """The lists of latest rows of stations that have rows on days that changed since they were made last; the days.

    Rows of changed days take their places in the lists; lists of other stations aren't read.
    """
    rows, lists = store.by_day("daily"), store.by_bucket("latest", "id")
    number, seen = rows.manifest().number, lists.manifest().seen.get("daily", 0)
    days = rows.changed_since(seen)
    if not days:
        return []
    changed = rows.read(days)
    changed = changed.withColumn("station", daily._station_key(changed)).drop("station_id")
    incremental.put_lists(store, changed, seen={"daily": number})
    return days


def refresh_stations(store: Store) -> None:
    """The stations' latest prices: those of the lists that follow changed days; a station without a list has none."""
    keep_latest(store)
    new = store.by_bucket("latest", "id").read(schema="id string")
    known = store.read("stations", schemas.STATION).drop("latestPrice", "latestPrices")
    rows = merge_fields(known, new.drop("latestPrice"), ["id"])
    if "latestPrices" in rows.columns:
        rows = rows.withColumn("latestPrice", incremental.firsts("latestPrices"))
    store.write("stations", rows)
