"""Queries of the price-report engine over the star-schema test tables, and their SQL, by name.

Nested results are flattened so that they compare column by column; averages are rounded to 6 digits because the order
of additions differs.  The SQL is flat - windows over single reports - and so formulates each result independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pumpline.functions import lists, scalars
from pumpline import schemas
from pumpline.operators import aggregates, charts, daily, latest, listing, prefixes, stations, summaries
from pumpline.plans import domain, imports
from pumpline.sources import csv, inline, scratch, store
from pumpline.streaming import incremental

STATION, FUEL = "7", "view"
DAY = "2024-01-15"
RANGE = ("2024-01-05", "2024-01-20")
#: When reports begin to come in live, and when the first of two imports ends.
LIVE, NOON = "2024-01-15 12:00:00", "2024-01-10 12:00:00"
#: Files of a stream's batch.
FILES = 4
#: Buckets of stations in the queries' stores.
BUCKETS = 8


def _days(spark, sf) -> DataFrame:
    return daily.daily_prices(domain.reports(spark, sf))


def _days_of_stations(spark, sf) -> DataFrame:
    return daily.daily_prices(domain.reports(spark, sf), domain.stations(spark, sf))


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("station", "fuel", "day", F.size("prices").alias("n"), "openingPrice", "closingPrice", F.col("lowestPrice.price").alias("lowest"), F.col("highestPrice.price").alias("highest"), F.col("weightedAveragePrice").alias("average"))


def _entries(rows: DataFrame) -> DataFrame:
    return rows.select("station", "fuel", "day", F.explode("prices").alias("p"))


def _rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in columns})


def report_filter(spark, sf):
    return domain.reports(spark, sf)


def daily_group(spark, sf):
    rows = daily.reshaped(daily.grouped(domain.reports(spark, sf)))
    return rows.select("station", "fuel", "day", F.posexplode("prices").alias("position", "p")).select("station", "fuel", "day", "position", "p.id", "p.date", "p.price")


def daily_by_price(spark, sf):
    rows = daily.reshaped(daily.grouped(domain.reports(spark, sf)))
    return rows.select("station", "fuel", "day", F.posexplode("pricesByPrice").alias("position", "p")).select("station", "fuel", "day", "position", "p.id", "p.price")


def daily_extremes(spark, sf):
    rows = daily.by_day(domain.reports(spark, sf))
    return rows.select("station", "fuel", "day", "closingPrice", F.col("lowestPrice.id").alias("lowest_id"), F.col("lowestPrice.price").alias("lowest"), F.col("highestPrice.id").alias("highest_id"), F.col("highestPrice.price").alias("highest"))


def exclude_last(spark, sf):
    rows = daily.reshaped(daily.grouped(domain.reports(spark, sf)))
    return rows.select("station", "fuel", "day", F.size(lists.without_last("prices")).alias("left"), lists.closing(lists.without_last("prices")).alias("last_left"))


def price_list_previous(spark, sf):
    rows = daily.by_day(domain.reports(spark, sf))
    return _entries(rows).select("station", "fuel", "day", "p.id", "p.price", "p.previousPrice")


def price_change(spark, sf):
    return _entries(_days(spark, sf)).select("station", "fuel", "day", "p.id", "p.price", "p.previousPrice", "p.change")


def previous_flat(spark, sf):
    w = Window.partitionBy("station", "fuel", F.to_date("date")).orderBy("date", "id")
    return domain.reports(spark, sf).select("id", "price", F.lag("price").over(w).alias("previousPrice"))


def validity_segments(spark, sf):
    rows = _days(spark, sf).select("station", "fuel", "day", F.explode(lists.validity("prices", "day", "openingPrice")).alias("s"))
    return rows.select("station", "fuel", "day", "s.start", "s.until", "s.price", lists.seconds_between("s.start", "s.until").alias("seconds"))


def weighted_average(spark, sf):
    return _days(spark, sf).select("station", "fuel", "day", F.col("weightedAveragePrice").alias("average"))


def opening_price_lag(spark, sf):
    return _days(spark, sf).select("station", "fuel", "day", "openingPrice", "closingPrice")


def opening_price_asof(spark, sf):
    rows = daily.by_day(domain.reports(spark, sf))
    return daily.opening_as_of(rows.select("station", "fuel", "day"), rows)


def missing_opening(spark, sf):
    return daily.missing_opening(_days(spark, sf)).select("station", "fuel", "day", "closingPrice")


def daily_prices(spark, sf):
    return _flat(_days(spark, sf))


def station_join(spark, sf):
    rows = daily.by_day(domain.reports(spark, sf), domain.stations(spark, sf).filter("id <> '7'"))
    return rows.select(F.col("station.id").alias("station"), F.col("station.name").alias("name"), F.col("station.brand").alias("brand"), F.col("station.address.postCode").alias("postCode"), "fuel", "day", "closingPrice")


def _flat_aggregate(rows: DataFrame) -> DataFrame:
    flat = rows.select(*[c for c in rows.columns if c != "percentiles"], "percentiles.*")
    return _rounded(flat, "numChanges", "weightedAveragePrice", "p50", "p90", "p95", "p99")


def daily_aggregates(spark, sf):
    return _flat_aggregate(aggregates.by_day_and_fuel(_days(spark, sf)))


def daily_aggregates_exact(spark, sf):
    return _flat_aggregate(aggregates.by_day_and_fuel(_days(spark, sf), exact=True))


def postcode_aggregates(spark, sf):
    return _flat_aggregate(aggregates.by_post_code(_days_of_stations(spark, sf)))


def percentile_label(spark, sf):
    rows = _days(spark, sf)
    out = aggregates.of_daily(rows, aggregates.by_day_and_fuel(rows))
    return out.select("station", "fuel", "day", F.col("weightedAveragePrice").alias("average"), "percentile")


def compound_latest(spark, sf):
    rows = aggregates.latest_compound(aggregates.by_day_and_fuel(_days(spark, sf)), domain.FUELS)
    return rows.select("day", *[F.round(F.col(f"{f}.{c}"), 6).alias(f"{f}_{n}") for f in domain.FUELS for c, n in (("lowestPrice", "lowest"), ("highestPrice", "highest"), ("weightedAveragePrice", "average"))])


def latest_price(spark, sf):
    return latest.latest(_days(spark, sf)).select("station", "fuel", "day", "closingPrice")


def latest_30(spark, sf):
    return latest.ranked(_days(spark, sf)).select("station", "fuel", "day", "rank", "closingPrice")


def latest_per_station(spark, sf):
    rows = latest.per_station(_days(spark, sf))
    return rows.select("id", F.explode("latestPrices").alias("fuel", "list")).select("id", "fuel", F.size("list").alias("n"), F.get("list", F.lit(0))["day"].alias("day"), F.try_element_at("list", F.lit(-1))["day"].alias("first_day"))


def latest_3_station(spark, sf):
    return latest.of_station(_days(spark, sf), STATION).select("fuel", "day", "closingPrice")


def last_30_station_fuel(spark, sf):
    return latest.last_days(_days(spark, sf), STATION, FUEL).select("day", "closingPrice", F.col("weightedAveragePrice").alias("average"))


def stations_page(spark, sf):
    return stations.page(domain.stations(spark, sf), 2).select("id", "name", "brand")


def favourites_page(spark, sf):
    return stations.favourites(domain.stations(spark, sf)).select("id", "name")


def favourite_toggle(spark, sf):
    return stations.toggled(domain.stations(spark, sf), STATION).select("id", "favorite")


def station_by_id(spark, sf):
    return stations.one(domain.stations(spark, sf), STATION).select("id", "name", F.col("address.city").alias("city"))


def postcode_page(spark, sf):
    return stations.by_post_code(domain.stations(spark, sf), "00003").select("id", "name", F.col("address.postCode").alias("postCode"))


def page_count(spark, sf):
    return domain.stations(spark, sf).agg(F.count("*").alias("n"), F.ceil(F.count("*") / stations.PER_PAGE).alias("pages"))


def search(spark, sf):
    return stations.search_page(domain.stations(spark, sf), "0000").select("id", "name", "score")


def stations_normalised(spark, sf):
    rows = domain.stations(spark, sf)
    return rows.select("id", scalars.capitalised("name").alias("name"), scalars.capitalised("brand").alias("brand"))


def _half(spark, sf, keep: int) -> DataFrame:
    return _flat(_days(spark, sf)).filter(F.pmod(F.dayofmonth("day"), F.lit(3)) != keep)


def merge_keep_existing(spark, sf):
    new = _half(spark, sf, 1).withColumn("average", F.lit(0.0))
    return store.keep_existing(_half(spark, sf, 0), new, ["station", "fuel", "day"])


def merge_replace(spark, sf):
    new = _half(spark, sf, 1).withColumn("average", F.lit(0.0))
    return store.replace_matching(_half(spark, sf, 0), new, ["station", "fuel", "day"])


def merge_fields(spark, sf):
    rows = domain.stations(spark, sf).select("id", "name", "favorite")
    new = latest.latest(_days(spark, sf)).filter(F.col("fuel") == FUEL).select(F.col("station").alias("id"), F.col("day").alias("latestDay"), F.col("closingPrice").alias("latestPrice"))
    return store.merge_fields(rows, new, ["id"])


def merge_bucketed(spark, sf):
    """As merge_fields, with stations that are stored by their id: only the new rows move."""
    at = store.Store(spark, scratch.folder(spark, "bucketed"), BUCKETS).bucketed("stations", ["id"])
    at.write(domain.stations(spark, sf).select("id", "name", "favorite"))
    new = latest.latest(_days(spark, sf)).filter(F.col("fuel") == FUEL).select(F.col("station").alias("id"), F.col("day").alias("latestDay"), F.col("closingPrice").alias("latestPrice"))
    return at.write(store.merge_fields(at.read(), new, ["id"]))


def _chart(spark, sf, fuel: str | None = FUEL) -> DataFrame:
    from datetime import datetime

    return charts.filtered(_days(spark, sf), None, fuel, tuple(datetime.fromisoformat(d) for d in RANGE))


def chart_price_history(spark, sf):
    return charts.price_history(charts.filtered(_chart(spark, sf), STATION))


def chart_price_changes(spark, sf):
    return charts.price_changes(charts.filtered(_chart(spark, sf), STATION))


def chart_difference_to_average(spark, sf):
    return _rounded(charts.difference_to_average(_chart(spark, sf)), "difference")


def chart_extreme_times(spark, sf):
    return charts.extreme_times(_chart(spark, sf))


def chart_cheapest_times(spark, sf):
    return charts.heat_map(_chart(spark, sf), "lowestPrice")


def chart_expensive_times(spark, sf):
    return charts.heat_map(_chart(spark, sf), "highestPrice")


def chart_day_overview(spark, sf):
    from datetime import datetime

    return charts.day_overview(charts.filtered(_days(spark, sf), STATION, None, datetime.fromisoformat(DAY)))


def _aggregates_in_range(spark, sf, fuel):
    from datetime import datetime

    return charts.filtered(aggregates.by_day_and_fuel(_days(spark, sf)), None, fuel, tuple(datetime.fromisoformat(d) for d in RANGE))


def chart_aggregated_overview(spark, sf):
    return _rounded(charts.aggregated_overview(_aggregates_in_range(spark, sf, None)), "weightedAveragePrice")


def chart_aggregated_history(spark, sf):
    return _rounded(charts.aggregated_history(_aggregates_in_range(spark, sf, FUEL)), "weightedAveragePrice", "numChanges", "median")


def chart_difference_to_cheapest(spark, sf):
    return _rounded(charts.difference_to_cheapest(_chart(spark, sf)), "difference")


def _live(spark, sf) -> DataFrame:
    """Rows of all days before the first live report, then all later reports, appended as live ones."""
    reports = domain.reports(spark, sf)
    first = F.lit(LIVE).cast("timestamp_ntz")
    return incremental.reported(daily.daily_prices(reports.filter(F.col("date") < first)).drop("id"), reports.filter(F.col("date") >= first))


def incremental_daily(spark, sf):
    return _flat(_live(spark, sf))


def incremental_extremes(spark, sf):
    """Which of equal extremes stands: the first in live reports."""
    return _live(spark, sf).filter("isTouched").select("station", "fuel", "day", F.col("lowestPrice.id").alias("lowest_id"), F.col("highestPrice.id").alias("highest_id"))


def live_latest(spark, sf):
    """Stations' lists after live reports."""
    before = latest.per_station(daily.daily_prices(domain.reports(spark, sf).filter(F.col("date") < F.lit(LIVE).cast("timestamp_ntz"))))
    value = before.schema["latestPrices"].dataType.valueType.elementType
    live = _live(spark, sf).filter("isTouched").withColumn("id", F.sha2(F.concat_ws("|", "station", "fuel", F.col("day").cast("string")), 256))
    rows = incremental.refreshed(before, live.select("station", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in value.fields]))
    return rows.select("id", F.explode("latestPrices").alias("fuel", "list")).select("id", "fuel", F.size("list").alias("n"), F.get("list", F.lit(0))["day"].alias("day"), F.get("list", F.lit(0))["closingPrice"].alias("closingPrice"))


def stream_daily(spark, sf):
    """Reports through the stream in two batches: daily rows from the store."""
    root = scratch.folder(spark, "stream")
    rows = domain.reports(spark, sf)
    for k in range(2):  # the second batch has late reports of all days
        rows.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == k).repartition(FILES).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(f"{root}/in")
    incremental.start(stream, f"{root}/store", f"{root}/checkpoint").awaitTermination()
    return _flat(store.Store(spark, f"{root}/store").by_day("daily").read())


class Breaking(store.Store):
    """A store of which a write breaks off once at each of the given steps."""

    def __init__(self, spark, root: str, steps, buckets: int = BUCKETS):
        super().__init__(spark, root, buckets)
        self.steps = list(steps)

    def step(self, name: str) -> None:
        if name in self.steps:
            self.steps.remove(name)
            raise InterruptedError(name)


#: Where the batches of a stream break off: before and after a manifest's rename, and after what is old has gone.
BREAKS = ["reports written", "daily committed", "reports committed", "daily cleaned", "daily written", "closings committed"]


def _recovered(spark, sf) -> store.Store:
    """A store after reports came in two batches, of which each broke off at several steps and was run again."""
    root, rows = scratch.folder(spark, "recovered"), domain.reports(spark, sf)
    for k in range(2):
        batch = rows.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == k)
        at = Breaking(spark, root, BREAKS[k::2])
        while True:
            try:
                incremental.process(at, batch)
                break
            except InterruptedError:
                continue
    return store.Store(spark, root, BUCKETS)


def stream_recovered(spark, sf):
    """Daily rows of batches that broke off and were run again: none is lost, none is there twice."""
    return _flat(_recovered(spark, sf).by_day("daily").read())


def stream_aggregates(spark, sf):
    """Aggregates that follow a stream's changed days: made after the first of two batches, kept up after the second, which has late reports."""
    at, rows = store.Store(spark, scratch.folder(spark, "aggregates"), BUCKETS), domain.reports(spark, sf)
    late = (F.dayofmonth("date") % 4 == 0) & (F.col("id").cast("bigint") % 2 == 0)
    for batch in (rows.filter(~late), rows.filter(late)):
        incremental.process(at, batch)
        imports.keep_aggregates(at)
    return _flat_aggregate(at.by_day("aggregates").read())


def csv_errors(spark, sf):
    """Results of files by folder: reports that came in, reports of unknown stations, malformed rows."""
    root = scratch.folder(spark, "errors")
    at = store.Store(spark, f"{root}/store", BUCKETS)
    imports.import_stations(spark, at, domain.station_files(spark, sf, f"{root}/stations"))
    imports.import_reports(spark, at, domain.mixed_files(spark, domain.reports(spark, sf), f"{root}/reports"), fuels=domain.FUELS)
    rows = at.by_day("import_results").read().withColumn("folder", F.element_at(F.split("file", "/"), -2))
    return rows.groupBy("folder").agg(*[F.sum(c).alias(c) for c in ("inserted", "skipped", "failed")])


def csv_quoted(spark, sf):
    """Reports of files with quotes and malformed rows."""
    path = domain.mixed_files(spark, domain.reports(spark, sf), scratch.folder(spark, "quoted"))
    wide = csv.read_csv(spark, path, schemas.report_csv(domain.FUELS), quarantine=True)
    return csv.reports(wide.filter("bad is null").drop("file", "bad"), domain.FUELS).drop("id")


def range_percentiles(spark, sf):
    """Percentiles of a range of days by product, from kept summaries."""
    at = store.Store(spark, scratch.folder(spark, "summaries"))
    at.by_day("daily").append(_days_of_stations(spark, sf))
    imports.keep_summaries(at)
    days = [d.strftime("%Y-%m-%d") for d in charts.days_of(RANGE)]
    rows = summaries.percentiles(at.by_day("summaries").read(days), "fuel")
    return _rounded(rows.select("fuel", "n", "percentiles.*"), "p50", "p90", "p95", "p99")


def postcode_percentiles(spark, sf):
    """Percentiles of all days by post code, merged from summaries of days and products."""
    rows = summaries.percentiles(summaries.summarised(_days_of_stations(spark, sf)), "postCode")
    return _rounded(rows.select("postCode", "n", "percentiles.*"), "p50", "p90", "p95", "p99")


def search_indexed(spark, sf):
    rows = domain.stations(spark, sf)
    index = prefixes.write(rows, scratch.folder(spark, "words"))
    return stations.page(prefixes.searched(index, rows, " 00000012"), order=(F.desc("score"), "id")).select("id", "name", "score")


def deep_page(spark, sf):
    """The page in the middle of the stations, and the last one."""
    found = listing.write(domain.stations(spark, sf).select("id", "name"), scratch.folder(spark, "listing"), parts=BUCKETS)
    last = found.pages()
    return found.page((last + 1) // 2).withColumn("which", F.lit("middle")).unionByName(found.page(last).withColumn("which", F.lit("last")))


def opening_price_spread(spark, sf):
    """Opening prices where each station's days are spread over tasks by month."""
    rows = daily.by_day(domain.reports(spark, sf), colocate=False)
    return daily.with_opening(rows, colocate=False).select("station", "fuel", "day", "openingPrice", "closingPrice")


def chart_filters(spark, sf):
    """Two charts after a visitor chose a station, a product and days: one takes the days, the other has a fixed one."""
    from datetime import datetime

    at = datetime.fromisoformat
    chosen = {"station": STATION, "fuel": FUEL, "day": (at(RANGE[0]), at(RANGE[1]))}
    first = charts.merged_filter({"fuel": "click", "day": (at("2024-01-01"), at("2024-01-02"))}, chosen)
    fixed = charts.merged_filter({"day": at(DAY)}, {k: v for k, v in chosen.items() if k != "fuel"})
    rows = _days(spark, sf)
    return charts.price_history(charts.filtered(rows, **first)).withColumn("chart", F.lit("range")).unionByName(charts.price_history(charts.filtered(rows, **fixed)).withColumn("chart", F.lit("day")))


def csv_reports(spark, sf):
    path = domain.report_files(spark, domain.raw_reports(spark, sf), scratch.folder(spark, "reports"))
    return csv.read_reports(spark, path, domain.FUELS).drop("id")


def csv_stations(spark, sf):
    rows = csv.read_stations(spark, domain.station_files(spark, sf, scratch.folder(spark, "stations")))
    return rows.select("id", "name", "brand", F.col("address.street").alias("street"), F.col("address.houseNumber").alias("houseNumber"), F.col("address.postCode").alias("postCode"), F.col("address.city").alias("city"), F.get("location.coordinates", F.lit(0)).alias("longitude"), F.get("location.coordinates", F.lit(1)).alias("latitude"), "favorite")


def _imported(spark, sf) -> tuple[store.Store, list]:
    """A store after stations, reports up to a day's noon, and then all reports were imported."""
    root = scratch.folder(spark, "import")
    at, reports = store.Store(spark, f"{root}/store", BUCKETS), domain.reports(spark, sf)
    results = [imports.import_stations(spark, at, domain.station_files(spark, sf, f"{root}/stations"))]
    for name, rows in (("first", reports.filter(F.col("date") < F.lit(NOON).cast("timestamp_ntz"))), ("all", reports)):
        results.append(imports.import_reports(spark, at, domain.report_files(spark, rows, f"{root}/{name}"), fuels=domain.FUELS))
    return at, results


def import_days(spark, sf):
    rows = _imported(spark, sf)[0].by_day("daily").read()
    return _flat(rows.withColumn("station", F.col("station.id")))


def import_counts(spark, sf):
    _, results = _imported(spark, sf)
    return spark.createDataFrame([(i, r.inserted, r.skipped, r.updated) for i, r in enumerate(results)], "step int, inserted bigint, skipped bigint, updated bigint")


def import_aggregates(spark, sf):
    rows = _imported(spark, sf)[0].by_day("aggregates").read()
    return _rounded(rows.select("day", "fuel", "lowestPrice", "highestPrice", "weightedAveragePrice"), "weightedAveragePrice")


def import_latest(spark, sf):
    rows = _imported(spark, sf)[0].read("stations")
    return rows.select("id", "name", F.explode("latestPrice").alias("fuel", "p")).select("id", "name", "fuel", "p.day", "p.closingPrice")


def stations_upsert(spark, sf):
    """Every second station imported over all of them: favourites stay, names are the new ones."""
    old = domain.stations(spark, sf)
    new = old.filter(F.col("id").cast("int") % 2 == 0).withColumns({"name": F.lit("New"), "favorite": F.lit(False)})
    return store.upsert_stations(old, new).select("id", "name", "favorite")


def stations_upsert_strict(spark, sf):
    old = domain.stations(spark, sf)
    new = old.filter(F.col("id").cast("int") % 2 == 0).withColumns({"name": F.lit("New"), "favorite": F.lit(False)})
    return store.upsert_stations(old, new, strict=True).select("id", "name", "favorite")


def upsert_counts(spark, sf):
    old = domain.stations(spark, sf).filter(F.col("id").cast("int") % 5 != 0)
    new = domain.stations(spark, sf).withColumn("name", F.when(F.col("id").cast("int") % 3 == 0, F.lit("New")).otherwise(F.col("name")))
    return store.counted(old, new, ["id"], ["name", "brand"])


def opening_repair(spark, sf):
    """Rows of every third day without an opening price, and others that are known to have none."""
    lost = F.pmod(F.dayofmonth("day"), F.lit(3)) == 0
    rows = _days(spark, sf).withColumn("openingPriceKnown", F.when(lost, None).otherwise(F.lit(True))).withColumn("openingPrice", F.when(F.dayofmonth("day") % 3 == 2, F.col("openingPrice")))
    return imports.openings_repaired(rows).select("station", "fuel", "day", "openingPrice", "openingPriceKnown", F.col("weightedAveragePrice").alias("average"))


def stored_toggle(spark, sf):
    """A favourite flag turned twice in the store, another's once."""
    at = store.Store(spark, scratch.folder(spark, "toggle"))
    at.write("stations", domain.stations(spark, sf))
    for station in (STATION, "8", "8"):
        imports.toggle_favourite(at, station)
    return at.read("stations").select("id", "favorite")


def store_tables(spark, sf):
    """Names by prefix after one table was dropped and one cleared."""
    at = store.Store(spark, scratch.folder(spark, "tables"))
    for name in ("daily", "daily_old", "stations"):
        at.write(name, domain.stations(spark, sf).select("id"))
    at.drop("daily_old")
    at.clear("stations")
    return spark.createDataFrame([(n, at.read(n).count()) for n in [*at.names("da"), *at.names("st")]], "name string, n bigint")


def station_formats(spark, sf):
    rows = csv.stations(domain.station_rows(spark, sf))
    return rows.select("id", scalars.address_text("address").alias("address"), scalars.marker("location").alias("m"), scalars.is_point("location").alias("is_point")).select("id", "address", "m.latitude", "m.longitude", "is_point")


def zone_days(spark, sf):
    """Days of a zone two hours ahead."""
    return daily.grouped(domain.reports(spark, sf), zone="+02:00").select("station", "fuel", "day", F.size("prices").alias("n"))


def paginator_links(spark, sf):
    """Links of every page of the stations."""
    return stations.page_links(domain.stations(spark, sf), 1)


def inline_rows(spark, sf):
    """Literal notes at the stations' rows, and a literal station among these."""
    rows = store.upsert_stations(domain.stations(spark, sf), inline.sample_station(spark))
    notes = inline.documents(spark, [("7", "seven"), ("10", "ten"), ("x", "nowhere")], "id string, note string")
    return rows.join(notes, "id", "left").select("id", "name", F.col("address.city").alias("city"), F.get("location.coordinates", F.lit(0)).alias("longitude"), "note")


def merged_lists(spark, sf):
    """Entries side by side with notes of the first two, and a default where there is none."""
    rows = daily.reshaped(daily.grouped(domain.reports(spark, sf)))
    notes = F.transform(F.slice("prices", 1, 2), lambda p: F.struct(p["id"].alias("note"), (p["price"] * 2).alias("price")))
    out = rows.select("station", "fuel", "day", F.posexplode(lists.zipped("prices", notes, ["id", "price"], ["note", "price"], {"note": F.lit("none")})).alias("place", "p"))
    return out.select("station", "fuel", "day", "place", "p.id", "p.price", "p.note")


def formatting(spark, sf):
    rows = _days(spark, sf).filter(F.col("station") == STATION)
    return rows.select("fuel", "day", scalars.price_text("closingPrice").alias("price"), scalars.time_text("lowestPrice.date").alias("time"), scalars.day_text("day").alias("shown"), scalars.fuel_label("fuel", {"view": "Views"}).alias("label"))


NAMES = """report_filter daily_group daily_by_price daily_extremes exclude_last price_list_previous price_change previous_flat
validity_segments weighted_average opening_price_lag opening_price_asof missing_opening daily_prices station_join daily_aggregates
daily_aggregates_exact postcode_aggregates percentile_label compound_latest latest_price latest_30 latest_per_station latest_3_station
last_30_station_fuel stations_page favourites_page favourite_toggle station_by_id postcode_page page_count search stations_normalised
merge_keep_existing merge_replace merge_fields chart_price_history chart_price_changes chart_difference_to_average chart_extreme_times
chart_cheapest_times chart_expensive_times chart_day_overview chart_aggregated_overview chart_aggregated_history
chart_difference_to_cheapest chart_filters opening_price_spread postcode_percentiles incremental_daily incremental_extremes live_latest formatting stations_upsert stations_upsert_strict
upsert_counts opening_repair station_formats zone_days paginator_links inline_rows merged_lists""".split()
#: Those that write files or tables on their way.
WRITING = """csv_reports csv_stations csv_errors csv_quoted stream_recovered stream_aggregates range_percentiles search_indexed deep_page merge_bucketed import_days import_counts import_aggregates import_latest stream_daily stored_toggle store_tables""".split()


def queries() -> dict:
    return {name: globals()[name] for name in [*NAMES, *WRITING]}


# SQL: r reports, g groups, o groups with opening price, l reports with previous price, s segments, d daily rows, c daily rows of stations, a aggregates

_R = """r AS (SELECT CAST(event_id AS VARCHAR) AS id, event_id AS k, ts AS date, CAST(user_id AS VARCHAR) AS station, event_type AS fuel, value AS price,
  CAST(date_trunc('day', ts) AS TIMESTAMP) AS day FROM events WHERE value >= 0.5)"""
_O = _R + """, g AS (SELECT station, fuel, day, count(*) AS n, arg_max(price, date) AS closing, arg_min(price, date) AS first_price, min(date) AS first_date,
  min(price) AS lowest, max(price) AS highest, arg_min(id, (price, date, id)) AS lowest_id, arg_max(id, (price, date, id)) AS highest_id,
  arg_min(date, (price, date, id)) AS lowest_date, arg_max(date, (price, date, id)) AS highest_date FROM r GROUP BY station, fuel, day),
o AS (SELECT *, lag(closing) OVER (PARTITION BY station, fuel ORDER BY day) AS opening FROM g)"""
_D = _O + """, s AS (SELECT station, fuel, day, date AS start, lead(date, 1, day + INTERVAL 1 DAY) OVER (PARTITION BY station, fuel, day ORDER BY date) AS until, price FROM r
  UNION ALL SELECT station, fuel, day, day, first_date, coalesce(opening, first_price) FROM o),
w AS (SELECT station, fuel, day, round_even(CAST(sum(date_diff('second', start, until) * price) / 86400 AS DOUBLE), 3) AS average FROM s GROUP BY station, fuel, day),
d AS (SELECT o.*, w.average FROM o JOIN w USING (station, fuel, day))"""
_L = _D + """, l AS (SELECT r.*, coalesce(lag(price) OVER (PARTITION BY r.station, r.fuel, r.day ORDER BY date), o.opening) AS previous, d.average
  FROM r JOIN o USING (station, fuel, day) JOIN d USING (station, fuel, day))"""
_AGG = """avg(n) AS numChanges, min(lowest) AS lowestPrice, max(highest) AS highestPrice, avg(average) AS weightedAveragePrice,
  {q}(average, 0.5) AS p50, {q}(average, 0.9) AS p90, {q}(average, 0.95) AS p95, {q}(average, 0.99) AS p99"""
_A = _D + ", a AS (SELECT day, fuel, " + _AGG.format(q="quantile_disc") + " FROM d GROUP BY day, fuel)"
_ROUNDED = "lowestPrice, highestPrice, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("numChanges", "weightedAveragePrice", "p50", "p90", "p95", "p99"))
_ST = "st AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS brand, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS postCode, n_name AS city, c_custkey % 7 = 0 AS favorite FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey)"
_SF = """sf AS (SELECT CAST(c_custkey AS VARCHAR) AS id, {w} AS name, c_mktsegment AS brand, CAST(c_custkey % 90 AS VARCHAR) AS houseNumber, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS postCode,
  {c} AS city, CASE WHEN ok THEN (c_custkey % 100)::DOUBLE END AS latitude, CASE WHEN ok THEN (c_custkey % 400 - 180)::DOUBLE END AS longitude
  FROM (SELECT *, c_custkey % 100 <= 90 AND c_custkey % 400 <= 360 AS ok FROM customer) LEFT JOIN nation ON n_nationkey = c_nationkey)"""
_FLAT = "station, fuel, day, n, opening AS openingPrice, closing AS closingPrice, lowest, highest, average"
_IN = f"fuel = '{FUEL}' AND day BETWEEN TIMESTAMP '{RANGE[0]}' AND TIMESTAMP '{RANGE[1]}'"
_HALF = "SELECT " + _FLAT + " FROM d WHERE day(day) % 3 <> {k}"
_ZERO = "SELECT * REPLACE (0.0::DOUBLE AS average) FROM (" + _HALF.format(k=1) + ")"
_KEY = "station, fuel, day"


def _heat(kind: str) -> str:
    return f"WITH {_D} SELECT CAST(dayofweek({kind}_date) + 1 AS INTEGER) AS weekday, CAST(hour({kind}_date) AS INTEGER) AS hour, count(*) AS days FROM d WHERE {_IN} GROUP BY ALL"


def _word(c: str) -> str:
    return f"list_reduce(list_transform(string_split(lower({c}), ' '), lambda x: upper(x[1]) || x[2:]), lambda x, y: x || ' ' || y)"


_SF = _SF.format(w=_word("c_name"), c=_word("n_name"))
# Of the noon's day, groups that the first import has stay as they were; its files cut fractions of seconds off.
_IMPORTED = _D.replace("SELECT CAST(event_id AS VARCHAR) AS id, event_id AS k, ts AS date", "SELECT CAST(event_id AS VARCHAR) AS id, event_id AS k, date_trunc('second', ts)::TIMESTAMP AS date").replace(
    "WHERE value >= 0.5)", f"JOIN customer ON c_custkey = user_id WHERE value >= 0.5 AND NOT (ts >= TIMESTAMP '{NOON}' AND (user_id, event_type, date_trunc('day', ts)) IN (SELECT (user_id, event_type, date_trunc('day', ts)) FROM events WHERE value >= 0.5 AND ts < TIMESTAMP '{NOON}')))"
)


def _percentiles(key: str, where: str) -> str:
    """Each group's values in order, cut into 64 runs at most; every run's middle value as often as the run is long."""
    return f"""WITH {_D}, {_ST}, v AS (SELECT day, fuel, postCode, average AS x FROM d JOIN st ON station = id WHERE {where}),
p AS (SELECT *, count(*) OVER g AS n, row_number() OVER (PARTITION BY day, fuel, postCode ORDER BY x) - 1 AS r FROM v WINDOW g AS (PARTITION BY day, fuel, postCode)),
u AS (SELECT day, fuel, postCode, (r * least(64, n)) // n AS run, list(x ORDER BY x) AS xs FROM p GROUP BY ALL),
e AS (SELECT {key}, xs[(len(xs) - 1) // 2 + 1] AS x, unnest(xs) FROM u)
SELECT {key}, count(*) AS n, {", ".join(f"round(quantile_cont(x, {q}), 6) AS p{int(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99))} FROM e GROUP BY {key}"""


SQL = {
    "report_filter": f"WITH {_R} SELECT id, date, station, fuel, price FROM r",
    "daily_group": f"WITH {_R} SELECT station, fuel, day, CAST(row_number() OVER (PARTITION BY station, fuel, day ORDER BY date, id) - 1 AS INTEGER) AS position, id, date, price FROM r",
    "daily_by_price": f"WITH {_R} SELECT station, fuel, day, CAST(row_number() OVER (PARTITION BY station, fuel, day ORDER BY price, date, id) - 1 AS INTEGER) AS position, id, price FROM r",
    "daily_extremes": f"WITH {_O} SELECT station, fuel, day, closing AS closingPrice, lowest_id, lowest, highest_id, highest FROM g",
    "exclude_last": f"WITH {_R}, x AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY date DESC) AS i FROM r) SELECT {_KEY}, CAST(count(*) - 1 AS INTEGER) AS \"left\", max(price) FILTER (i = 2) AS last_left FROM x GROUP BY ALL",
    "price_list_previous": f"WITH {_R} SELECT {_KEY}, id, price, lag(price) OVER (PARTITION BY {_KEY} ORDER BY date) AS previousPrice FROM r",
    "price_change": f"WITH {_L} SELECT {_KEY}, id, price, previous AS previousPrice, price - previous AS change FROM l",
    "previous_flat": f"WITH {_R} SELECT id, price, lag(price) OVER (PARTITION BY {_KEY} ORDER BY date) AS previousPrice FROM r",
    "validity_segments": f"WITH {_D} SELECT {_KEY}, start, until, price, date_diff('second', start, until) AS seconds FROM s",
    "weighted_average": f"WITH {_D} SELECT {_KEY}, average FROM d",
    "opening_price_lag": f"WITH {_O} SELECT {_KEY}, opening AS openingPrice, closing AS closingPrice FROM o",
    "opening_price_asof": f"WITH {_O} SELECT p.station, p.fuel, p.day, q.closing AS openingPrice FROM g p ASOF LEFT JOIN g q ON p.station = q.station AND p.fuel = q.fuel AND p.day > q.day",
    "missing_opening": f"WITH {_O} SELECT {_KEY}, closing AS closingPrice FROM o WHERE opening IS NULL",
    "daily_prices": f"WITH {_D} SELECT {_FLAT} FROM d",
    "station_join": f"WITH {_O}, {_ST} SELECT station, name, brand, postCode, fuel, day, closing AS closingPrice FROM g JOIN st ON station = id WHERE id <> '7'",
    "daily_aggregates": f"WITH {_A} SELECT day, fuel, {_ROUNDED} FROM a",
    "daily_aggregates_exact": f"WITH {_D}, a AS (SELECT day, fuel, {_AGG.format(q='quantile_cont')} FROM d GROUP BY day, fuel) SELECT day, fuel, {_ROUNDED} FROM a",
    "postcode_aggregates": f"WITH {_D}, {_ST}, a AS (SELECT day, fuel, postCode, {_AGG.format(q='quantile_disc')} FROM d JOIN st ON station = id GROUP BY day, fuel, postCode) SELECT day, fuel, postCode, {_ROUNDED} FROM a",
    "percentile_label": f"WITH {_A} SELECT station, fuel, day, average, CASE WHEN average > p99 THEN '> 99%' WHEN average > p95 THEN '> 95%' WHEN average > p90 THEN '> 90%' WHEN average > p50 THEN '> 50%' ELSE '< 50%' END AS percentile FROM d JOIN a USING (day, fuel)",
    "compound_latest": f"WITH {_A} SELECT day, " + ", ".join(f"round(max({c}) FILTER (fuel = '{f}'), 6) AS {f}_{n}" for f in domain.FUELS for c, n in (("lowestPrice", "lowest"), ("highestPrice", "highest"), ("weightedAveragePrice", "average"))) + " FROM a WHERE day = (SELECT max(day) FROM a) GROUP BY day",
    "latest_price": f"WITH {_O} SELECT station, fuel, max(day) AS day, arg_max(closing, day) AS closingPrice FROM g GROUP BY station, fuel",
    "latest_30": f"WITH {_O} SELECT * FROM (SELECT {_KEY}, CAST(row_number() OVER (PARTITION BY station, fuel ORDER BY day DESC) AS INTEGER) AS rank, closing AS closingPrice FROM g) WHERE rank <= 30",
    "latest_per_station": f"WITH {_O}, x AS (SELECT *, row_number() OVER (PARTITION BY station, fuel ORDER BY day DESC) AS i FROM g) SELECT station AS id, fuel, CAST(count(*) AS INTEGER) AS n, max(day) AS day, min(day) AS first_day FROM x WHERE i <= 30 GROUP BY ALL",
    "latest_3_station": f"WITH {_O} SELECT fuel, day, closing AS closingPrice FROM g WHERE station = '{STATION}' ORDER BY day DESC, fuel LIMIT 3",
    "last_30_station_fuel": f"WITH {_D} SELECT day, closing AS closingPrice, average FROM d WHERE station = '{STATION}' AND fuel = '{FUEL}' ORDER BY day DESC LIMIT 30",
    "stations_page": f"WITH {_ST} SELECT id, name, brand FROM st ORDER BY id LIMIT 24 OFFSET 24",
    "favourites_page": f"WITH {_ST} SELECT id, name FROM st WHERE favorite ORDER BY id LIMIT 24",
    "favourite_toggle": f"WITH {_ST} SELECT id, CASE WHEN id = '{STATION}' THEN NOT favorite ELSE favorite END AS favorite FROM st",
    "station_by_id": f"WITH {_ST} SELECT id, name, city FROM st WHERE id = '{STATION}'",
    "postcode_page": f"WITH {_ST} SELECT id, name, postCode FROM st WHERE postCode = '00003' ORDER BY id LIMIT 24",
    "page_count": "SELECT count(*) AS n, CAST(ceil(count(*) / 24) AS BIGINT) AS pages FROM customer",
    "search": f"WITH {_ST} SELECT id, name, CAST(score AS INTEGER) AS score FROM (SELECT *, " + " + ".join(f"coalesce(regexp_matches(lower({c}), '(^|[^\\pL\\pN])0000'), false)::INT" for c in ("name", "city", "postCode")) + " AS score FROM st) WHERE score > 0 ORDER BY score DESC, id LIMIT 24",
    "stations_normalised": f"WITH {_ST} SELECT id, {_word('name')} AS name, {_word('brand')} AS brand FROM st",
    "merge_keep_existing": f"WITH {_D}, x AS ({_HALF.format(k=0)}), y AS ({_ZERO}) SELECT * FROM x UNION ALL SELECT * FROM y WHERE ({_KEY}) NOT IN (SELECT ({_KEY}) FROM x)",
    "merge_replace": f"WITH {_D}, x AS ({_HALF.format(k=0)}), y AS ({_ZERO}) SELECT * FROM y UNION ALL SELECT * FROM x WHERE ({_KEY}) NOT IN (SELECT ({_KEY}) FROM y)",
    "merge_fields": f"WITH {_O}, {_ST}, x AS (SELECT station, max(day) AS latestDay, arg_max(closing, day) AS latestPrice FROM g WHERE fuel = '{FUEL}' GROUP BY station) SELECT coalesce(station, id) AS id, name, favorite, latestDay, latestPrice FROM st FULL JOIN x ON station = id",
    "merge_bucketed": f"WITH {_O}, {_ST}, x AS (SELECT station, max(day) AS latestDay, arg_max(closing, day) AS latestPrice FROM g WHERE fuel = '{FUEL}' GROUP BY station) SELECT coalesce(station, id) AS id, name, favorite, latestDay, latestPrice FROM st FULL JOIN x ON station = id",
    "chart_price_history": f"WITH {_D} SELECT day, fuel, opening AS openingPrice, closing AS closingPrice, lowest, highest, average AS weightedAveragePrice FROM d WHERE {_IN} AND station = '{STATION}'",
    "chart_price_changes": f"WITH {_L} SELECT day, fuel, date, price, previous AS previousPrice, price - previous AS change FROM l WHERE {_IN} AND station = '{STATION}'",
    "chart_difference_to_average": f"WITH {_L} SELECT CAST(hour(date) AS INTEGER) AS hour, round(avg(price - average), 6) AS difference, count(*) AS reports FROM l WHERE {_IN} GROUP BY ALL",
    "chart_extreme_times": f"WITH {_D}, x AS (SELECT hour(lowest_date) AS h, 0 AS k FROM d WHERE {_IN} UNION ALL SELECT hour(highest_date), 1 FROM d WHERE {_IN}) SELECT CAST(h AS INTEGER) AS hour, count(*) FILTER (k = 0) AS cheapest, count(*) FILTER (k = 1) AS mostExpensive FROM x GROUP BY h",
    "chart_cheapest_times": _heat("lowest"),
    "chart_expensive_times": _heat("highest"),
    "chart_day_overview": f"WITH {_R} SELECT fuel, date, price FROM r WHERE station = '{STATION}' AND day = TIMESTAMP '{DAY}'",
    "chart_aggregated_overview": f"WITH {_A} SELECT day, fuel, lowestPrice, highestPrice, round(weightedAveragePrice, 6) AS weightedAveragePrice FROM a WHERE day BETWEEN TIMESTAMP '{RANGE[0]}' AND TIMESTAMP '{RANGE[1]}'",
    "chart_aggregated_history": f"WITH {_A} SELECT day, fuel, lowestPrice, highestPrice, round(weightedAveragePrice, 6) AS weightedAveragePrice, round(numChanges, 6) AS numChanges, round(p50, 6) AS median FROM a WHERE {_IN}",
    "chart_difference_to_cheapest": f"WITH {_D} SELECT station, day, fuel, round(lowest - min(lowest) OVER (PARTITION BY day, fuel), 6) AS difference FROM d WHERE {_IN}",
    "incremental_daily": f"WITH {_D} SELECT {_FLAT} FROM d",
    "incremental_extremes": f"WITH {_R} SELECT station, fuel, day, "
    + "arg_min(id, (price, live, CASE WHEN live = 1 OR true THEN date END, id)) AS lowest_id, arg_min(id, (-price, live, CASE WHEN live = 0 THEN -epoch_us(date) ELSE epoch_us(date) END, CASE WHEN live = 0 THEN -k ELSE k END)) AS highest_id "
    + f"FROM (SELECT *, (date >= TIMESTAMP '{LIVE}')::INT AS live FROM r) GROUP BY station, fuel, day HAVING max(live) = 1",
    "live_latest": f"WITH {_O}, x AS (SELECT *, row_number() OVER (PARTITION BY station, fuel ORDER BY day DESC) AS i FROM g) SELECT station AS id, fuel, CAST(count(*) AS INTEGER) AS n, max(day) AS day, max(closing) FILTER (i = 1) AS closingPrice FROM x WHERE i <= 30 GROUP BY ALL",
    "stations_upsert": f"WITH {_ST} SELECT id, CASE WHEN id::INT % 2 = 0 THEN 'New' ELSE name END AS name, favorite FROM st",
    "stations_upsert_strict": f"WITH {_ST} SELECT id, CASE WHEN id::INT % 2 = 0 THEN 'New' ELSE name END AS name, id::INT % 2 = 1 AND favorite AS favorite FROM st",
    "upsert_counts": "SELECT count(*) FILTER (c_custkey % 5 = 0) AS inserted, count(*) FILTER (c_custkey % 5 <> 0 AND c_custkey % 3 <> 0) AS skipped, count(*) FILTER (c_custkey % 5 <> 0 AND c_custkey % 3 = 0) AS updated FROM customer",
    "opening_repair": f"WITH {_D} SELECT {_KEY}, CASE WHEN day(day) % 3 = 1 THEN NULL ELSE opening END AS openingPrice, true AS openingPriceKnown, average FROM d",
    "station_formats": f"WITH {_SF} SELECT id, 'Long Road ' || houseNumber || chr(10) || postCode || ' ' || city AS address, latitude, longitude, latitude IS NOT NULL AS is_point FROM sf",
    "zone_days": f"WITH {_R} SELECT station, fuel, CAST(date_trunc('day', date + INTERVAL 2 HOUR) AS TIMESTAMP) AS day, CAST(count(*) AS INTEGER) AS n FROM r GROUP BY ALL",
    "paginator_links": "WITH k AS (SELECT CAST(ceil(count(*) / 24) AS BIGINT) AS m FROM customer), p AS (SELECT c, n, m FROM k, range(1, m + 1) a(c), range(1, m + 1) b(n) WHERE n IN (1, m) OR abs(n - c) <= 1), "
    + "g AS (SELECT c, n AS page, n AS w FROM p UNION ALL SELECT c, NULL, n - 0.5 FROM (SELECT c, n, lag(n) OVER (PARTITION BY c ORDER BY n) AS m FROM p) WHERE n - m > 1) "
    + "SELECT CAST(c AS INTEGER) AS current, CAST(row_number() OVER (PARTITION BY c ORDER BY w) - 1 AS INTEGER) AS place, CAST(page AS INTEGER) AS page FROM g",
    "inline_rows": f"WITH {_ST} SELECT id, name, city, NULL::DOUBLE AS longitude, CASE id WHEN '7' THEN 'seven' WHEN '10' THEN 'ten' END AS note FROM st UNION ALL SELECT '00000000-0000-4000-8000-000000000001', 'Corner Station', 'Springfield', 13.4::DOUBLE, NULL",
    "stream_recovered": f"WITH {_D} SELECT {_FLAT} FROM d",
    "stream_aggregates": f"WITH {_A} SELECT day, fuel, {_ROUNDED} FROM a",
    "csv_errors": f"WITH {_R}, f AS (SELECT CASE WHEN k % 5 = 0 THEN 'mixed' WHEN hour(date) % 2 = 0 THEN 'even' ELSE 'odd' END AS folder, k % 10 = 0 AS bad, c_custkey IS NOT NULL AS known FROM r LEFT JOIN customer ON c_custkey = station::INT) SELECT folder, count(*) FILTER (known AND NOT bad) AS inserted, count(*) FILTER (NOT known AND NOT bad) AS skipped, count(*) FILTER (bad) AS failed FROM f GROUP BY folder",
    "csv_quoted": f"WITH {_R} SELECT date_trunc('second', date)::TIMESTAMP AS date, station, fuel, price FROM r WHERE k % 10 <> 0",
    "range_percentiles": _percentiles("fuel", f"day BETWEEN TIMESTAMP '{RANGE[0]}' AND TIMESTAMP '{RANGE[1]}'"),
    "postcode_percentiles": _percentiles("postCode", "true"),
    "search_indexed": f"WITH {_ST} SELECT id, name, CAST(score AS INTEGER) AS score FROM (SELECT *, " + " + ".join(f"coalesce(regexp_matches(lower({c}), '(^|[^\\pL\\pN])00000012'), false)::INT" for c in ("name", "city", "postCode")) + " AS score FROM st) WHERE score > 0 ORDER BY score DESC, id LIMIT 24",
    "deep_page": f"WITH {_ST}, x AS (SELECT id, name, (row_number() OVER (ORDER BY id) - 1) // 24 + 1 AS page, CAST(ceil(count(*) OVER () / 24) AS BIGINT) AS last FROM st) SELECT id, name, 'middle' AS which FROM x WHERE page = (last + 1) // 2 UNION ALL SELECT id, name, 'last' FROM x WHERE page = last",
    "opening_price_spread": f"WITH {_O} SELECT {_KEY}, opening AS openingPrice, closing AS closingPrice FROM o",
    "chart_filters": f"WITH {_D}, x AS (SELECT day, fuel, opening AS openingPrice, closing AS closingPrice, lowest, highest, average AS weightedAveragePrice FROM d WHERE station = '{STATION}') SELECT *, 'range' AS chart FROM x WHERE {_IN} UNION ALL SELECT *, 'day' FROM x WHERE day = TIMESTAMP '{DAY}'",
    "merged_lists": f"WITH {_R}, x AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY date, id) - 1 AS i FROM r) SELECT {_KEY}, CAST(i AS INTEGER) AS place, id, CASE WHEN i < 2 THEN price * 2 ELSE price END AS price, CASE WHEN i < 2 THEN id ELSE 'none' END AS note FROM x",
    "csv_reports": f"WITH {_R} SELECT date_trunc('second', date)::TIMESTAMP AS date, station, fuel, price FROM r",
    "csv_stations": f"WITH {_SF} SELECT id, name, brand, 'Long Road' AS street, houseNumber, postCode, city, longitude, latitude, false AS favorite FROM sf",
    "import_days": f"WITH {_IMPORTED} SELECT {_FLAT} FROM d",
    "import_counts": f"WITH {_R}, f AS (SELECT DISTINCT {_KEY} FROM r JOIN customer ON c_custkey = station::INT WHERE date < TIMESTAMP '{NOON}'), k AS (SELECT r.*, c_custkey IS NOT NULL AS known, f.day IS NOT NULL AS had FROM r LEFT JOIN customer ON c_custkey = station::INT LEFT JOIN f USING (station, fuel, day)) "
    + "SELECT 0::INT AS step, (SELECT count(*) FROM customer) AS inserted, 0::BIGINT AS skipped, 0::BIGINT AS updated "
    + f"UNION ALL SELECT 1, count(*) FILTER (known), count(*) FILTER (NOT known), 0 FROM k WHERE date < TIMESTAMP '{NOON}' UNION ALL SELECT 2, count(*) FILTER (known AND NOT had), count(*) FILTER (NOT known OR had), 0 FROM k",
    "import_aggregates": f"WITH {_IMPORTED} SELECT day, fuel, min(lowest) AS lowestPrice, max(highest) AS highestPrice, round(avg(average), 6) AS weightedAveragePrice FROM d GROUP BY day, fuel",
    "import_latest": f"WITH {_IMPORTED}, x AS (SELECT *, row_number() OVER (PARTITION BY station, fuel ORDER BY day DESC) AS i FROM d), {_SF} SELECT id, name, fuel, day, closing AS closingPrice FROM x JOIN sf ON id = station WHERE i = 1",
    "stream_daily": f"WITH {_D} SELECT {_FLAT} FROM d",
    "stored_toggle": f"WITH {_ST} SELECT id, CASE WHEN id = '{STATION}' THEN NOT favorite ELSE favorite END AS favorite FROM st",
    "store_tables": "SELECT 'daily' AS name, count(*) AS n FROM customer UNION ALL SELECT 'stations', 0",
    "formatting": f"WITH {_D} SELECT fuel, day, printf('%.3f €', closing) AS price, strftime(lowest_date, '%I:%M:%S') AS \"time\", strftime(day, '%d.%m.%Y') AS shown, CASE WHEN fuel = 'view' THEN 'Views' ELSE fuel END AS label FROM d WHERE station = '{STATION}'",
}


def oracle_sql() -> dict:
    return dict(SQL)
