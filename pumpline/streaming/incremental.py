"""Live reports: single ones as expressions, streams of them by foreachBatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from pumpline.functions import lists
from pumpline.operators import daily, latest
from pumpline.sources.closings import Closings
from pumpline.sources.store import Store


def upserted(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Daily rows (station, fuel, day, prices, openingPrice, ...) after reports are appended, in order of date and id.

    A row without reports stays; reports without a row make one, with empty defaults.  Each report goes behind the
    list even if it is older, and its price becomes the closing price; of equal extremes the first stays.
    """
    new = reports.groupBy("station", "fuel", daily.day_of("date").alias("day")).agg(lists.by_date(F.collect_list(F.struct("id", "date", "price"))).alias("reports"))
    both = rows.join(new, ["station", "fuel", "day"], "full_outer")
    kept = {c: rows.schema[c].dataType for c in ("prices", "closingPrice", "lowestPrice", "highestPrice")}
    prices = F.coalesce("prices", F.array().cast(kept["prices"]))
    start = F.struct(prices.alias("prices"), *[F.col(c) for c in kept if c != "prices"])

    def step(s, r):
        after = {"prices": lists.appended(s["prices"], r), "closingPrice": r["price"], "lowestPrice": lists.replaced_if(s["lowestPrice"], r, False), "highestPrice": lists.replaced_if(s["highestPrice"], r, True)}
        return F.struct(*[after[c].cast(t).alias(c) for c, t in kept.items()])

    after = F.when(F.col("reports").isNull(), start).otherwise(F.aggregate("reports", start, step))
    out = both.withColumn("isTouched", F.col("reports").isNotNull()).withColumn("isNew", F.col("prices").isNull()).withColumn("after", after)
    return out.withColumns({c: F.col(f"after.{c}") for c in kept}).drop("after", "reports")


def opened(rows: DataFrame) -> DataFrame:
    """New rows get the opening price of the latest earlier day, in their first entry too; touched rows' averages are made again."""
    before = daily.opening_as_of(rows.filter("isNew").select("station", "fuel", "day"), rows)
    out = rows.join(before.withColumnRenamed("openingPrice", "found"), ["station", "fuel", "day"], "left")
    opening = F.when(F.col("isNew"), F.col("found")).otherwise(F.col("openingPrice"))
    out = out.withColumn("openingPrice", opening)
    if "openingPriceKnown" in out.columns:
        out = out.withColumn("openingPriceKnown", F.col("isNew") | F.col("openingPriceKnown"))
    out = out.withColumn("prices", F.when(F.col("isNew") & F.col("openingPrice").isNotNull(), lists.opening_in_first("prices", "openingPrice")).otherwise(F.col("prices")))
    average = F.when(F.col("isTouched"), lists.weighted_average("prices", "day", "openingPrice")).otherwise(F.col("weightedAveragePrice"))
    return out.withColumn("weightedAveragePrice", average).drop("found", "isNew")


def reported(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """All daily rows after live reports; `isTouched` marks those that a report changed or made, which a caller gets back."""
    return opened(upserted(rows, reports))


def refreshed(stations: DataFrame, changed: DataFrame, depth: int | None = latest.DEPTH) -> DataFrame:
    """Stations (id, latestPrice, latestPrices, ...) with changed daily rows in their lists of latest rows.

    Only stations of the changed rows are read again; a changed row stands in place of that of its day.
    """
    value = F.struct(*[c for c in changed.columns if c != "station"])
    of_fuel = changed.select("station", "fuel", F.struct("day", value.alias("value")).alias("v")).groupBy("station", "fuel").agg(F.transform(F.array_sort(F.collect_list("v")), lambda x: x["value"]).alias("values"))
    fresh = of_fuel.groupBy(F.col("station").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("fuel", "values"))).alias("fresh"))
    kind = fresh.schema["fresh"].dataType
    rows = stations if "latestPrices" in stations.columns else stations.withColumn("latestPrices", F.lit(None).cast(kind))
    rows = rows.join(fresh, "id", "full_outer")
    none, empty = F.create_map().cast(kind), F.array().cast(kind.valueType)
    fold = lambda _, old, new: F.aggregate(F.coalesce(new, empty), F.coalesce(old, empty), lambda acc, x: lists.latest_of(acc, x, depth))
    merged = F.map_zip_with(F.coalesce("latestPrices", none), F.coalesce("fresh", none), fold)
    rows = rows.withColumn("latestPrices", F.when(F.col("fresh").isNull(), F.col("latestPrices")).otherwise(merged))
    return rows.withColumn("latestPrice", firsts("latestPrices")).drop("fresh")


def firsts(latest_prices: str) -> Column:
    """Of each product the first row of its list."""
    return F.transform_values(latest_prices, lambda _, x: F.get(x, F.lit(0)))


def put_lists(store: Store, changed: DataFrame, depth: int = latest.DEPTH, seen: dict[str, int] | None = None, buckets: list[str] | None = None) -> None:
    """The table `latest` (id, latestPrices) with changed daily rows in its lists, as in `refreshed`; the latest rows are the lists' first.

    Stored lists and changed rows move once, to tasks of which each has a share of a bucket's stations and writes it.
    """
    table = store.by_bucket("latest", "id")
    value = F.struct(*[c for c in changed.columns if c != "station"])
    rows = changed.select(F.col("station").alias("id"), "fuel", F.array(value).alias("fresh"))
    if table.exists():
        buckets = buckets or [r[0] for r in changed.select(store.bucket()).distinct().collect()]  # as many as there are buckets at most
        old = table.read(buckets).select("id", F.explode("latestPrices").alias("fuel", "old"))
        rows = rows.unionByName(old, allowMissingColumns=True)
    else:
        rows = rows.withColumn("old", F.lit(None).cast(rows.schema["fresh"].dataType))
    shares = max(1, int(store.spark.conf.get("spark.sql.shuffle.partitions")) // store.buckets)
    at = ["bucket", "share"]
    rows = rows.withColumn("bucket", store.bucket("id")).withColumn("share", F.pmod(F.hash("id"), F.lit(shares))).repartition(*at)
    of_fuel = rows.groupBy(*at, "id", "fuel").agg(F.flatten(F.collect_list("fresh")).alias("fresh"), F.flatten(F.collect_list("old")).alias("old"))
    days = F.transform("fresh", lambda x: x["day"])
    kept = F.concat("fresh", F.filter("old", lambda x: ~F.array_contains(days, x["day"])))
    sorted_ = F.reverse(F.array_sort(F.transform(kept, lambda x: F.struct(x["day"].alias("day"), x.alias("x")))))
    merged = F.when(F.size("fresh") == 0, F.col("old")).otherwise(F.slice(F.transform(sorted_, lambda k: k["x"]), 1, depth))
    lists_ = of_fuel.groupBy(*at, "id").agg(F.map_from_entries(F.collect_list(F.struct("fuel", merged.alias("list")))).alias("latestPrices"))
    table.replace(lists_.select("id", "latestPrices"), seen=seen, dealt=True)


def process(store: Store, batch: DataFrame, fuels=None) -> DataFrame:
    """A micro-batch: new reports join the stored ones, and the daily rows that they touch are made again from all reports.

    A report that is there already (by id) is taken once, so a batch that is run again - because it broke off, at whatever
    step - changes what is lacking and nothing else.  Tables are kept by day or by bucket of stations: read and written are the days of the
    batch, the days whose opening price is the closing price of one of these, and the buckets of the touched stations in the index of closing
    prices and in the lists of latest rows (`latest`).  Returns the touched rows.
    """
    batch = batch.dropDuplicates(["id"]).withColumn("day", daily.day_of("date"))
    if fuels:
        batch = batch.filter(F.col("fuel").isin(list(fuels)))
    batch = batch.persist()
    try:
        return _processed(store, batch)
    finally:
        batch.unpersist()


def _processed(store: Store, batch: DataFrame) -> DataFrame:
    reports, rows, closings = store.by_day("reports"), store.by_day("daily"), Closings(store)
    shown = lambda df: sorted(r[0] for r in df.select(F.date_format("day", "yyyy-MM-dd")).distinct().collect())
    touched = shown(batch)  # as many as the batch has days
    known = reports.read(touched, schema_text(batch))
    reports.append(batch.join(known.select("id"), "id", "left_anti").select(*batch.columns))
    keys = batch.select(*daily.KEY).distinct()
    # The first stored day behind each touched one opens with its closing price.
    marks = closings.around(keys).withColumn("hit", F.lit(0)).unionByName(keys.withColumn("hit", F.lit(1)), allowMissingColumns=True)
    marks = marks.groupBy(*daily.KEY).agg(F.max("hit").alias("hit"), F.max("closingPrice").alias("closingPrice"))
    order = Window.partitionBy("station", "fuel").orderBy("day")
    behind = F.coalesce(F.lag("hit").over(order) == 1, F.lit(False))
    marks = marks.withColumn("again", (F.col("hit") == 1) | behind).drop("hit").persist()
    try:
        key = list(daily.KEY)
        again = marks.filter("again").select(*key)
        days = shown(again)
        # Reports are dealt by their day's key for the join, and so for the grouping.
        read = daily.grouped(reports.read(days, schema_text(batch)).join(again, key, "left_semi"), colocate=False)
        read = read.select(*key, lists.by_date("prices").alias("prices")).withColumn("closingPrice", lists.closing("prices")).withColumn("again", F.lit(True))
        both = read.unionByName(marks.filter("not again"), allowMissingColumns=True)
        earlier = F.last("closingPrice", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        made = both.withColumn("openingPrice", earlier).filter("again").select(*key, "prices", "openingPrice")
        made = daily.completed(made).select(*daily.daily_prices(batch.limit(0)).columns)
        schema = schema_text(made)
        rows.merge(made, days, key)
        stored = rows.read(days, schema)
        closings.put(stored.join(again, key, "left_semi"), again)
        buckets = [r[0] for r in batch.select(store.bucket()).distinct().collect()]  # as many as there are buckets at most
        # Rows of other stations of these buckets are in the lists as they are, so they change nothing.
        put_lists(store, stored.filter(store.bucket().isin(buckets)), buckets=buckets)
        changed = stored.join(batch.select("station", "fuel").distinct(), ["station", "fuel"], "left_semi")
        reports.compact()
        return changed
    finally:
        marks.unpersist()


def schema_text(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def start(reports: DataFrame, root: str, checkpoint: str, late: str | None = None, **trigger) -> StreamingQuery:
    """A stream of reports into the store below root.

    Late reports are taken without bound; `late` sets a watermark beyond which they may be dropped.
    """
    stream = reports.withWatermark("date", late) if late else reports
    spark = reports.sparkSession
    writer = stream.writeStream.foreachBatch(lambda batch, _: process(Store(spark, root), batch)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
