"""The star-schema test tables as reports and stations: events are reports, customers stations, event types products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FUELS = ("click", "error", "purchase", "signup", "view")
LEAST = 0.5


def raw_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("ts").cast("timestamp_ntz").alias("date"),
        F.col("user_id").cast("string").alias("station"),
        F.col("event_type").alias("fuel"),
        F.col("value").alias("price"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_reports(spark, sf_dir).filter(F.col("price") >= LEAST)


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    # 25 nations, whatever the scale: the session's threshold broadcasts them.
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    rows = customers.join(nations, customers["c_nationkey"] == nations["n_nationkey"], "left")
    address = F.struct(F.lit(None).cast("string").alias("street"), F.lit(None).cast("string").alias("houseNumber"), F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("postCode"), F.col("n_name").alias("city"))
    location = F.lit(None).cast("struct<type: string, coordinates: array<double>>")
    return rows.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("brand"), address.alias("address"), location.alias("location"), (F.col("c_custkey") % 7 == 0).alias("favorite"))


def report_files(spark: SparkSession, rows: DataFrame, path: str) -> str:
    """Reports as files, those of even hours with another order of columns than the others."""
    wide = [F.when(F.col("fuel") == f, F.col("price").cast("string")).alias(f) for f in FUELS]
    flags = [F.when(F.col("fuel") == f, "1").otherwise("0").alias(f"{f}change") for f in FUELS]
    even = F.hour(F.col("date").cast("timestamp")) % 2 == 0
    columns = [F.date_format(F.col("date").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("date"), F.col("station").alias("station_uuid"), *wide, *flags]
    rows.filter(even).select(*columns).write.option("header", True).csv(f"{path}/even")
    rows.filter(~even).select(*reversed(columns)).write.option("header", True).csv(f"{path}/odd")
    return path


def mixed_files(spark: SparkSession, rows: DataFrame, path: str) -> str:
    """Report files of which some have fields in quotes and rows that lack columns: folders `even`, `odd` and `mixed`.

    Every fifth report, by id, is in `mixed`; of these, those with an even id lack their last column.
    """
    key = F.col("id").cast("bigint")
    report_files(spark, rows.filter(key % 5 != 0), path)
    own = rows.filter(key % 5 == 0)
    price = lambda f: F.when(F.col("fuel") == f, F.concat(F.lit('"'), F.col("price").cast("string"), F.lit('"'))).otherwise("")
    flag = lambda f: F.when(F.col("fuel") == f, "1").otherwise("0")
    fields = [F.date_format(F.col("date").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.concat(F.lit('"'), F.col("station"), F.lit('"')), *[price(f) for f in FUELS], *[flag(f) for f in FUELS]]
    line = F.when(key % 2 == 0, F.concat_ws(",", *fields[:-1])).otherwise(F.concat_ws(",", *fields))
    header = ",".join(["date", "station_uuid", *FUELS, *(f"{f}change" for f in FUELS)])
    # Lines as the only column, whose name is the header; the separator occurs nowhere.
    own.select(line.alias(header)).write.option("header", True).option("sep", "\u0001").option("quote", "\u0002").csv(f"{path}/mixed")
    return path


def station_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rows of station files; some points are out of range."""
    rows = stations(spark, sf_dir)
    key = F.col("id").cast("int")
    return rows.select(F.upper("id").alias("uuid"), F.upper("name").alias("name"), "brand", F.lit("LONG ROAD").alias("street"), (key % 90).cast("string").alias("house_number"), F.col("address.postCode").alias("post_code"), F.col("address.city").alias("city"), (key % 100).cast("string").alias("latitude"), (key % 400 - 180).cast("string").alias("longitude"))


def station_files(spark: SparkSession, sf_dir: str, path: str) -> str:
    station_rows(spark, sf_dir).write.option("header", True).csv(path)
    return path
