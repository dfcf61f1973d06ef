"""Reading of report and station files."""

from __future__ import annotations

import csv as csv_module
import io
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

from pumpline import schemas
from pumpline.functions.scalars import capitalised, digest, point

LEAST_PRICE = 0.5
#: The column of malformed rows while files are read.
BAD = "_malformed"


def _files(spark: SparkSession, paths: list[str]) -> list:
    """The given files, and all *.csv below the given folders."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(conf)
        if fs.getFileStatus(where).isFile():
            out.append(where)
            continue
        found = fs.listFiles(where, True)
        while found.hasNext():
            at = found.next().getPath()
            if at.getName().lower().endswith(".csv"):
                out.append(at)
    return out


def _header(spark: SparkSession, path) -> tuple[str, ...]:
    """A file's first row, which may have line breaks in quotes; empty for an empty file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    raw = path.getFileSystem(conf).open(path)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(raw) if codec else raw, "UTF-8"))
    try:
        text = line = reader.readLine()
        while line is not None and text.count('"') % 2:
            line = reader.readLine()
            text += "\n" + (line or "")
    finally:
        reader.close()
    return tuple(next(csv_module.reader(io.StringIO(text.lstrip("\ufeff"), newline="")), ())) if text else ()


def _with_line_breaks(spark: SparkSession, files: list) -> set[str]:
    """Those of the files that have a line break in quotes: a line with an odd number of quotes tells them."""
    jvm = spark.sparkContext._jvm
    if not files:
        return set()
    lines = spark.read.text([f.toString() for f in files]).select("value", F.col("_metadata.file_path").alias("file"))
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    found = lines.filter(odd).select("file").distinct().collect()  # as many as there are files
    return {jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r["file"])).toString() for r in found}


def read_csv(spark: SparkSession, paths, schema: str, quarantine: bool = False) -> DataFrame:
    """CSV files, or all *.csv below folders, every column a string; each file's own header names its columns.

    Fields may be in quotes, with commas, line breaks and doubled quotes.  Only headers come to the driver, read by a few threads; files
    of one header are read as one table, and a plan has as many scans as there are different headers, twice if some have line
    breaks in fields: these are read whole, the others in splits.  Columns that a file lacks are null, others are left out;
    empty files have no rows.  A row of another length than its header fails when it is read; with `quarantine`, rows have
    the columns `file` and `bad` besides, and such a row has its text in `bad` and no other value.
    """
    wanted = [f.split()[0] for f in schema.split(", ")]
    files = _files(spark, [paths] if isinstance(paths, str) else list(paths))
    with ThreadPoolExecutor(8) as pool:
        headers = list(pool.map(lambda path: _header(spark, path), files))
    broken = _with_line_breaks(spark, files)
    out = None
    for header, whole in dict.fromkeys((h, f.toString() in broken) for f, h in zip(files, headers) if h):
        if len(set(header)) < len(header):
            raise ValueError(f"a header names a column twice: {','.join(header)}")
        own = ", ".join(f"`{c.replace('`', '``')}` string" for c in header)
        # Without pruning, the length of every row is checked, whatever columns are asked for.
        reader = spark.read.option("header", True).option("enforceSchema", False).option("escape", '"').option("multiLine", whole).option("columnPruning", False)
        if quarantine:
            reader = reader.schema(f"{own}, `{BAD}` string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
        else:
            reader = reader.schema(own).option("mode", "FAILFAST")
        rows = reader.csv([f.toString() for f, h in zip(files, headers) if h == header and (f.toString() in broken) == whole])
        of = lambda c: F.col(f"`{c}`") if c in header else F.lit(None).cast("string").alias(c)
        if quarantine:
            good = F.col(BAD).isNull()
            rows = rows.select(*[F.when(good, of(c)).alias(c) for c in wanted], F.col("_metadata.file_path").alias("file"), F.col(BAD).alias("bad"))
        else:
            rows = rows.select(*[of(c) for c in wanted])
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], f"{schema}, file string, bad string" if quarantine else schema)
    return out


def reports(wide: DataFrame, fuels=schemas.FUELS, least: float = LEAST_PRICE) -> DataFrame:
    """Up to one report per product of a wide row: its change flag is 1 and its price is a number of at least `least`.

    Times with an offset are turned to UTC, those without are UTC; fractions of seconds are cut off.  A column `file` stays.
    """
    parts = ", ".join(f"'{f}', {f}, {f}change" for f in fuels)
    own = [c for c in ("file",) if c in wide.columns]
    rows = wide.selectExpr("date", "station_uuid", *own, f"stack({len(fuels)}, {parts}) AS (fuel, price, change)")
    # A time with an offset is an instant, shown in UTC whatever the session's zone; without one it is taken as it stands.
    offset = F.col("date").rlike(r"\d(?:[+-]\d{2}(?::?\d{2})?|Z)$") & F.col("date").contains(":")
    instant = F.coalesce(*[F.try_to_timestamp("date", F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ssx", "yyyy-MM-dd HH:mm:ssxxx")], F.try_to_timestamp("date"))
    utc = F.timestamp_add("SECOND", F.unix_seconds(instant), F.lit("1970-01-01").cast("timestamp_ntz"))
    at = F.when(offset, utc).otherwise(F.substring(F.col("date").try_cast("timestamp_ntz").cast("string"), 1, 19).try_cast("timestamp_ntz"))
    station = F.lower("station_uuid")
    return rows.filter((F.col("change") == "1") & (F.col("price").try_cast("double") >= least)).select(
        digest(station, "fuel", "date", "price").alias("id"),
        at.alias("date"),
        station.alias("station"),
        "fuel",
        F.col("price").cast("double").alias("price"),
        *own,
    )


def stations(rows: DataFrame) -> DataFrame:
    """Stations by lower-case id, names capitalised, the point null where it is out of range."""
    return rows.select(
        F.lower("uuid").alias("id"),
        capitalised("name").alias("name"),
        F.col("brand"),
        F.struct(capitalised("street").alias("street"), F.col("house_number").alias("houseNumber"), F.col("post_code").alias("postCode"), capitalised("city").alias("city")).alias("address"),
        point("latitude", "longitude").alias("location"),
        F.lit(False).alias("favorite"),
        *[c for c in ("file",) if c in rows.columns],
    )


def read_reports(spark: SparkSession, paths, fuels=schemas.FUELS) -> DataFrame:
    return reports(read_csv(spark, paths, schemas.report_csv(fuels)), fuels)


def read_stations(spark: SparkSession, paths) -> DataFrame:
    return stations(read_csv(spark, paths, schemas.STATION_CSV))
