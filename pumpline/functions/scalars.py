"""Expressions on single values: texts, points, labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pumpline.functions.lists import column
from pumpline.schemas import LABELS


def capitalised(text) -> Column:
    """Lower case, then each word's first letter in upper case; words are parted by space, tab and line ends, and only ASCII letters are raised."""
    lowered = F.filter(F.split(F.lower(column(text)), ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("text"), F.lit(" ").alias("last"))
    raised = lambda c, last: F.when(last.rlike("[ \t\r\n\f\u000b]"), F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)
    return F.aggregate(lowered, start, lambda s, c: F.struct(F.concat(s["text"], raised(c, s["last"])).alias("text"), c.alias("last")))["text"]


def digest(*fields) -> Column:
    """32 hex digits that stand for the fields: half of a SHA-256."""
    return F.substring(F.sha2(F.concat_ws("|", *[column(f) for f in fields]), 256), 1, 32)


def point(latitude, longitude) -> Column:
    """A point, longitude first; null where a coordinate is out of range or no number."""
    lat, lon = column(latitude).try_cast("double"), column(longitude).try_cast("double")
    valid = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(valid, F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))


def is_point(value) -> Column:
    value = column(value)
    return F.coalesce((value["type"] == "Point") & (F.size(value["coordinates"]) == 2), F.lit(False))


def marker(value) -> Column:
    """A map marker: latitude first."""
    value = column(value)
    return F.struct(F.get(value["coordinates"], F.lit(1)).alias("latitude"), F.get(value["coordinates"], F.lit(0)).alias("longitude"))


def address_text(address) -> Column:
    a = column(address)
    return F.format_string("%s %s\n%s %s", a["street"], a["houseNumber"], a["postCode"], a["city"])


def fuel_label(fuel, labels=LABELS) -> Column:
    out = F.lit(None).cast("string")
    for key, label in labels.items():
        out = F.when(column(fuel) == key, F.lit(label)).otherwise(out)
    return F.coalesce(out, column(fuel))


def price_text(price) -> Column:
    return F.format_string("%.3f €", column(price))


def time_text(date) -> Column:
    """Of a 12-hour clock."""
    return F.date_format(column(date), "hh:mm:ss")


def day_text(day) -> Column:
    return F.date_format(column(day), "dd.MM.yyyy")


def percentile_label(price, percentiles) -> Column:
    """Which percentile a price is strictly above."""
    price, p = column(price), column(percentiles)
    return F.when(price > p["p99"], "> 99%").when(price > p["p95"], "> 95%").when(price > p["p90"], "> 90%").when(price > p["p50"], "> 50%").otherwise("< 50%")


def day_of(date, zone: str | None = None) -> Column:
    """Midnight of a time's day, in UTC or in the given zone."""
    at = column(date)
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), at) if zone else at
    return F.date_trunc("day", local.cast("timestamp_ntz")).cast("timestamp_ntz")
