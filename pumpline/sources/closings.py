"""An index of closing prices: a live report finds the neighbours of its day without the daily rows of other days.

Two tables: all closing prices by month and bucket of stations, and per station, product and month its first and last day by
bucket of stations.  A batch reads the months and buckets that it touches, and its buckets of the second table; how many files these
are depends on the batch, not on how many days are stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pumpline.sources.store import Store

KEY = ["station", "fuel", "day"]
CLOSING = "station string, fuel string, day timestamp_ntz, closingPrice double"
MONTH = "station string, fuel string, month timestamp_ntz, first timestamp_ntz, last timestamp_ntz, closingPrice double"


def month_of(day):
    return F.date_trunc("month", day).cast("timestamp_ntz")


def by_month(rows: DataFrame) -> DataFrame:
    """Per station, product and month the first and the last day, and the last one's closing price."""
    return rows.groupBy("station", "fuel", month_of("day").alias("month")).agg(F.min("day").alias("first"), F.max("day").alias("last"), F.max_by("closingPrice", "day").alias("closingPrice"))


class Closings:
    def __init__(self, store: Store):
        self.days = store.by_month_and_bucket("closings")
        self.months = store.by_bucket("closing_months")

    def _parts(self, keys: DataFrame) -> tuple[list[str], list[str]]:
        """Parts of the two tables that the keys touch: at most months times buckets."""
        found = keys.select(self.days.part.alias("a"), self.months.part.alias("b")).distinct().collect()
        return sorted({r["a"] for r in found}), sorted({r["b"] for r in found})

    def around(self, keys: DataFrame) -> DataFrame:
        """(station, fuel, day, closingPrice): of each key (station, fuel, day) the latest stored day before it and the first behind it are among them.

        Of the keys' months all days, of others the first and the last; a first day that isn't the last one, too, has no price here.
        """
        of = keys.select("station", "fuel").distinct()
        return self.touched(keys).join(of, ["station", "fuel"], "left_semi").groupBy(*KEY).agg(F.max("closingPrice").alias("closingPrice"))

    def touched(self, keys: DataFrame) -> DataFrame:
        """As `around`, of all stations of the parts that the keys touch; nothing moves for it, and a row may be there twice."""
        days, buckets = self._parts(keys)
        near, far = self.days.read(days, CLOSING), self.months.read(buckets, MONTH)
        far = far.select("station", "fuel", F.explode(F.array(F.struct(F.col("first").alias("day"), F.lit(None).cast("double").alias("closingPrice")), F.struct(F.col("last").alias("day"), "closingPrice"))).alias("x")).select("station", "fuel", "x.*")
        return near.select(*KEY, "closingPrice").unionByName(far)

    def put(self, rows: DataFrame, keys: DataFrame | None = None) -> None:
        """Closing prices of new or changed daily rows (station, fuel, day, closingPrice); keys: theirs, where these are at hand."""
        rows = rows.select(*KEY, "closingPrice")
        days, buckets = self._parts(rows if keys is None else keys)
        self.days.merge(rows, days, KEY)
        touched = (rows if keys is None else keys).select("station", "fuel", month_of("day").alias("month")).distinct()
        now = by_month(self.days.read(days, CLOSING)).join(touched, ["station", "fuel", "month"], "left_semi")
        self.months.merge(now, buckets, ["station", "fuel", "month"])
