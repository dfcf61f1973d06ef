"""An index of the words of stations: a query's beginning is a range of words.

The index has a row for each word, field and station, in order of word, so a search reads the row groups of its range and joins the
stations that it finds; no text is split at a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FIELDS = ("name", "address.street", "address.city", "address.postCode")
LAST = "\U0010ffff"


def words(stations: DataFrame) -> DataFrame:
    """(word, field, id): lower-case words of the searched fields, each once per row of a station.

    Words are told apart within their field, so no task holds more than a station at a time.
    """
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS])
    own = F.array_distinct(F.split(F.lower("x.text"), r"[^\p{L}\p{N}]+"))
    rows = stations.select("id", F.explode(texts).alias("x")).select("id", "x.field", F.explode(own).alias("word"))
    return rows.filter("word <> ''").select("word", "field", "id")


def write(stations: DataFrame, path: str) -> DataFrame:
    """The index as a table in order of word; the stations of a frequent word are spread over tasks."""
    words(stations).repartitionByRange("word", "id").sortWithinPartitions("word", "id").write.parquet(path)
    return stations.sparkSession.read.parquet(path)


def searched(index: DataFrame, stations: DataFrame, query: str) -> DataFrame:
    """As `stations.searched`, from the index."""
    wanted = query.strip().lower()
    hits = index.filter((F.col("word") >= wanted) & (F.col("word") < wanted + LAST)) if wanted else index.limit(0)
    scores = hits.groupBy("id").agg(F.count_distinct("field").cast("int").alias("score"))
    return stations.join(scores, "id")
