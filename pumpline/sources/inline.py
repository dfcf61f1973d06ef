"""Small literal sources, for tests and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pumpline import schemas


def documents(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sample_station(spark: SparkSession) -> DataFrame:
    """One made-up station."""
    row = ("00000000-0000-4000-8000-000000000001", "Corner Station", "Corner", ("Main Street", "12", "10115", "Springfield"), ("Point", [13.4, 52.5]), False)
    return spark.createDataFrame([row], schemas.STATION)


def count(rows: DataFrame) -> int:
    return rows.count()
