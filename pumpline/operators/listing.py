"""Listings of which any page is read alone: rows in order in numbered parts, with each part's count.

`stations.page` carries all rows before a page; here a page knows its part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pumpline.operators.stations import PER_PAGE

PARTS = 64


def write(rows: DataFrame, path: str, order=("id",), parts: int = PARTS) -> "Listing":
    """Rows in a total order as parts of consecutive ones, about equally large."""
    dealt = rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", *order)
    dealt.write.partitionBy("part").parquet(f"{path}/rows")
    dealt.limit(0).coalesce(1).write.parquet(f"{path}/schema")
    stored = rows.sparkSession.read.schema(dealt.schema).parquet(f"{path}/rows")
    stored.groupBy("part").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/counts")  # a row for each part
    return Listing(rows.sparkSession, path, order)


class Listing:
    def __init__(self, spark: SparkSession, path: str, order=("id",)):
        schema = spark.read.parquet(f"{path}/schema").schema
        self.rows, self.order = spark.read.schema(schema).parquet(f"{path}/rows"), order
        self.counts = sorted((r["part"], r["n"]) for r in spark.read.parquet(f"{path}/counts").collect())

    def pages(self, per_page: int = PER_PAGE) -> int:
        return -(-sum(n for _, n in self.counts) // per_page)

    def page(self, number: int, per_page: int = PER_PAGE) -> DataFrame:
        """One page, from the parts that have its rows; beyond the last it is empty."""
        if number < 1:
            raise ValueError("pages are numbered from 1")
        start, before, chosen, skipped = (number - 1) * per_page, 0, [], None
        for part, n in self.counts:
            if before < start + per_page and before + n > start:
                skipped = start - before if skipped is None else skipped
                chosen.append(part)
            before += n
        return self.rows.filter(F.col("part").isin(chosen)).drop("part").orderBy(*self.order).offset(skipped or 0).limit(per_page)
