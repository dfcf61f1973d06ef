"""Connected components of a graph given by its edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pumpline.llm.shared import discard, written


def _checked(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).collect()[0]
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node with an edge, the component being its smallest node.

    edges: columns u and v.  Each round links a node's neighbours to the smallest of them, first the larger, then
    the smaller ones; a star with any number of rays takes one round.  Nothing but a count and a sum comes to the
    driver, and each round is a table in the shared folder.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "edges")
    seen = _checked(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lower = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = lower.groupBy("u").agg(F.min("v").alias("m"))
        small = lower.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        last, edges = edges, written(small.filter("u <> v").distinct(), "edges")
        discard(last)
        now = _checked(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
