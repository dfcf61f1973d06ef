"""A training-data pipeline over `documents`: quality rules, near-dedup, substring dedup, pseudonyms, packing.

Each stage works on all rows that the one before kept; between stages the rows are a Parquet table in the folder
that the cluster shares, and a table goes when the next one is there.  All stages but the last return the columns of
`documents`, and whatever other columns the rows have, whatever their names.

Defined results, for every stage: an empty table gives an empty table; texts of any length are read whole; rows that
are repeated are rows of their own unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pumpline.llm import chunks, minhash, packing, pii, quality
from pumpline.llm.shared import discard, written


def counted(docs: DataFrame) -> DataFrame:
    """The rows with their number of characters as it is now; null for a null text."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go.

    Null and empty texts have too few words and go; nulls in other columns don't matter.  Equal texts are judged alike, so
    repeated rows stay or go together.  Which rule is asked first depends on a sample and on time; what stays doesn't.
    """
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays: five-word shingles, similarity 0.8.

    Rows without a text, without words or without an id are linked with nothing and stay.  Rows with one id are one document: all
    of them stay or go.  Of equal similarities nothing depends: all links of 0.8 and more count.
    """
    return minhash.deduplicated(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has are taken out; every row stays.

    Null and empty texts stay as they are, rows without an id keep their text.  Rows with one id are one document, so none of
    them takes a passage out of another.  Repeats within a document stay.
    """
    return counted(chunks.deduplicated(docs))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets get pseudonyms; every row stays.

    Null and empty texts stay as they are.  Equal values get equal pseudonyms in all rows, repeated or not.
    """
    return counted(pii.rewritten(docs))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' ids with their places in sequences.

    Null and empty texts are their end id alone.  Repeated rows are packed as often as they occur.  A row without an id gives
    pieces without one.  Which of equally long pieces comes where is a matter of their ids and checksums.
    """
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("pseudonyms", pseudonyms),
    ("packed_sequences", packed_sequences),
]

#: Sketches, keyed permutations and vocabularies have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return docs
