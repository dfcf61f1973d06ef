"""Operator 8: language by compression.

Method: for each language raw-content zstandard dictionaries are made of labelled texts.  A text is
lower-cased and cut into blocks; each block is compressed with each language's dictionary, and the
language whose blocks are the smallest in all is chosen.  `rejected` says that the next language was
within a narrow margin of it.

The dictionaries are fitted on a bounded sample of rows: per language, of the different labelled rows, the SAMPLE_TEXTS with the
smallest hashes, their texts whole and of SAMPLE_BYTES together at most.  They make one dictionary, or several of PART bytes where they are longer; a block
counts with the size that the best of them gives.  Rows whose crc32(id as text) mod 5 is 0 are held out.  Prediction
reads the whole text and nothing else.  Every language that a labelled row has is learned; where the
dictionaries of all don't fit into a worker together, texts are read once for each group of languages that does; the driver holds one group at a time.

Defined results: `und` with score 0 for null texts and those without a letter, and for all texts if
nothing was labelled; equal sizes go to the language with more labelled rows, then the smaller name;
texts of any length are read whole, block by block; repeated rows each give a row; an empty table gives
an empty table; other columns aren't read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from pumpline.llm.arrow import byte_slices
from pumpline.llm.shared import discard, written

#: Different rows of a language that its dictionaries are made of, and their bytes: the sample's only bounds.
SAMPLE_TEXTS, SAMPLE_BYTES = 100, 4 << 20
#: Bytes of a dictionary, and of the dictionaries that a worker holds at once (one language at least).
PART, HELD = 1 << 20, 24 << 20
#: Parts of a language in which its rows are limited first.
SALTS = 64
BLOCK = 2048
LEVEL = 9
#: Below this difference, as a share of the text's bytes, the choice counts as rejected.
MARGIN = 0.01
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def fold(id_col: Column, n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(l, n, r, t), a written table: per language the number of labelled rows, and its SAMPLE_TEXTS different rows with the smallest hashes, numbered."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    rows = rows.filter(F.col("l").isNotNull() & F.col("t").isNotNull() & (fold(F.col("i"), 5) != 0)).withColumn("h", F.xxhash64("i", "t"))
    # Rows that repeat are one; a language that many rows have is limited in parts first.
    different = written(rows.groupBy("l", "h").agg(F.count("*").alias("n")), "labels")
    best = lambda df, keys: df.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).filter(F.col("r") <= SAMPLE_TEXTS)
    first = best(best(different.withColumn("s", F.pmod("h", F.lit(SALTS))), ["l", "s"]), ["l"])
    # A table whose size is known: where it is small, texts stay where they are.
    first = written(first.join(different.groupBy("l").agg(F.sum("n").alias("all")), "l").select("l", "h", "r", F.col("all").alias("n")), "chosen")
    texts = written(rows.join(first, ["l", "h"]).groupBy("l", "n", "r").agg(F.min("t").alias("t")), "samples")
    discard(different, first)
    return texts


def groups_of(learned: DataFrame) -> Iterator[list[tuple[str, list[bytes]]]]:
    """(language, contents of its dictionaries) in groups that a worker holds together, languages with the most rows first.

    The driver holds one group: a language has at most SAMPLE_BYTES, in whole texts; if none of its texts is that short, the beginning of one.
    """
    group: list[tuple[str, list[bytes]]] = []
    held = 0
    rows = learned.orderBy(F.desc("n"), "l", "r").select("l", "t")
    for lang, own in itertools.groupby(rows.toLocalIterator(), key=lambda r: r["l"]):
        texts, size, long = [], 0, None
        for raw in (r["t"].lower().encode() for r in own):
            if size + len(raw) < SAMPLE_BYTES:
                texts.append(raw)
                size += len(raw) + 1
            elif long is None:
                long = raw[:SAMPLE_BYTES]
        whole = b"\n".join(texts) if texts or long is None else long
        if group and held + len(whole) > HELD:
            yield group
            group, held = [], 0
        group.append((lang, [whole[i : i + PART] for i in range(0, len(whole), PART)] or [b""]))
        held += len(whole)
    if group:
        yield group


def _compressors(parts: list[bytes]) -> list:
    import zstandard

    out = []
    for content in parts:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


@lru_cache(maxsize=1)
def _held(group: tuple) -> list[list]:
    return [_compressors(list(parts)) for parts in group]


def block_sizes(text: str | None, held: list[list]) -> list[int] | None:
    """The text's compressed bytes by language; null without a letter."""
    if not text or not LETTER.search(text):
        return None
    raw = text.lower().encode()
    blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    return [sum([min([len(c.compress(b)) for c in parts]) if len(parts) > 1 else len(parts[0].compress(b)) for b in blocks]) for parts in held]


def verdict(sizes: list[int] | None, length: int, names: list[str]) -> tuple[str, float, bool]:
    """(language, score, rejected) from a text's compressed sizes and its bytes."""
    if not sizes:
        return UNKNOWN, 0.0, True
    best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
    # Differences in bits as log-odds, at a quarter of their weight: compressors spend some on their own tables.
    score = 1 / sum(math.exp(min(0.0, (sizes[best] - s) * 8 * math.log(2) / 4)) for s in sizes)
    second = min((s for i, s in enumerate(sizes) if i != best), default=None)
    return names[best], score, second is not None and second - sizes[best] < MARGIN * length


def predicted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, whether it was held out, predicted language, score and whether the margin was narrow."""
    learned = samples(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (fold(F.col(id_col), 5) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"), F.array().cast("array<bigint>").alias("sizes"))
    names: list[str] = []
    before, group, made = None, [], []
    for group in groups_of(learned):
        if before is not None:
            rows = written(_sized(rows, before), "languages")
            discard(*made)
            made = [rows]
        names += [lang for lang, _ in group]
        before = group
    discard(learned)
    return _judged(rows, group, names)


def _sized(rows: DataFrame, group: list[tuple[str, list[bytes]]]) -> DataFrame:
    """The rows with the sizes of a group of languages behind those that they have."""
    sent = tuple(tuple(parts) for _, parts in group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, 2):
            got = [None if s is None or (b := block_sizes(t, _held(sent))) is None else [*s, *b] for t, s in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(got, pa.list_(pa.int64()))], part.schema.names)

    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, text string, sizes array<bigint>")


def _judged(rows: DataFrame, group: list[tuple[str, list[bytes]]], names: list[str]) -> DataFrame:
    """The verdicts, after the last group of languages."""
    sent = tuple(tuple(parts) for _, parts in group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, 2):
            got = []
            for t, before in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                sizes = None if before is None or not sent else block_sizes(t, _held(sent))
                got.append(verdict(sizes and [*before, *sizes], len((t or "").lower().encode()), names))
            columns = [part.column(0), part.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")


def op8_language(spark, sf_dir: str) -> DataFrame:
    return predicted(spark.read.parquet(f"{sf_dir}/documents.parquet"))
