"""Operator 4: packing of documents into sequences of a fixed length.

Method: shortest pack first, over the histogram of lengths.  A document's ids, with an end id, are cut
into pieces of at most the sequence's length.  The histogram of piece lengths - never longer than a
sequence, however many documents there are - comes to the driver.  There lengths are placed longest
first: so many pieces of a length go to the emptiest kind of pack with room as there are packs of that
kind, which thereby become another kind; what finds no room opens packs.  Each kind of pack is a
pattern with a count.  A pattern's slots are intervals of ranks: the pieces of a length are numbered, and
the piece whose number lies in a slot's interval goes there.

The numbering is distributed: pieces of a length are dealt by a hash into groups, the groups' counts are
summed up in order, and only within a group are rows numbered by a window; a length that very many
documents share is spread over as many groups.

Lengths that don't go together - many documents of just over half a sequence - would leave padding.  If
the histogram shows that, the last pieces of documents are cut into halves, quarters and so on until little
is left, and the pieces are made again with that cut.

Piece lengths are made once and kept as a table in the shared folder (a few dozen bytes a piece).

Defined results: null text counts as empty, an empty text is its end id alone; a text of any length is
cut into pieces; repeated rows are packed as often as they occur; an empty table gives an empty table;
other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pumpline.llm.arrow import byte_slices
from pumpline.llm.shared import written
from pumpline.llm.wordpieces import model_path, word_model

LENGTH = 2048
END_ID = 1
#: Below this share of ids, shorter pieces are cut.
LEAST_FILL = 0.98


def pieces(docs: DataFrame, path: str | None = None, most: int = LENGTH, cut: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: document, start, length, CRC-32 of the ids, and the document's number of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end = word_model(model_path(path)), np.array([end_id], "<u4").tobytes()
        for part in byte_slices(batches, 1):
            doc, at, length, crc, total = [], [], [], [], []
            encoded = model.encode_all([t or "" for t in part.column(1).to_pylist()])
            for d, ids in zip(part.column(0).to_pylist(), encoded):
                ids = ids.astype("<u4").tobytes() + end
                n = len(ids) // 4
                full = n - n % most
                for i in [*range(0, full, most), *range(full, n, cut)]:
                    piece = ids[4 * i : 4 * (i + (most if i < full else cut))]
                    doc.append(d), at.append(i), length.append(len(piece) // 4), crc.append(zlib.crc32(piece)), total.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, at, length, crc, total)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def patterns(histogram: dict[int, int], most: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, count) of the packs; the lengths of a pattern never grow."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        # from the emptiest on; kinds that arise have less room and get their turn in the same pass
        for room in range(most, length - 1, -1):
            kinds = by_room.get(room)
            while kinds and left:
                pack, count = kinds.pop()
                taken = min(count, left)
                left -= taken
                if count > taken:
                    kinds.append((pack, count - taken))
                by_room.setdefault(room - length, []).append(((*pack, length), taken))
            if not left:
                break
        while left:
            # What found no room opens packs of this length alone, as full as they get.
            each = most // length
            if left >= each:
                by_room.setdefault(most - each * length, []).append(((length,) * each, left // each))
                left %= each
            else:
                by_room.setdefault(most - left * length, []).append(((length,) * left, 1))
                left = 0
    return [x for kinds in by_room.values() for x in kinds]


def slots(found: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end of ranks, first sequence, offset) of each place in a pattern."""
    out, next_rank, sequence = [], {}, 0
    for lengths, count in found:
        offset = 0
        for length in lengths:
            rank = next_rank.get(length, 0)
            out.append((length, rank, rank + count, sequence, offset))
            next_rank[length] = rank + count
            offset += length
        sequence += count
    return out


def fill(found: list[tuple[tuple[int, ...], int]], most: int = LENGTH) -> float:
    """The share of ids in the sequences; one whose length is a power of two isn't padded."""
    ids = sum(sum(x) * n for x, n in found)
    return ids / max(sum((sum(x) if sum(x) & (sum(x) - 1) == 0 else most) * n for x, n in found), 1)


def cut_again(histogram: dict[int, int], cut: int, most: int = LENGTH) -> dict[int, int]:
    """The histogram after pieces shorter than a sequence are cut into pieces of at most `cut`."""
    out: dict[int, int] = {}
    for length, n in histogram.items():
        parts = [(length, 1)] if length == most else [(cut, length // cut), (length % cut, 1)]
        for part, times in parts:
            if part and times:
                out[part] = out.get(part, 0) + n * times
    return out


def dealt(made: DataFrame, groups: int) -> DataFrame:
    """The pieces of a written table with their group; a place in the table's files tells equal rows apart, and is the same if a task runs again."""
    return made.withColumn("deal", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "_metadata.file_name", "_metadata.row_index"), F.lit(groups)).cast("int"))


def packed(docs: DataFrame, path: str | None = None, most: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: its document, place in the document, checksum, sequence and place in the sequence."""
    spark = docs.sparkSession
    made = written(pieces(docs, path, most, most, end_id, id_col, text_col), "pieces")
    histogram = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}  # at most `most` rows
    cut, found = most, patterns(histogram, most)
    while fill(found, most) < LEAST_FILL and cut > max(most // 32, 1) and sum(n for _, n in found) > 1:
        cut //= 2
        found = patterns(cut_again(histogram, cut, most), most)
    if cut < most:
        made = written(pieces(docs, path, most, cut, end_id, id_col, text_col), "pieces")
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    made = dealt(made, groups)
    counts = made.groupBy("length", "deal").count()
    before = counts.select("length", "deal", (F.sum("count").over(Window.partitionBy("length").orderBy("deal")) - F.col("count")).alias("before"))
    numbered = made.withColumn("own", F.row_number().over(Window.partitionBy("length", "deal").orderBy("doc_id", "start")) - 1)
    ranked = numbered.join(before, ["length", "deal"]).withColumn("rank", F.col("before") + F.col("own"))
    places = spark.createDataFrame(slots(found), "length bigint, low bigint, high bigint, sequence bigint, offset bigint")
    # A pattern never has more slots than a sequence has ids, and the number of patterns depends on `most` alone.
    joined = ranked.alias("r").join(F.broadcast(places).alias("s"), (F.col("r.length") == F.col("s.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return joined.select("doc_id", "start", F.col("r.length").alias("length"), "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
