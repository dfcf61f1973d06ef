"""Operator 7: substring dedup by content-defined chunks.

Method: a gear rolling hash (a table value per byte, shifted and added, over the last 16 bytes) runs over the
text's UTF-8 bytes.  A chunk ends where the hash is smaller than at the 16 positions before and not larger
than at the 16 after it, so cuts depend on nearby content alone and an insertion moves only the chunks that it
touches; without a cut a chunk ends after MAX_CHUNK bytes.  Chunks are deduplicated by their 64-bit digest: the
document with the smallest id that has a chunk keeps it, and in the others it is a copy.  Runs of copies,
shortened to whole words, are taken out of the text where they have MIN_WORDS words and more.  One equal digest of different chunks
in 2**64 pairs can't make a run: a run takes several chunks in a row.

A run loses up to about 30 bytes and half a chunk at each side of a repeated passage to chunks that reach beyond it;
those words stay.  So MIN_WORDS is two thirds of the 50 words that a repeated passage is to have.  Repeats within one document aren't touched.

Two shuffles of (digest, document) rows find the copies: the first, pre-aggregated, makes each repeated
digest's keeper; the second joins them.  The joined digest side has one row per digest, so a digest that very
many documents share is a skewed join that adaptive execution splits.  A third moves the texts to their runs.

Defined results: null and empty texts stay as they are; texts of any length are chunked whole; rows with
the same id count as one document; rows without an id keep their text; an empty table gives an empty table.
`deduplicated` keeps all the given columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pumpline.llm.arrow import byte_slices

MIN_WORDS = 33
#: Not a multiple of short periods: chunks of a repeated word then take every phase.
MAX_CHUNK = 127
SPREAD = 16
#: A value per byte, by a multiplicative rule.
GEAR = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(29))).astype(np.uint64)
GEAR = ((GEAR ^ (GEAR >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)


def cuts(raw: bytes) -> list[int]:
    """Where chunks begin and end: 0, the cuts, the length."""
    n = len(raw)
    data = np.frombuffer(raw, np.uint8)
    found: list[int] = []
    if n > 3 * SPREAD:
        h = GEAR[data]
        for k in (1, 2, 4, 8):
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        least = h
        for k in (1, 2, 4, 8):
            least = np.minimum(least[:-k], least[k:])  # in the end over 16 positions from each
        i = np.arange(SPREAD, n - SPREAD)
        here = h[SPREAD : n - SPREAD]
        ends = i[(here < least[: len(i)]) & (here <= least[SPREAD + 1 : SPREAD + 1 + len(i)])] + 1
        found = ends[(data[ends] & 0xC0) != 0x80].tolist()  # not inside a character
    out = [0]
    for c in [*found, n]:
        while c - out[-1] > MAX_CHUNK:
            at = out[-1] + MAX_CHUNK
            while at > out[-1] + 1 and (raw[at] & 0xC0) == 0x80:
                at -= 1
            out.append(at)
        if c > out[-1]:
            out.append(c)
    return out


def digests(raw: bytes, at: list[int]) -> list[int]:
    from xxhash import xxh3_64_intdigest

    return [xxh3_64_intdigest(raw[a:b]) - (1 << 63) for a, b in zip(at, at[1:])]


def _chunks(docs: DataFrame) -> DataFrame:
    """(digest, doc_id) of columns id and text, each once for a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, 1):
            got, doc = [], []
            for d, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if raw and d is not None:
                    own = dict.fromkeys(digests(raw, cuts(raw)))
                    got += own
                    doc += [d] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array(doc, pa.int64())], ["digest", "doc_id"])

    return docs.mapInArrow(run, "digest bigint, doc_id bigint")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with chunks that a document with a smaller id has: the list of their digests."""
    made = _chunks(docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string").cast("binary")))
    keepers = made.groupBy("digest").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).filter("keeper < last").select("digest", "keeper")
    found = made.join(keepers, "digest").filter(F.col("doc_id") > F.col("keeper"))
    return found.groupBy("doc_id").agg(F.collect_list("digest").alias("digests"))


def runs(raw: bytes, flagged: list[int] | None, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """The byte ranges to take out: runs of flagged chunks, shortened to whole words, of so many words at least."""
    if not flagged:
        return []
    at = cuts(raw)
    of = digests(raw, at)
    known = set(flagged)
    out: list[tuple[int, int]] = []
    start = None
    for i, x in enumerate([*of, None]):
        if x in known:
            start = at[i] if start is None else start
        elif start is not None:
            a, b = start, at[i]
            start = None
            while 0 < a < b and raw[a - 1 : a] not in (b" ", b"\n", b"\t"):
                a += 1
            while a < b < len(raw) and raw[b : b + 1] not in (b" ", b"\n", b"\t"):
                b -= 1
            if b > a and len(raw[a:b].split()) >= min_words:
                out.append((a, b))
    return out


def taken_out(raw: bytes, ranges: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for a, b in ranges:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]]).decode()


def _joined(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    taken = {c.lower() for c in docs.columns}
    name = next(f"copied_{i}" for i in range(len(taken) + 1) if not {f"copied_{i}", f"copied_{i}_id"} & taken)
    found = copies(docs, id_col, text_col).select(F.col("doc_id").alias(f"{name}_id"), F.col("digests").alias(name))
    return docs.join(found, F.col(f"`{id_col}`").cast("bigint") == F.col(f"{name}_id"), "left").drop(f"{name}_id"), name


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows with all their columns, repeated passages taken out of the text."""
    rows, name = _joined(docs, id_col, text_col)
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, where):
            columns = part.columns
            flagged = columns.pop().to_pylist()
            if any(flagged):
                texts = columns[where].to_pylist()
                for i, f in enumerate(flagged):
                    if f and texts[i]:
                        raw = texts[i].encode()
                        texts[i] = taken_out(raw, runs(raw, f, min_words))
                columns[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, part.schema.names[:-1])

    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], name).mapInArrow(run, docs.schema)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: id, number of runs taken out, their characters, their (start, length) in characters, and the text without them."""
    rows, name = _joined(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, 1):
            texts, spans = part.column(1).to_pylist(), []
            for i, f in enumerate(part.column(2).to_pylist()):
                raw = (texts[i] or "").encode()
                ranges = runs(raw, f, min_words)
                if ranges:
                    texts[i] = taken_out(raw, ranges)
                spans.append([{"start": len(raw[:a].decode()), "length": len(raw[a:b].decode())} for a, b in ranges])
            columns = [part.column(0), pa.array([len(s) for s in spans], pa.int32()), pa.array([sum(x["length"] for x in s) for s in spans], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_runs", "removed_chars", "spans", "text"])

    return rows.select("doc_id", "text", name).mapInArrow(run, "doc_id bigint, n_runs int, removed_chars bigint, spans array<struct<start:bigint,length:bigint>>, text string")


def op7_chunks(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
