"""Operator 1: encoding and decoding with a merge-type SentencePiece vocabulary.

Method: a score-ordered agenda of adjacent symbol pairs (`merges.MergeTable`).  No piece of such a
vocabulary has the space mark after another character (this is checked when it is loaded), so a text
falls into segments - space marks, then other characters - that merge independently.  Each segment
is encoded once per worker and kept in a table of bounded size.  In each Arrow batch the segments
that are new are checked against the sentencepiece library, ids and decoded text; a difference
raises an error.

Defined results: null text counts as empty; an empty text has no ids and decodes to an empty text;
texts of any length are encoded whole (segments without a space of any length go through a heap);
repeated rows each give a row; an empty table gives an empty table.  Columns besides the id and text
columns aren't read, so extra or clashing names don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pumpline.llm.arrow import byte_slices
from pumpline.llm.merges import Kept, MergeTable

MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
#: Segments that a worker keeps, and as many older ones.
KEPT_SEGMENTS = 300_000
ENCODED = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class PieceModel:
    """A vocabulary read from a model file; encodes and decodes segments and texts."""

    def __init__(self, path: str, check: bool = True):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.check = check
        self.size = n = sp.vocab_size()
        self.unknown = sp.unk_id()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_of = {i: int(pieces[i][1:-1], 16) for i in range(n) if sp.is_byte(i)}
        self.of_byte = {b: i for i, b in self.byte_of.items()}
        special = {i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)}
        self.control = special - set(self.byte_of) - {self.unknown}
        normal = {pieces[i]: i for i in range(n) if i not in special}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece has a space mark after another character: texts don't fall into segments")
        if len(self.of_byte) != 256:
            raise ValueError("only vocabularies with byte fallback are supported")
        if sp.encode("a  b ", out_type=str) and "".join(sp.encode("a  b ", out_type=str)) != f"{MARK}a{MARK}{MARK}b{MARK}":
            raise ValueError("the model normalises its input")
        self.piece = pieces
        self.char = np.arange(0x110000, dtype=np.int64) + n  # an unknown character stands for itself
        for p, i in normal.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        left, right, merged, score = [], [], [], []
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = self._symbol(normal, p[:cut]), self._symbol(normal, p[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(i), score.append(sp.get_score(i))
        self.table = MergeTable(left, right, merged, score, n + 0x110000)
        self.shown = [" \u2047 " if i == self.unknown else "" if i in self.control else p.replace(MARK, " ") for i, p in enumerate(pieces)]
        self.after_bytes = max(self.byte_of) + 1
        self.name = [str(i) for i in range(n)]
        self.kept = Kept(KEPT_SEGMENTS)

    def _symbol(self, normal: dict, text: str):
        return int(self.char[ord(text)]) if len(text) == 1 else normal.get(text)

    def _ids(self, symbols: list[int]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            if s < self.size:
                out.append(s)
            else:
                out += [self.of_byte[b] for b in chr(s - self.size).encode()]
        return out

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        merged = self.table.merge(segments, self.char.__getitem__)
        return [x if max(x) < self.size else self._ids(x) for x in merged]

    def decode_raw(self, ids) -> str:
        """The pieces' text with spaces for marks; runs of byte pieces are read as UTF-8."""
        shown, least = self.shown, self.after_bytes
        if not ids or min(ids) >= least:
            return "".join([shown[i] for i in ids])
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            out.append(shown[i])
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out)

    def decode(self, ids) -> str:
        """As the library's decode: the space of a first mark, which encoding puts there, is left out."""
        raw = self.decode_raw(ids)
        first = next((i for i in ids if i not in self.control), None)
        return raw[1:] if first is not None and self.piece[first].startswith(MARK) else raw

    def segments(self, text: str) -> list[str]:
        return SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, segments: set) -> None:
        """Encodes the segments not yet kept, and checks them against the library in one call."""
        new = self.kept.lacking(segments)
        if not new:
            return
        encoded = self.encode_segments(new)
        decoded = [self.decode_raw(ids) for ids in encoded]
        if self.check:
            self._compare(new, encoded, decoded)
        kept, name = self.kept, self.name
        for s, ids, text in zip(new, encoded, decoded):
            kept[s] = (len(ids), ",".join([name[i] for i in ids]), text)

    def _compare(self, segments: list[str], encoded: list[list[int]], decoded: list[str]) -> None:
        """Segments in a row are a text; those of marks alone would join with the next and go one by one."""
        marks = [i for i, s in enumerate(segments) if not s.strip(MARK)]
        alone = set(marks)
        rest = [i for i in range(len(segments)) if i not in alone] if alone else range(len(segments))
        groups = [rest[i : i + 256] for i in range(0, len(rest), 256)] + [[i] for i in marks if len(segments[i]) > 1]
        texts = ["".join([segments[i] for i in g])[1:] for g in groups]
        mine = [[x for i in g for x in encoded[i]] for g in groups]
        for g, text, ids, theirs in zip(groups, texts, mine, self.library.encode(texts, num_threads=1)):
            if theirs != ids:
                at = next((i for i, (a, b) in enumerate(zip(ids, theirs)) if a != b), min(len(ids), len(theirs)))
                raise ValueError(f"the library's ids differ: {theirs[at:at + 8]}, not {ids[at:at + 8]}, in {text[:200]!r}")
            if self.library.decode(ids) != "".join([decoded[i] for i in g])[1:]:
                raise ValueError(f"the library's decoded text differs, in {text[:200]!r}")

    def entries(self, texts: list[str]) -> list[list[tuple]]:
        """Per text, of each segment: number of ids, ids joined by commas, text."""
        return self.kept.rows([self.segments(t) for t in texts], self.learn)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for e in self.entries([text or ""])[0] for i in e[1].split(",")]


def _utf8(run: bytes) -> str:
    """Valid sequences as they are, each other byte as U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[at : at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\ufffd")
            size = 1
        at += size
    return "".join(out)


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def model_path(path: str | None) -> str:
    """The given model file, or the public one where its package is installed."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def round_trip_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the number of ids of the whole text, and digests of the ids and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path(path))
        for part in byte_slices(batches, 1):
            n, ids, back = [], [], []
            for got in model.entries([t or "" for t in part.column(1).to_pylist()]):
                n.append(sum(e[0] for e in got))
                ids.append(hashlib.sha256(",".join([e[1] for e in got]).encode()).hexdigest())
                raw = "".join([e[2] for e in got])
                back.append(hashlib.sha256(raw[1:].encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, ENCODED)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id and the ids of its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path(path))
        for part in byte_slices(batches, 1):
            ids = [model.encode(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: its id and the text that its ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path(path))
        for part in byte_slices(batches, 1):
            texts = [model.decode(x or []) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("bigint"), F.col(ids_col)).mapInArrow(run, "doc_id bigint, text string")


def op1_pieces(spark, sf_dir: str) -> DataFrame:
    return round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
