"""Operators 1 and 4, and the merging of symbols, against the tokenizer libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pumpline.llm import merges, packing, pieces, wordpieces

SOME = ["", " ", "  two  blanks ", "tab\tand\nline", "Ünïcödé ñandú ça", "日本語 text 😀 é́", "\x00\x1c<s> <unk> <|endoftext|>", "▁mark ▁▁x", "it's we'll DON'T 'S", "ΑΣ İ ǅ", "a" * 3000, "x1y22 3.14!!! --", "\xa0\x85  end", "of of of " * 400]


def fuzz(n, seed=1):
    rng = random.Random(seed)
    alphabet = "  aBtheing\n\t<|>s/日本é́😀\x00ΣİK'll\xa0\x1c0129²¼​-!▁.,"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def piece():
    return pieces.PieceModel(pieces.model_path(None))


@pytest.fixture(scope="module")
def word():
    return wordpieces.WordModel(wordpieces.model_path(None))


def test_pieces_equal_library(piece):
    for t in SOME + fuzz(1500):
        theirs = piece.library.encode(t)
        assert piece.encode(t) == theirs, t
        assert piece.decode(theirs) == piece.library.decode(theirs), t


def test_decoding_of_any_ids(piece):
    rng = random.Random(2)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(0, 300), rng.randrange(3, 32000)]) for _ in range(rng.randint(0, 12))]
        assert piece.decode(ids) == piece.library.decode(ids), ids


def test_difference_to_library_is_an_error(piece):
    broken = pieces.PieceModel(pieces.model_path(None))
    broken.table.score = -broken.table.score
    with pytest.raises(ValueError):
        broken.encode("thinking about something")


def test_words_equal_library(word):
    texts = SOME + fuzz(1500) + [" ".join(fuzz(20000, 3))]
    for t, mine in zip(texts, word.encode_all(texts)):
        assert mine.tolist() == word.library.encode(t, add_special_tokens=False).ids, t[:80]


def test_full_tables_are_emptied(word, monkeypatch):
    small = wordpieces.WordModel(wordpieces.model_path(None))
    monkeypatch.setattr(wordpieces, "KEPT_WORDS", 400)
    for seed in range(6):
        for t, mine in zip(fuzz(30, seed), small.encode_all(fuzz(30, seed))):
            assert mine.tolist() == word.library.encode(t, add_special_tokens=False).ids


def test_matrix_and_heap_agree(piece):
    rng = random.Random(4)
    words = ["".join(rng.choice("▁theinga") for _ in range(rng.randint(1, 20))) for _ in range(300)]
    for w, ids in zip(words, piece.table.merge(words, piece.char.__getitem__)):
        assert ids == piece.table.merge_one(piece.char[merges.code_points(w)].tolist())


def test_op1_table(spark, docs, piece):
    texts = [None, *SOME, "same", "same"]
    rows = pieces.round_trip_digests(docs(texts, extra=True)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = piece.library.encode(texts[r.doc_id] or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(piece.library.decode(ids)))
    assert pieces.round_trip_digests(docs([])).count() == 0
    encoded = pieces.encode(docs(SOME))
    assert {r.doc_id: r.text for r in pieces.decode(encoded).collect()} == {i: piece.library.decode(piece.library.encode(t)) for i, t in enumerate(SOME)}


@pytest.mark.parametrize("texts", [[None, "", *SOME, *["equal words here"] * 30, "long words " * 3000], ["of the " * 540] * 25, []])
def test_op4_packing(spark, docs, word, texts):
    rows = packing.packed(docs(texts, extra=True)).collect()
    ids = {i: [*x.tolist(), 1] for i, x in enumerate(word.encode_all([t or "" for t in texts]))}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for d, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[d])
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][r.start : at], "<u4").tobytes())
        assert at == len(ids[d])
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(by_seq) * 2048 - total <= max(2048, 0.04 * total)


def test_op4_repeated_rows(spark, docs, word):
    """Rows that are equal in all columns: each has pieces of its own, and they are spread over the groups."""
    text = "of the " * 1500
    rows = packing.packed(docs([(7, text, "en", "s", 1)] * 200)).collect()
    n = len(word.encode_all([text])[0]) + 1
    assert sum(r.length for r in rows) == 200 * n and {r.doc_id for r in rows} == {7}
    assert set(Counter((r.start, r.length, r.ids_crc32) for r in rows).values()) == {200}
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for parts in by_seq.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 2048
    made = packing.written(docs([(7, text, "en", "s", 1)] * 200).selectExpr("doc_id", "0L AS start", "1L AS ids_crc32"), "pieces")
    assert max(r["count"] for r in packing.dealt(made, 4).groupBy("deal").count().collect()) < 100


def test_patterns_use_every_length():
    rng = random.Random(5)
    for most in (16, 2048):
        histogram = Counter(rng.randint(1, most) for _ in range(3000))
        found = packing.patterns(histogram, most)
        used = Counter()
        for lengths, n in found:
            assert sum(lengths) <= most
            for x in lengths:
                used[x] += n
        assert used == histogram and packing.fill(found, most) > 0.97
    assert packing.cut_again({2048: 2, 1100: 3}, 512) == {2048: 2, 512: 6, 76: 3}
