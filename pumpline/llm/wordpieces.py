"""Ids of a word-ended byte-level BPE vocabulary, as the tokenizers library gives them.

A text is lower-cased and falls into words at white space; a word's ids depend on nothing else.  Words are
found in a text's bytes and hashed to 128 bits by array operations, and looked up in a table of bounded size that
each worker keeps; new words are merged together in one batch.  Texts whose normalisation isn't plain lower-casing
(decomposed characters, capital sigma, white space outside ASCII, control characters that only some call white
space, the strings of special tokens) go through the library itself.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cached_property, lru_cache

import numpy as np
import regex

from pumpline.llm.merges import MergeTable

#: Words that a worker keeps, and ids of all of them; a full table is emptied.
KEPT_WORDS, KEPT_IDS = 1 << 20, 1 << 22
#: Bytes that are looked at together.
BLOCK = 1 << 21
#: Fixed: the vocabulary's own pattern for parts of a word.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
BY_LIBRARY = re.compile("[\x1c-\x1f\x85\xa0  -     　Σ]|<\\|")
_U = np.uint64


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class WordHash:
    """64-bit polynomial hashes of many slices of one byte string, with random values for the bytes."""

    #: Powers of an odd base and of its inverse, shared by all: what differs is the bytes' values.
    base = 0x5851F42D4C957F2D
    inverse = pow(base, -1, 1 << 64)
    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __init__(self, seed: int):
        self.value = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)

    @classmethod
    def _powers(cls, n: int) -> None:
        while len(cls.up) < n:
            k = len(cls.up)
            cls.up = np.concatenate([cls.up, cls.up * _U(pow(cls.base, k, 1 << 64))])
            cls.down = np.concatenate([cls.down, cls.down * _U(pow(cls.inverse, k, 1 << 64))])

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data)
        self._powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64)
        h ^= h >> _U(31)
        h *= _U(0x9E3779B97F4A7C15)
        return h ^ (h >> _U(29))


class WordTable:
    """From 128-bit hashes to numbers of entries, by open addressing."""

    def __init__(self, most: int):
        self.most, self.mask = most, 4 * most - 1
        self.first, self.second = np.zeros(most, np.uint64), np.zeros(most, np.uint64)
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.slot = np.full(self.mask + 1, -1, np.int32)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        at = (a & _U(self.mask)).astype(np.int64)
        out = self.slot[at]
        open_ = np.flatnonzero((out >= 0) & ((self.first[out] != a) | (self.second[out] != b)))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            got = self.slot[at[open_]]
            out[open_] = got
            open_ = open_[(got >= 0) & ((self.first[got] != a[open_]) | (self.second[got] != b[open_]))]
        return out

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """New, different hashes, as the next entries."""
        entry = np.arange(self.n, self.n + len(a), dtype=np.int32)
        self.first[entry], self.second[entry] = a, b
        self.n += len(a)
        at = (a & _U(self.mask)).astype(np.int64)
        left = np.arange(len(a))
        while len(left):
            free = self.slot[at[left]] < 0
            who = left[free]
            own = np.unique(at[who], return_index=True)[1]
            self.slot[at[who[own]]] = entry[who[own]]
            left = left[self.slot[at[left]] != entry[left]]
            at[left] = (at[left] + 1) & self.mask


class WordModel:
    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.size = max(vocab.values()) + 1
        pairs = [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in model["merges"]]
        ids = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.table = MergeTable([x[0] for x in ids], [x[1] for x in ids], [x[2] for x in ids], -np.arange(len(ids)), self.size)
        chars = byte_characters()
        # A byte that ends its word has another symbol: code 256 + byte.
        self.symbol = np.array([vocab[c] for c in chars] + [vocab[c + end] for c in chars], np.int64)
        self.hashes = WordHash(1), WordHash(2)
        self.words = WordTable(KEPT_WORDS)
        self.start, self.length = np.zeros(KEPT_WORDS, np.int32), np.zeros(KEPT_WORDS, np.int32)
        self.ids, self.used = np.zeros(KEPT_IDS, np.uint32), 0
        blank = np.zeros(256, bool)
        blank[[9, 10, 11, 12, 13, 32]] = True
        self.blank = blank

    @cached_property
    def library(self):
        """The library's own model, made when a text first needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def merged(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        split = [[w] if w.isalpha() else [w[:-1], w[-1]] if w[-1] in ".,!?:;" and w[:-1].isalpha() else PARTS.findall(w) for w in words]
        parts = list({p for x in split for p in x})
        coded = []
        for p in parts:
            raw = p if p.isascii() else p.encode().decode("latin-1")
            coded.append(raw[:-1] + chr(256 + ord(raw[-1])))
        of = dict(zip(parts, self.table.merge(coded, self.symbol.__getitem__)))
        return [of[x[0]] if len(x) == 1 else [i for p in x for i in of[p]] for x in split]

    def _entries(self, raw: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        a, b = (h(data, starts, ends) for h in self.hashes)
        found = self.words.find(a, b)
        lacking = np.flatnonzero(found < 0)
        if len(lacking):
            one = lacking[np.unique(a[lacking], return_index=True)[1]]
            ids = self.merged([raw[s:e].decode() for s, e in zip(starts[one].tolist(), ends[one].tolist())])
            lengths = np.array([len(x) for x in ids], np.int64)
            total = int(lengths.sum())
            if self.words.n + len(one) > KEPT_WORDS or self.used + total > len(self.ids):
                full = self.words.n > 0
                self.words.clear()
                self.used = 0
                if full:
                    return self._entries(raw, data, starts, ends)
                raise ValueError("a block has more words than the table")
            n = self.words.n
            self.start[n : n + len(one)] = self.used + np.cumsum(lengths) - lengths
            self.length[n : n + len(one)] = lengths
            self.ids[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
            self.used += total
            self.words.add(a[one], b[one])
            found[lacking] = self.words.find(a[lacking], b[lacking])
            if (found < 0).any():  # equal first halves only
                return self._entries(raw, data, starts, ends)
        return found

    def word_ids(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of lower-cased text: where words start, how many ids each has, and all ids."""
        data = np.frombuffer(raw, np.uint8)
        blank = self.blank[data]
        edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return starts, starts, np.empty(0, np.uint32)
        entry = self._entries(raw, data, starts, ends)
        length = self.length[entry].astype(np.int64)
        at = np.cumsum(length)
        where = np.repeat(self.start[entry] - at + length, length) + np.arange(at[-1])
        return starts, length, self.ids[where]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit numbers."""
        out: list = [None] * len(texts)
        group: list[bytes] = []
        which: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal group, which, size
            if not group:
                return
            starts, length, ids = self.word_ids(b" ".join(group))
            begins = np.cumsum([0, *(len(g) + 1 for g in group)])
            ends = np.concatenate([[0], np.cumsum(length)])[np.searchsorted(starts, begins)]
            for i, a, b in zip(which, ends.tolist(), ends[1:].tolist()):
                out[i] = ids[a:b]
            group, which, size = [], [], 0

        for i, t in enumerate(texts):
            if BY_LIBRARY.search(t) or not (t.isascii() or unicodedata.is_normalized("NFC", t)):
                out[i] = np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32)
                continue
            raw = t.lower().encode()
            if len(raw) > BLOCK // 2:
                # a long text goes alone, in pieces that end at a blank
                flush()
                out[i] = np.concatenate([self.word_ids(p)[2] for p in _pieces(raw)])
                continue
            group.append(raw), which.append(i)
            size += len(raw)
            if size > BLOCK // 2:
                flush()
        flush()
        return out


def _pieces(raw: bytes):
    at = 0
    while at < len(raw):
        end = at + BLOCK // 2
        if end < len(raw):
            cut = max(raw.rfind(b" ", at, end), raw.rfind(b"\n", at, end))
            if cut < 0:
                follow = [x for x in (raw.find(b" ", end), raw.find(b"\n", end)) if x >= 0]
                cut = min(follow, default=len(raw))
            end = cut + 1
        yield raw[at:end]
        at = end


@lru_cache(maxsize=2)
def word_model(path: str) -> WordModel:
    return WordModel(path)


def model_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
