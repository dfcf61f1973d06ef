"""Merging of adjacent symbols in the order of their scores, for many short words at once.

A merge table says which two symbols join into which third, and with what score.  A word starts as a
row of symbols; the agenda holds the score of every adjacent pair, the best pair (the leftmost of
equals) is joined, and the two pairs at its sides are entered anew, until no pair is left.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Words longer than this go through the heap instead of the matrix.
MATRIX_LENGTH = 24


class Kept(dict):
    """A table of bounded size: when it is full it becomes the older one, whose entries come back when asked for."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def __missing__(self, key):
        value = self[key] = self.older[key]
        return value

    def lacking(self, keys: set) -> list:
        """The keys in neither table, with room made for them."""
        if len(self) + len(keys) > self.most:
            self.older = dict(self)
            self.clear()
        older = self.older
        return [k for k in keys if k not in self and k not in older]


    def rows(self, rows: list[list], learn) -> list[list]:
        """The values of each row's keys; learn gets the set of those that aren't kept and keeps them."""
        out = [list(map(self.get, r)) for r in rows]
        open_ = [i for i, r in enumerate(out) if None in r]
        learn({k for i in open_ for k, v in zip(rows[i], out[i]) if v is None})
        for i in open_:
            out[i] = [self[k] if v is None else v for k, v in zip(rows[i], out[i])]
        return out


class MergeTable:
    """Pairs of symbol ids with the id and score of what they join into."""

    def __init__(self, left, right, merged, score, n_symbols: int):
        self.n = int(n_symbols)
        keys = np.asarray(left, np.int64) * self.n + np.asarray(right, np.int64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        self.merged = np.asarray(merged, np.int64)[order]
        self.score = np.asarray(score, np.float64)[order]
        if keys.size and (keys[1:] == keys[:-1]).any():
            raise ValueError("a pair of symbols joins into two different symbols")
        # Open addressing: one or two probes find nearly every pair, the rest is looked up by bisection.
        self.bits = max(10, int(np.ceil(np.log2(max(keys.size, 1) * 8))))
        self.keys = keys
        slots = self._slot(keys)
        self.table = np.full(1 << self.bits, -1, np.int64)
        self.table_key = np.full(1 << self.bits, -1, np.int64)
        first = np.unique(slots, return_index=True)[1]
        self.table[slots[first]] = first
        self.table_key[slots[first]] = keys[first]
        crowded = np.setdiff1d(np.arange(keys.size), first)
        self.rest = keys[crowded]
        self.rest_at = crowded
        self.crowded = np.zeros(1 << self.bits, bool)
        self.crowded[slots[crowded]] = True
        self.by_key = None

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left, right):
        """(merged, score) of each pair; score is -inf where the two don't join."""
        keys = left * self.n + right
        slots = self._slot(keys)
        at = np.where(self.table_key[slots] == keys, self.table[slots], -1)
        if self.rest.size:
            ask = np.flatnonzero((at < 0) & self.crowded[slots])
            if ask.size:
                spot = np.minimum(np.searchsorted(self.rest, keys[ask]), self.rest.size - 1)
                hit = self.rest[spot] == keys[ask]
                at[ask[hit]] = self.rest_at[spot[hit]]
        found = at >= 0
        return np.where(found, self.merged[at], -1), np.where(found, self.score[at], -np.inf)

    def merge_one(self, symbols: list[int]) -> list[int]:
        """Any length, by a heap: a popped pair counts only if both symbols still stand as they did."""
        if self.by_key is None:
            self.by_key = dict(zip(self.keys.tolist(), zip(self.merged.tolist(), self.score.tolist())))
        table, n = self.by_key, self.n
        sym, size = list(symbols), len(symbols)
        before, after = list(range(-1, size - 1)), [*range(1, size), -1]
        agenda = []

        def enter(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (hit := table.get(sym[a] * n + sym[b])):
                heapq.heappush(agenda, (-hit[1], a, b, sym[a], sym[b], hit[0]))

        for i in range(size - 1):
            enter(i, i + 1)
        while agenda:
            _, a, b, x, y, made = heapq.heappop(agenda)
            if sym[a] != x or sym[b] != y or after[a] != b:
                continue
            sym[a], sym[b] = made, -1
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            enter(before[a], a)
            enter(a, after[a])
        return [s for s in sym if s >= 0]

    def _matrix(self, sym: np.ndarray, which: list[int], out: list) -> None:
        """sym: words of one length, a row each; out gets each word's symbols at its place in `which`."""
        row = np.asarray(which)
        made, score = self.find(sym[:, :-1].ravel(), sym[:, 1:].ravel())
        made, score = made.reshape(len(row), -1), score.reshape(len(row), -1)
        while sym.shape[1] > 1 and len(row):
            at = score.argmax(axis=1)
            going = score[np.arange(len(at)), at] > -np.inf
            if not going.all():
                for r, s in zip(row[~going].tolist(), sym[~going].tolist()):
                    out[r] = s
                row, sym, made, score, at = row[going], sym[going], made[going], score[going], at[going]
            lines, width = np.arange(len(row)), sym.shape[1]
            sym[lines, at] = made[lines, at]
            later = at[:, None]
            sym = np.take_along_axis(sym, np.arange(width - 1) + (np.arange(width - 1) > later), 1)
            keep = np.arange(width - 2) + (np.arange(width - 2) >= later)
            made, score = np.take_along_axis(made, keep, 1), np.take_along_axis(score, keep, 1)
            for shift in (-1, 0):
                pair = at + shift
                ok = np.flatnonzero((pair >= 0) & (pair < width - 2))
                pair = pair[ok]
                made[ok, pair], score[ok, pair] = self.find(sym[ok, pair], sym[ok, pair + 1])
        for r, s in zip(row.tolist(), sym.tolist()):
            out[r] = s

    def merge(self, words: list[str], symbols) -> list[list[int]]:
        """The symbols that each word ends as; symbols: from an array of code points to one of their symbols."""
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        out: list = [None] * len(words)
        for length, which in by_length.items():
            if length <= MATRIX_LENGTH:
                sym = symbols(code_points("".join([words[i] for i in which]))).reshape(len(which), length)
                self._matrix(sym, which, out)
            else:
                for i in which:
                    out[i] = self.merge_one(symbols(code_points(words[i])).tolist())
        return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)
