"""Operator 13: product codes of vectors, by integer k-means with kd-trees.

Method.  Each component x becomes the integer floor(SCALE * x), and a vector is cut into PARTS consecutive parts.  A
part position's codebook starts as that part of the ENTRIES vectors with the smallest ids.  Each round the driver builds a kd-tree of
every codebook and broadcasts them (at most ENTRIES entries each, so their size is bounded whatever the table's); tasks
search all their vectors by branch and bound and send, per entry, the number and the integer sums of its parts, which Spark adds
up; an entry becomes the floor of its parts' mean.  A node is left out only if its box is farther than the best entry so far; nodes whose box
is equally far are visited, so that of equally near entries the one with the lowest index is found.  All numbers are integers
and all sums exact: neither the order of rows nor how they are dealt to tasks matters.

A task takes a batch of vectors through the tree together: at each node those for which it can't be left out go on, the
nearer child first.

Defined results: rows whose vector is null or holds null or non-finite components take no part, nor do those of
another length than most (of equally frequent lengths the smaller counts).  Where the length is no multiple of PARTS, the first parts have one component more.
Rows without an id are coded, and come last when the first entries are chosen; of rows with one id the smaller
vector comes first; repeated rows count as often as they occur.  With fewer rows than ENTRIES the codebooks are as small; an
entry that no part is nearest to stays as it is.  Components so large that a squared distance would not fit into 64 bits are an error.
Labels are equal if both are null.  An empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pumpline.llm.shared import written

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
LEAF = 8
#: Vectors that go through a tree together.
TOGETHER = 8192
FAR = np.iinfo(np.int64).max


class Tree:
    """A kd-tree of a codebook's entries; nodes hold the boxes of their entries."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.low, self.high, self.children, self.held = [], [], [], []
        self._grow(np.arange(len(entries)))

    def _grow(self, held: np.ndarray) -> int:
        at, own = len(self.low), self.entries[held]
        self.low.append(own.min(axis=0))
        self.high.append(own.max(axis=0))
        self.children.append(None)
        self.held.append(held)
        spread = self.high[at] - self.low[at]
        if len(held) > LEAF and spread.any():
            order = held[np.argsort(own[:, spread.argmax()], kind="stable")]
            half = len(order) // 2
            self.children[at] = (self._grow(np.sort(order[:half])), self._grow(np.sort(order[half:])))
        return at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest entry, of equally near ones the lowest, and the squared distance."""
        most = max([1, *(int(np.abs(a).max()) for a in (x, self.entries) if a.size)])
        if (2 * most) ** 2 * max(1, x.shape[1]) >= 1 << 62:
            raise ValueError("a component is too large for 64-bit squared distances")
        kind = np.float64 if (2 * most) ** 2 * max(1, x.shape[1]) < 1 << 52 else np.int64  # doubles are exact up to there
        best, index = np.full(len(x), FAR if kind is np.int64 else np.inf, kind), np.full(len(x), len(self.entries))
        x, entries = x.astype(kind), self.entries.astype(kind)
        squares, own_squares = (x * x).sum(axis=1), (entries * entries).sum(axis=1)
        low, high = np.array(self.low).astype(kind), np.array(self.high).astype(kind)

        def bound(node: int, rows: np.ndarray) -> np.ndarray:
            off = np.maximum(np.maximum(low[node] - x[rows], x[rows] - high[node]), 0)
            return (off * off).sum(axis=1)

        def visit(node: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if self.children[node] is None:
                held = self.held[node]
                d = squares[rows, None] + own_squares[held] - 2 * (x[rows] @ entries[held].T)  # whole numbers, so exact
                at = d.argmin(axis=1)  # entries of a leaf are in order of their index
                d, at = d[np.arange(len(rows)), at], held[at]
                better = (d < best[rows]) | ((d == best[rows]) & (at < index[rows]))
                best[rows[better]], index[rows[better]] = d[better], at[better]
                return
            sides = self.children[node]
            bounds = [bound(c, rows) for c in sides]
            first = bounds[0] <= bounds[1]
            for near, far, chosen in ((0, 1, first), (1, 0, ~first)):
                own = rows[chosen]
                visit(sides[near], own[bounds[near][chosen] <= best[own]])
                visit(sides[far], own[bounds[far][chosen] <= best[own]])

        visit(0, np.arange(len(x)))
        return index, best.astype(np.int64)


def parts_of(length: int, parts: int) -> list[slice]:
    sizes = [length // parts + (i < length % parts) for i in range(parts)]
    ends = np.cumsum(sizes).tolist()
    return [slice(e - s, e) for s, e in zip(sizes, ends)]


def integers(vectors: pa.Array, length: int, scale: int = SCALE) -> np.ndarray:
    """A column of lists of one length as a matrix of integers."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
    flat = np.floor(flat * scale)
    if flat.size and np.abs(flat).max() >= 1 << 31:
        raise ValueError("a component is too large for 64-bit squared distances")
    return flat.astype(np.int64)


def batches_of(batches: Iterator[pa.RecordBatch], column: int, length: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            yield part, integers(part.column(column), length, scale)


def kept(vectors: Column) -> Column:
    """Neither null nor with null or non-finite components."""
    x = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return vectors.isNotNull() & ~F.coalesce(F.exists(vectors, x), F.lit(True))


def sums(rows: DataFrame, trees, slices: list[slice], length: int, scale: int) -> DataFrame:
    """(part, entry, n, s0, s1, ...): the parts that are nearest to each entry, and their sums by component."""
    width = max(s.stop - s.start for s in slices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = trees.value
        total = [np.zeros((len(t.entries), t.entries.shape[1]), np.int64) for t in found]
        count = [np.zeros(len(t.entries), np.int64) for t in found]
        for _, x in batches_of(batches, 0, length, scale):
            for part, (tree, cut) in enumerate(zip(found, slices)):
                entry, _ = tree.nearest(x[:, cut])
                order = np.argsort(entry, kind="stable")
                own, starts = np.unique(entry[order], return_index=True)
                total[part][own] += np.add.reduceat(x[order, cut], starts, axis=0)
                count[part] += np.bincount(entry, minlength=len(count[part]))
        for part, (t, n) in enumerate(zip(total, count)):
            used = np.flatnonzero(n)
            columns = [pa.array(np.full(len(used), part, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used])]
            columns += [pa.array(t[used, i] if i < t.shape[1] else np.zeros(len(used), np.int64)) for i in range(width)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", *(f"s{i}" for i in range(width))])

    of_tasks = rows.mapInArrow(run, "part int, entry int, n bigint, " + ", ".join(f"s{i} bigint" for i in range(width)))
    return of_tasks.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])


def codebooks(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """A matrix of entries for each part; rows: columns id and vector, of which none is null or not finite."""
    slices = parts_of(length, parts)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    start = integers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), length, scale)
    books = [start[:, cut].copy() for cut in slices]
    context = rows.sparkSession.sparkContext
    for _ in range(rounds):
        trees = context.broadcast([Tree(b) for b in books])
        # At most as many rows as all codebooks have entries.
        for r in sums(rows.select("vector"), trees, slices, length, scale).collect():
            book = books[r["part"]]
            book[r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(book.shape[1])]
        trees.unpersist()
    return books


def coded(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256 of each row that takes part."""
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits show 1 to 256 entries")
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    rows = rows.filter(kept(F.col("vector")))
    kind = rows.schema["label"].dataType.simpleString()
    lengths = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    length = lengths[0]["n"] if lengths else 0
    rows = rows.filter(F.size("vector") == length)
    books = codebooks(rows, length, parts, entries, rounds, scale) if lengths else []
    slices, trees = parts_of(length, parts), rows.sparkSession.sparkContext.broadcast([Tree(b) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in batches_of(batches, 1, length, scale):
            code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for i, (tree, cut) in enumerate(zip(trees.value, slices)):
                entry, d = tree.nearest(x[:, cut])
                code[:, i], error = entry, error + d
            shown = pa.array([c.tobytes().hex() for c in code], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), shown, pa.array(error), part.column(2)], ["vec_id", "code", "error", "label"])

    out = written(rows.mapInArrow(run, f"vec_id bigint, code string, error bigint, label {kind}"), "codes")
    of_labels = out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return out.join(of_labels, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_codes(spark, sf_dir: str) -> DataFrame:
    return coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """All rounds written out: distances of every part to every entry, without a tree."""
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, label, embedding AS e, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"q AS (SELECT r, unnest(e) AS x, unnest(range(len(e))) AS i, len(e) // {PARTS} AS w FROM v)",
        f"p AS MATERIALIZED (SELECT r, i // w AS part, i % w AS pos, CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM q)",
        f"c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, x FROM p WHERE r <= {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        steps += [
            f"d{k} AS (SELECT p.r, p.part, c.entry, sum((p.x - c.x) * (p.x - c.x)) AS d FROM p JOIN c{k} c ON p.part = c.part AND p.pos = c.pos GROUP BY p.r, p.part, c.entry)",
            f"n{k} AS MATERIALIZED (SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM d{k} GROUP BY r, part)",
        ]
        if k < ROUNDS:
            steps += [
                f"m{k} AS (SELECT n.part, n.entry, p.pos, sum(p.x) AS s, count(*) AS n FROM n{k} n JOIN p ON n.r = p.r AND n.part = p.part GROUP BY n.part, n.entry, p.pos)",
                f"c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.pos, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x) AS x FROM c{k} c LEFT JOIN m{k} m ON m.part = c.part AND m.entry = c.entry AND m.pos = c.pos)",
            ]
    steps += [
        f"o AS (SELECT v.vec_id, v.label, string_agg(printf('%02x', n.entry), '' ORDER BY n.part) AS code, CAST(sum(n.d) AS BIGINT) AS error FROM v JOIN n{ROUNDS} n ON n.r = v.r GROUP BY v.r, v.vec_id, v.label)",
        f"h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{ROUNDS})",
    ]
    return "WITH " + ", ".join(steps) + " SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o, h"


ORACLE = _sql()
