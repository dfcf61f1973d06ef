"""Operator 6: approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Method.  Vectors are scaled to a largest component of 1 - so multiples of one another become equal and tie exactly - and to
unit vectors, which a Gaussian matrix projects to PROJECTED dimensions, where the square of a
projected distance over that of the true one is chi-square distributed.  A kd-tree fitted on a bounded sample
of projections cuts that space into leaves; every vector is put into its leaf, neighbouring leaves form cells, leaves of many vectors are
dealt into shards of bounded size, and each shard is indexed by a kd-tree of its own.  A search visits
leaves and points in the order of their projected distance and verifies them on the full vectors,
until the chi-square test says that a vector nearer than the current k-th best would, with probability
CONFIDENCE, have been projected nearer than the next one.  So a neighbour is missed with probability 1 - CONFIDENCE at most
each; nearer ones more seldom.

A query first searches one shard of its own cell, which bounds its k-th distance.  Then it goes to the other cells in rounds, those with the
nearest boxes of leaves first and twice as many each round; between rounds its bound is tightened, and a cell that the test rules out
ends it, as all further ones are farther.  So a round ships a query's vector only to shards that may still matter.  Within a task the points of a shard are held and the queries
stream past; a shard that very many queries go to is given to as many tasks, each with a part of the queries.  Equal vectors are searched as one that stands for the smallest ids (k + 1 of them suffice for the
k nearest), which windows limit before they shuffle; equal queries are searched once and joined back.

Defined results: rows without an id, and vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part; ties go to the smaller id; a query gets all candidates if there are
fewer than k; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pumpline.llm.shared import discard, written

PROJECTED = 24
CONFIDENCE = 0.9
#: Vectors that the leaves are fitted on, vectors of a shard, the leaves that make up a shard, and the most leaves.
SAMPLE = 40_000
SHARD = 16_384
PARTS = 16
LEAVES = 8192
#: Cells of a query's first round; each further round takes twice as many.
NEAREST_CELLS = 4
#: Queries of a shard that a task takes.
QUERIES = 4096
LEAF = 64
CHUNK = 256


def chi_square_bound(p: float, m: int) -> float:
    """x with P(chi-square of m degrees <= x) = p; m is even."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - math.exp(-x / 2) * total < p else (low, x)
    return high


def projection(length: int, m: int = PROJECTED, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((length, m))


def kd_cells(points: np.ndarray, cells: int) -> list[tuple]:
    """Splits (axis, value, left, right); a negative child is the cell ~child.  Medians of the widest axis."""
    splits: list[tuple] = []
    n_cells = 0

    def build(rows: np.ndarray, want: int) -> int:
        nonlocal n_cells
        spread = np.ptp(points[rows], axis=0) if len(rows) else np.zeros(1)
        if want < 2 or len(rows) < 2 or spread.max() == 0:
            n_cells += 1
            return ~(n_cells - 1)
        axis = int(spread.argmax())
        values = points[rows, axis]
        value = float(np.median(values))
        left = values < value
        if not left.any():
            value = float(values[values > value].min())
            left = values < value
        at = len(splits)
        splits.append(())
        a, b = build(rows[left], want // 2), build(rows[~left], want - want // 2)
        splits[at] = (axis, value, a, b)
        return at

    build(np.arange(len(points)), cells)
    return splits


def cell_of(points: np.ndarray, splits: list[tuple]) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    if not splits:
        return out
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, rows = todo.pop()
        axis, value, a, b = splits[at]
        left = points[rows, axis] < value
        for child, part in ((a, rows[left]), (b, rows[~left])):
            if child < 0:
                out[part] = ~child
            elif len(part):
                todo.append((child, part))
    return out


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of a point to each box."""
    gap = np.maximum(np.maximum(low - q, q - high), 0)
    return (gap * gap).sum(axis=1)


class Shard:
    """The vectors of a shard with a kd-tree over their projections; ids: of each vector the sorted ids that it stands for."""

    def __init__(self, raw: np.ndarray, ids: list[list[int]], matrix: np.ndarray):
        self.raw, self.ids, self.norm = raw, ids, np.sqrt((raw * raw).sum(axis=1))
        self.first = np.array([x[0] for x in ids], np.int64)
        self.unit = raw / self.norm[:, None]
        self.low_d = self.unit @ matrix
        splits = kd_cells(self.low_d, max(1, len(raw) // LEAF))
        leaf = cell_of(self.low_d, splits)
        n = len(splits) + 1
        order = np.argsort(leaf, kind="stable")
        ends = np.searchsorted(leaf[order], np.arange(n + 1))
        self.leaves = [x for i in range(n) if len(x := order[ends[i] : ends[i + 1]])]
        # tight boxes of what is in each leaf
        self.low = np.array([self.low_d[x].min(axis=0) for x in self.leaves])
        self.high = np.array([self.low_d[x].max(axis=0) for x in self.leaves])
        self.verified = 0

    def search(self, raw: np.ndarray, matrix: np.ndarray, k: int, bound: float, ratio: float) -> list[tuple[int, float]]:
        """The k nearest (position, cosine) found, equal ones by their smallest id; bound: the square of a distance within which k others are known."""
        norm = math.sqrt((raw * raw).sum())
        unit = raw / norm
        q = unit @ matrix
        away = box_distance(q, self.low, self.high)
        near = np.argsort(away, kind="stable")
        best: list[tuple[float, int, int]] = []
        at, pending_i, pending_d = 0, np.empty(0, np.int64), np.empty(0)
        while True:
            kth = min(bound, 2 + 2 * best[k - 1][0]) if len(best) >= k else bound
            # open the leaves that may hold the next projected neighbours
            opened_i, opened_d = [pending_i], [pending_d]
            size, least = len(pending_d), pending_d[0] if len(pending_d) else math.inf
            while at < len(near) and (size < CHUNK or away[near[at]] <= least) and away[near[at]] <= ratio * kth:
                x = self.leaves[near[at]]
                d = ((self.low_d[x] - q) ** 2).sum(axis=1)
                opened_i.append(x), opened_d.append(d)
                size, least = size + len(x), min(least, float(d.min()))
                at += 1
            pending_i, pending_d = np.concatenate(opened_i), np.concatenate(opened_d)
            order = np.argsort(pending_d, kind="stable")
            pending_i, pending_d = pending_i[order], pending_d[order]
            if not len(pending_d) or pending_d[0] > ratio * kth:
                break  # the stopping test: nothing that is left is likely to be nearer
            take = min(CHUNK, int(np.searchsorted(pending_d, ratio * kth, side="right")))
            x = pending_i[:take]
            pending_i, pending_d = pending_i[take:], pending_d[take:]
            self.verified += len(x)
            x = x[2 - 2 * (self.unit[x] @ unit) <= kth + 1e-9]
            scores = (self.raw[x] * raw).sum(axis=1) / (self.norm[x] * norm)
            best = sorted([*best, *zip((-scores).tolist(), self.first[x].tolist(), x.tolist())])[:k]
        return [(i, -score) for score, _, i in best]


def _search(points: DataFrame, queries: DataFrame, length: int, k: int) -> DataFrame:
    """(query, vec_id, score) of points (cell, shard, vector, ids) and queries (cell, shard, key, vector, bound)."""
    ratio = chi_square_bound(CONFIDENCE, PROJECTED)
    schema = "query bigint, vec_id bigint, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = projection(length)
        key, vectors, ids, shard = None, [], [], None
        for batch in batches:
            out: list[tuple] = []
            groups = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            kinds, names, bounds = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(7).to_numpy()
            flat = batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
            edges = np.flatnonzero((np.diff(groups, axis=0) != 0).any(axis=1) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if tuple(groups[a]) != key:
                    key, vectors, ids, shard = tuple(groups[a]), [], [], None
                if kinds[a] == 0:
                    vectors.append(flat[a:b].copy())
                    ids += batch.column(6).slice(a, b - a).to_pylist()
                    continue
                if not vectors:
                    continue
                shard = shard or Shard(np.concatenate(vectors), ids, matrix)
                for j in range(a, b):
                    for i, score in shard.search(flat[j], matrix, k, bounds[j], ratio):
                        out += [(int(names[j]), v, score) for v in shard.ids[i]]
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query", "vec_id", "score"])

    place = ["cell", "shard"]
    parts = queries.groupBy(*place).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    held = points.join(parts, place).select(*place, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("key"), "vector", "ids", F.lit(0.0).alias("bound"))
    asked = queries.join(parts, place).select(*place, F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "key", "vector", F.array().cast("array<bigint>").alias("ids"), "bound")
    return held.unionByName(asked).repartition(*place, "part").sortWithinPartitions(*place, "part", "kind").mapInArrow(run, schema)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part, but for their lengths."""
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), x.alias("vector")).filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return rows.filter(~F.exists("vector", bad) & F.exists("vector", lambda v: v != 0))


def _scaled(rows: DataFrame, length: int) -> DataFrame:
    """The rows with their vectors scaled to a largest component of 1 or -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
            flat = flat / np.abs(flat).max(axis=1, keepdims=True, initial=0) + 0.0 if len(flat) else flat  # one zero of both signs
            offsets = pa.array((np.arange(batch.num_rows + 1) * length).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))], ["vec_id", "vector"])

    return rows.mapInArrow(run, "vec_id bigint, vector array<double>")


def _best(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)


class Cells(NamedTuple):
    """The leaves of the kd-tree that hold vectors, in its order: the cell that each belongs to, and the tight box around its projections; shards: of each cell."""

    leaf: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    shards: list[int]


def _cells(placed: DataFrame, length: int) -> Cells:
    """Neighbouring leaves of placed (vector, leaf) form cells of SHARD vectors at most; a larger leaf is a cell of several shards.

    A task combines its rows by leaf, and what comes to the driver is a row for each of LEAVES leaves at most.
    """
    axes = range(PROJECTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = projection(length)
        seen: dict[int, list] = {}
        for batch in batches:
            flat = np.asarray(batch.column(0).flatten(), np.float64).reshape(-1, length)
            q, leaf = (flat / np.linalg.norm(flat, axis=1)[:, None]) @ m, batch.column(1).to_numpy()
            order = np.argsort(leaf, kind="stable")
            for x in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1) if len(order) else []:
                n, low, high = seen.get(int(leaf[x[0]]), (0, np.inf, -np.inf))
                seen[int(leaf[x[0]])] = [n + len(x), np.minimum(low, q[x].min(axis=0)), np.maximum(high, q[x].max(axis=0))]
        rows = [(c, n, low.tolist(), high.tolist()) for c, (n, low, high) in seen.items()]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["leaf", "n", "low", "high"])

    parts = placed.select("vector", "leaf").mapInArrow(run, "leaf bigint, n bigint, low array<double>, high array<double>")
    lows, highs = F.array(*[F.min(F.col("low")[i]) for i in axes]), F.array(*[F.max(F.col("high")[i]) for i in axes])
    found = sorted(parts.groupBy("leaf").agg(F.sum("n").alias("n"), lows.alias("low"), highs.alias("high")).collect())
    cell, sizes = [], []
    for r in found:
        if not sizes or sizes[-1] + r["n"] > SHARD:
            sizes.append(0)
        sizes[-1] += r["n"]
        cell.append(len(sizes) - 1)
    column = lambda name: np.array([r[name] for r in found])
    return Cells(column("leaf"), np.array(cell, np.int64), column("low"), column("high"), [math.ceil(n / SHARD) for n in sizes])


def _routes(queries: DataFrame, length: int, cells: Cells, seen: int, width: int) -> DataFrame:
    """(cell, shard, key, bound): the shards of a round that queries (cell, shard, key, vector, bound) go to, but for their own.

    A query's cells are ordered by the projected distance of their nearest box; a round takes those from `seen` on, `width` of them, as far as the
    stopping test doesn't rule them out.
    """
    starts = np.flatnonzero(np.diff(cells.cell, prepend=-1))
    ratio = chi_square_bound(CONFIDENCE, PROJECTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = projection(length)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                flat = np.asarray(part.column(3).flatten(), np.float64).reshape(-1, length)
                q = (flat / np.linalg.norm(flat, axis=1)[:, None]) @ m
                take, to, shards = [], [], []
                for i, (home, deal, bound) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(4).to_pylist())):
                    away = np.minimum.reduceat(box_distance(q[i], cells.low, cells.high), starts)
                    order = np.argsort(away, kind="stable")[seen : seen + width]
                    for x in order[away[order] <= ratio * bound].tolist():
                        for s in range(cells.shards[x]):
                            if (x, s) != (home, deal):
                                take.append(i), to.append(x), shards.append(s)
                t = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(shards, pa.int32()), part.column(2).take(t), part.column(4).take(t)], ["cell", "shard", "key", "bound"])

    return queries.select("cell", "shard", "key", "vector", "bound").mapInArrow(run, "cell bigint, shard int, key bigint, bound double")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine of each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    length = lengths[0]["length"]
    rows = written(_scaled(rows.filter(F.size("vector") == length), length), "scaled").withColumn("h", F.xxhash64("vector"))
    # k + 1 smallest ids of each distinct vector: the window's limit applies before the shuffle.
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("h", "vector").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    classes = few.groupBy("h", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = rows.filter(F.col("vec_id") % every == 0)
    wanted = asked.select("h", "vector").distinct().withColumn("asked", F.lit(True))

    n = rows.count()
    share = min(1.0, SAMPLE / n)
    sample = np.array([r[0] for r in rows.filter(F.pmod("h", F.lit(1_000_003)) < share * 1_000_003).select("vector").limit(2 * SAMPLE).collect()])
    matrix = projection(length)
    low = (sample / np.linalg.norm(sample, axis=1)[:, None]) @ matrix if len(sample) else np.empty((0, PROJECTED))
    splits = kd_cells(low, int(min(LEAVES, max(1, n * PARTS // SHARD))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = projection(length)
        for batch in batches:
            flat = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, length)
            leaf = cell_of((flat / np.linalg.norm(flat, axis=1)[:, None]) @ m, splits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64())], [*batch.schema.names, "leaf"])

    placed = classes.join(wanted, ["h", "vector"], "left").select("h", "vector", "ids", "asked", F.get("ids", F.lit(0)).alias("key"))
    placed = written(placed.mapInArrow(place, "h bigint, vector array<double>, ids array<bigint>, asked boolean, key bigint, leaf bigint"), "vectors")
    cells = _cells(placed, length)
    table = [(leaf, cell, cells.shards[cell]) for leaf, cell in zip(cells.leaf.tolist(), cells.cell.tolist())]  # at most LEAVES rows
    placed = placed.join(F.broadcast(spark.createDataFrame(table, "leaf bigint, cell bigint, shards int")), "leaf").withColumn("shard", F.pmod(F.hash("key"), F.col("shards")).cast("int"))
    points = placed.select("cell", "shard", "vector", "ids")
    queries = placed.filter("asked").select("cell", "shard", "key", "vector")
    at_home = _search(points, queries.withColumn("bound", F.lit(4.0)), length, k + 1)
    at_home = written(_best(at_home, k + 1), "home")
    found = at_home
    seen, width = 0, NEAREST_CELLS
    while seen < len(cells.shards):
        # The bound holds once k + 1 neighbours are found; its square is 2 - 2 cos.
        bounds = found.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        bounded = queries.join(bounds, F.col("key") == F.col("query"), "left").withColumn("bound", F.when(F.col("n") > k, 2 - 2 * F.col("least")).otherwise(4.0))
        # Routes are written without the vectors, which join by the query's key.
        routed = written(_routes(bounded, length, cells, seen, width), "routes")
        if not routed.limit(1).count():
            discard(routed)
            break
        away = _search(points, routed.join(queries.select("key", "vector"), "key"), length, k + 1)
        better = written(_best(found.select("query", "vec_id", "score").unionByName(away), k + 1), "found")
        discard(found, routed)
        found, seen, width = better, seen + width, 2 * width
    found = found.select("query", "vec_id", "score")
    keys = placed.filter("asked").select("h", "vector", F.col("key").alias("query"))
    of_query = asked.select("h", "vector", F.col("vec_id").alias("query_id")).join(keys, ["h", "vector"]).select("query_id", "query")
    own = of_query.join(found, "query").filter("vec_id <> query_id")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op6_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
