"""Operator 10: near-duplicate documents by fast similarity sketching, banding and exact verification.

Method.  A document's set is that of its distinct word shingles, as 64-bit hashes.  A sketch has BINS
coordinates.  In round i every shingle falls, by its hash of that round, into a bin with the value
i + (a fraction); in rounds from BINS on, all fall into bin i - BINS.  A bin keeps its smallest value, and the
rounds end when no bin is empty, at the latest after 2 * BINS of them, so every coordinate fills and the
share of equal coordinates concentrates about the similarity.  Bands of ROWS coordinates give buckets.

* Equal sets form a class with one representative; only representatives are compared.
* The centre of a bucket is its member with the smallest hash.  Every member is compared, on the full sets, with
  one of its buckets' centres.
* Then buckets whose members aren't all connected by that get their other pairs compared: those of two members in
  a join, larger ones block by block.  There members are dealt into blocks, and two blocks at a time are compared
  in one task: pairs of different components whose sizes allow it and whose sketches agree within six standard
  deviations of the threshold are confirmed on the full sets, the most similar first, and only links that join
  components come out.

So a link can be missed only where no band agrees or a sketch is off by more than that: with 40 bands of 6,
under 1e-8 at a similarity of 0.85.  No bucket is capped.

Defined results: null texts and texts without words have an empty set and are linked with nothing; with fewer
words than a shingle the whole sequence is the only shingle; equal texts are linked at any length; rows with the
same id count as one document for linking, each with a row of its own; rows without an id stay alone, with
a null component, and are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pumpline.llm.arrow import byte_slices
from pumpline.llm.components import components
from pumpline.llm.shared import discard, written

BANDS, ROWS = 40, 6
BINS = BANDS * ROWS
BLOCK = 1024
#: Words whose hashes a worker keeps.
KEPT_WORDS = 100_000
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > KEPT_WORDS:
            self.clear()
        got = self[word] = xxh3_64_intdigest(word)
        return got


def shingles(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles of k words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([hashes[w] for w in words], np.uint64)
    n = max(len(h) - k + 1, 1)
    out = np.full(n, min(len(h), k), np.uint64)
    for i in range(min(k, len(h))):
        out = mixed(out * _U(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def sketch(items: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The coordinates of a set that isn't empty: round in the upper half, fraction in the lower."""
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    done, each = 0, 1 if len(items) > bins * math.log(bins) else max(1, int(1.3 * bins * math.log(bins) / len(items)))
    while done < 2 * bins:
        rounds = np.arange(done, min(done + each, 2 * bins), dtype=np.uint64)
        h = mixed(items[None, :] + mixed((rounds + _U(1)) * _U(0xD6E8FEB86659FD93))[:, None])
        at = (h >> _U(32)) * _U(bins) >> _U(32)
        at = np.where(rounds[:, None] < bins, at, rounds[:, None] - _U(bins))
        np.minimum.at(out, at.ravel().astype(np.int64), ((rounds[:, None] << _U(32)) | (h & _U(0xFFFFFFFF))).ravel())
        done += len(rounds)
        if out.max() < np.iinfo(np.uint64).max:
            break
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _profiles(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, d1, d2, bands, sketch) of columns id and text; bands and sketch are null for empty sets."""
    salt = mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        hashes = WordHashes()
        for part in byte_slices(batches, 1):
            n, d1, d2, bands, low = [], [], [], [], []
            for text in part.column(1).to_pylist():
                items = shingles(text, k, hashes)
                n.append(len(items))
                a, b = np.frombuffer(xxh3_128_digest(items.tobytes()), np.int64)
                d1.append(a), d2.append(b)
                if len(items):
                    s = sketch(items).reshape(BANDS, ROWS)
                    key = salt
                    for j in range(ROWS):
                        key = mixed(key * _U(0x9E3779B97F4A7C15) + s[:, j])
                    bands.append(_signed(key))
                    low.append((mixed(s.ravel()) & _U(0xFF)).astype(np.uint8).tobytes())
                else:
                    bands.append(None), low.append(None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary())], ["doc_id", "n", "d1", "d2", "bands", "sketch"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>, sketch binary")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, items) of columns id and text, the set as the bytes of its sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in byte_slices(batches, 1):
            items = [shingles(t, k, hashes).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(items, pa.binary())], ["node", "items"])

    return docs.mapInArrow(run, "node bigint, items binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * size of the intersection >= percent * size of the union, of sorted distinct values."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar.  u may be the centre of very many: v's set moves to u, not u's to each v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(iter([batch]), 2):
                ok = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                keep = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["u", "v"])

    with_v = pairs.join(sets.select(F.col("node").alias("v"), F.col("items").alias("of_v")), "v")
    both = with_v.join(sets.select(F.col("node").alias("u"), F.col("items").alias("of_u")), "u")
    return both.select("u", "v", "of_u", "of_v").mapInArrow(run, "u bigint, v bigint")


def _blockwise(members: DataFrame, percent: int) -> DataFrame:
    """Links between different components in a bucket, confirmed on the full sets, as many as connect them.

    members: (bucket, m, node, component, sketch, items), m the bucket's number of members.
    """
    least = BINS * percent / 100 - 6 * math.sqrt(BINS * percent / 100 * (1 - percent / 100))

    def links_of(group: list[tuple], within: bool) -> Iterator[tuple[int, int]]:
        left = [x for x in group if x[0] == 0]
        right = left if within else [x for x in group if x[0] == 1]
        if not left or not right:
            return
        # components by number; `into` says which have become one here
        number = {c: i for i, c in enumerate({x[2] for x in group})}
        into = np.arange(len(number))
        sketches = np.frombuffer(b"".join(x[3] for x in right), np.uint8).reshape(len(right), BINS)
        sets = [np.frombuffer(x[4], np.uint64) for x in right]
        of, sizes = np.array([number[x[2]] for x in right]), np.array([len(x) for x in sets])
        for i, (_, node, component, low, items) in enumerate(left):
            mine = np.frombuffer(items, np.uint64)
            own = number[component]
            ok = (into[of] != into[own]) & (100 * np.minimum(sizes, len(mine)) >= percent * np.maximum(sizes, len(mine)))
            if within:
                ok[: i + 1] = False
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            equal = (sketches[at] == np.frombuffer(low, np.uint8)).sum(axis=1)
            order = np.argsort(-equal, kind="stable")
            for j in at[order[equal[order] >= least]].tolist():
                if into[of[j]] != into[own] and similar(mine, sets[j], percent):
                    into[into == into[of[j]]] = into[own]
                    yield node, right[j][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        found: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.int64())], ["u", "v"])
            found.clear()
            return out

        for batch in batches:
            for part in byte_slices(iter([batch]), 7):
                for bucket, i, j, side, node, component, low, items in zip(*[c.to_pylist() for c in part.columns]):
                    if (bucket, i, j) != key:
                        if key is not None:
                            found += links_of(group, key[1] == key[2])
                        key, group = (bucket, i, j), []
                        if len(found) > 100_000:
                            yield flush()
                    group.append((side, node, component, low, items))
        if key is not None:
            found += links_of(group, key[1] == key[2])
        yield flush()

    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = members.withColumn("own", F.pmod(F.xxhash64("node", "bucket"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "component", "sketch", "items")
    return dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "u bigint, v bigint")


def linked(docs: DataFrame, k: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size of its set, its component's smallest id and whether that is its own."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profiles = written(_profiles(rows, k), "profiles")
    full = profiles.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"))
    nodes = full.join(classes.withColumnRenamed("node", "doc_id"), ["d1", "d2", "doc_id"], "left_semi").select(F.col("doc_id").alias("node"), "n", "bands", "sketch")
    rays = nodes.select("node", F.explode("bands").alias("bucket")).distinct()
    # The centre of a bucket: the member with the smallest hash, so a group's buckets have few centres.
    hashed = F.xxhash64("node")
    centres = rays.groupBy("bucket").agg(F.min(hashed).alias("h"), F.max(hashed).alias("last")).filter("h < last").select("bucket", "h")
    shared = written(rays.join(centres, "bucket").select("bucket", "node", hashed.alias("own"), "h"), "buckets")
    by_hash = shared.groupBy("own").agg(F.min("node").alias("u")).withColumnRenamed("own", "h")
    wanted = shared.select(F.col("node").alias("doc_id")).distinct()
    sets = written(_sets(rows.join(wanted, "doc_id", "left_semi"), k), "sets")

    # First each member is compared with one centre: that with the smallest hash of its buckets' centres.
    first = shared.groupBy("node", "own").agg(F.min("h").alias("h")).filter("h < own").join(by_hash, "h").select("u", F.col("node").alias("v"))
    links = written(_confirmed(first, sets, percent), "links")
    found = written(components(links), "components")
    # Then the pairs of buckets of two that aren't connected by that.
    component = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    apart = lambda rows: rows.join(component("v"), "v", "left").join(component("u"), "u", "left").filter(F.coalesce("of_u", "u") != F.coalesce("of_v", "v")).select("u", "v")
    twos = shared.groupBy("bucket").agg(F.count("*").alias("m"), F.min_by("node", "own").alias("u"), F.max_by("node", "own").alias("v")).filter("m = 2")
    pairs = apart(twos.select("u", "v").distinct().join(first, ["u", "v"], "left_anti"))
    before = links, found
    links = written(links.unionByName(_confirmed(pairs, sets, percent)), "links")
    found = written(components(links), "components")
    discard(*before)

    # Then, in larger buckets that still aren't one component, all with all, block by block.
    labelled = shared.select("bucket", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = labelled.groupBy("bucket").agg(F.count("*").alias("m"), F.min("component").alias("first"), F.max("component").alias("last")).filter("first < last and m > 2").select("bucket", "m")
    members = labelled.join(open_, "bucket").join(nodes.select("node", "sketch"), "node").join(sets, "node")
    more = written(_blockwise(members, percent), "links")
    if more.limit(1).count():
        last, found = found, written(components(links.unionByName(more)), "components")
        discard(last)
    discard(shared, sets, links, more)

    of_class = classes.join(found, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("of_class"))
    out = profiles.select("doc_id", "n", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("of_class")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of one document of each component: that with the smallest id."""
    name = next(f"gone_{i}" for i in range(len(docs.columns) + 1) if f"gone_{i}" not in {c.lower() for c in docs.columns})
    gone = linked(docs, k, percent, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(f"`{id_col}`").cast("bigint") == F.col(name), "left_anti")


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 2], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.v FROM r JOIN e ON r.y = e.u),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
