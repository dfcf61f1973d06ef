"""Operator 11: ranked lexical search by WAND per document shard.

Method.  A first pass over the documents keeps, of each, its number of terms and its counts of those terms that queries have; sums over
them give the numbers of documents and terms and the documents of each term.  Then each task deals its documents into shards of a bounded number
of postings.  In a shard a term's postings stand in order of document with their impacts (weight times saturated count), and the term has
a maximum impact.  For each query the cursors of its terms are kept in order of their documents; the pivot is the first cursor
at which the sum of the maximum impacts reaches the threshold, and all cursors before it skip to the pivot's document: no document between
can beat the threshold.  The threshold is the worst score of the query's heap; before the first document, it is the k-th best of a few
documents that the terms of the largest impacts have.  Heaps go on from shard to shard of a task; those of the tasks are merged, in two
steps, by windows that limit first.

Queries are taken by their distinct texts, in blocks of a bounded number of bytes, each against all documents; equal texts are
searched once and joined back.  What is sent to tasks are the terms of a block.

Terms are bytes: only A-Z are lower-cased, and what isn't a letter or digit of ASCII parts them; all characters beyond ASCII belong to terms.

Defined results: a null or empty text has no term, and is neither counted nor found; a query without a term that some document has
finds nothing; each row of the queries has its own ranks, also if ids or texts repeat, and a null id stays null; equal scores go by
the smaller id; rows with one id are documents of their own, rows without an id count in the statistics and come last
among equal scores.  Texts of any length are read whole.  Empty tables give an empty table; other columns aren't read.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pumpline.llm.arrow import byte_slices
from pumpline.llm.shared import written

TOP = 10
#: Bytes of the queries' texts that are searched together, and postings of a shard.
BLOCK_BYTES, SHARD = 4 << 20, 2_000_000
#: Documents that give a query's first threshold, by term and in all.
SEEDS, SEED_TERMS = 16, 6
#: Text bytes of a posting's row that are held at once.
WHOLE = 4 << 20
NO_ID = np.iinfo(np.int64).max
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split() if text else []


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tfs) of each row with a term: how many it has, and its counts of the vocabulary's."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for part in byte_slices(batches, 1):
            ids, ns, ends, terms, tfs = [], [], [0], [], []
            for i, raw in zip(part.column(0).to_pylist(), part.column(1)):
                words = terms_of(raw.as_py())
                if not words:
                    continue
                counts = Counter(words)
                found = counts.keys() & known.keys() if len(known) < len(counts) else [w for w in counts if w in known]
                ids.append(i)
                ns.append(len(words))
                terms += [known[w] for w in found]
                tfs += [counts[w] for w in found]
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], ["id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "id bigint, n bigint, terms array<int>, tfs array<int>")


class Shard:
    """Postings by term, each term's in order of document, documents in order of id."""

    def __init__(self, rows: list[pa.RecordBatch], weights: np.ndarray, documents: int, terms: int):
        table = pa.Table.from_batches(rows).combine_chunks()
        column = lambda name: table.column(name).combine_chunks()
        ids = column("id").fill_null(NO_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids = ids[order].tolist()
        lists = column("terms")
        doc = np.repeat(place, np.diff(lists.offsets.to_numpy()))
        term, tf = lists.flatten().to_numpy(), column("tfs").flatten().to_numpy().astype(np.int64)
        m = 10 + (90 * column("n").to_numpy()[order] * documents) // max(1, terms)
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        by = np.lexsort((doc, term))
        self.docs, self.impacts, term = doc[by], impact[by], term[by]
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        most = np.maximum.reduceat(self.impacts, starts) if len(starts) else starts
        ends = np.append(starts[1:], len(term))
        self.spans = dict(zip(term[starts].tolist(), zip(starts.tolist(), ends.tolist(), most.tolist())))
        self.doc_at, self.impact_at = memoryview(self.docs), memoryview(self.impacts)

    def seeded(self, spans: list, k: int) -> int:
        """A score that k documents at least have, or 0: those that the terms of the largest impacts have."""
        chosen = set()
        for start, end, _ in sorted(spans, key=lambda s: -s[2])[:SEED_TERMS]:
            own = self.impacts[start:end]
            chosen |= set(self.docs[start:end][np.argpartition(-own, SEEDS)[:SEEDS] if len(own) > SEEDS else slice(None)].tolist())
        if len(chosen) < k:
            return 0
        at = np.array(sorted(chosen))
        scores = np.zeros(len(at), np.int64)
        for start, end, _ in spans:
            own = self.docs[start:end]
            p = np.minimum(np.searchsorted(own, at), len(own) - 1)
            scores += np.where(own[p] == at, self.impacts[start:end][p], 0)
        return int(np.partition(scores, len(scores) - k)[len(scores) - k])

    def search(self, query: list[int], heap: list[tuple[int, int]], k: int) -> int:
        """Puts the query's best documents of the shard into its heap of (score, -id); the number of scored documents."""
        spans = [self.spans[t] for t in query if t in self.spans]
        if not spans:
            return 0
        doc_at, impact_at, ids = self.doc_at, self.impact_at, self.ids
        least = self.seeded(spans, k) if len(heap) < k else 0
        threshold, scored = max(1, least, heap[0][0] if len(heap) == k else 0), 0
        # A cursor: its document, its place, its end and its term's maximum impact.
        cursors = sorted([doc_at[start], start, end, most] for start, end, most in spans)
        while True:
            reach = 0
            for at, c in enumerate(cursors):
                reach += c[3]
                if reach >= threshold:
                    break
            else:
                return scored
            pivot = c[0]
            if cursors[0][0] < pivot:
                for c in cursors[:at]:
                    if c[0] < pivot:
                        c[1] = bisect_left(doc_at, pivot, c[1] + 1, c[2])
                        c[0] = doc_at[c[1]] if c[1] < c[2] else -1
            else:
                score = 0
                for c in cursors:
                    if c[0] != pivot:
                        break
                    score += impact_at[c[1]]
                    c[1] += 1
                    c[0] = doc_at[c[1]] if c[1] < c[2] else -1
                scored += 1
                if score >= threshold:
                    entry = (score, -ids[pivot])
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        threshold = max(threshold, heap[0][0])
            cursors.sort()
            if cursors[0][0] < 0:
                cursors = [c for c in cursors if c[0] >= 0]


def found(index: DataFrame, queries: list[list[int]], weights: np.ndarray, documents: int, terms: int, k: int = TOP, shard: int = SHARD) -> DataFrame:
    """(query, task, doc_id, score): the k best documents of each query in each task's shards."""
    sent = index.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = sent.value
        heaps: list[list] = [[] for _ in asked]

        def search(rows: list[pa.RecordBatch]) -> None:
            held = Shard(rows, weight, documents, terms)
            for query, heap in zip(asked, heaps):
                held.search(query, heap, k)

        rows, size = [], 0
        for batch in batches:
            rows.append(batch)
            size += batch.num_rows + len(batch.column(2).flatten())
            if size >= shard:
                search(rows)
                rows, size = [], 0
        if rows:
            search(rows)
        out = [(q, None if -i == NO_ID else -i, s) for q, heap in enumerate(heaps) for s, i in heap]
        columns = [pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["query", "doc_id", "score"])

    return index.mapInArrow(run, "query int, doc_id bigint, score bigint").withColumn("task", F.spark_partition_id())


def _best(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block(docs: DataFrame, texts: list[tuple[str, str]], k: int, shard: int) -> DataFrame:
    """(key, rank, doc_id, score) of a block's texts, given as (key, text)."""
    vocabulary: dict[bytes, int] = {}
    queries = [[vocabulary.setdefault(w, len(vocabulary)) for w in dict.fromkeys(terms_of(text))] for _, text in texts]
    index = written(postings(docs, vocabulary), "postings")
    all_ = index.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).collect()[0]
    weights = np.zeros(len(vocabulary), np.int64)
    # A row for each term of the block that some document has.
    for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toLocalIterator():
        weights[r["term"]] = math.floor(1000 * math.log((2 * all_["documents"] + 2) / (2 * r["df"] + 1)))
    rows = found(index, queries, weights, all_["documents"], all_["terms"], k, shard)
    rows = _best(rows.withColumn("some", F.pmod("task", F.lit(64))), ["query", "some"], k)
    rows = _best(rows, ["query"], k)
    keys = docs.sparkSession.createDataFrame(list(enumerate(key for key, _ in texts)), "query int, key string")
    return rows.join(keys, "query").select("key", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", block_bytes: int = BLOCK_BYTES, shard: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = items.select(F.col(item_col).alias("item_id"), F.col(query_col).cast("string").alias("query")).filter("query is not null").withColumn("key", F.sha2("query", 256))
    texts = rows.groupBy("key").agg(F.first("query").alias("query"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("query")), F.lit(0)).alias("n")).collect()[0]["n"]
    blocks, out = max(1, -(-size // block_bytes)), None
    for b in range(blocks):
        block = texts.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).orderBy("key").collect()
        hits = _block(docs, [(r["key"], r["query"]) for r in block], k, shard)
        hits = written(hits, "hits") if blocks > 1 else hits
        out = hits if out is None else out.unionByName(hits)
    return rows.select("item_id", "key").join(out, "key").select("item_id", "rank", "doc_id", "score")


def op11_search(spark, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format(t="text")} AS t FROM documents WHERE text IS NOT NULL),
e AS (SELECT count(*) AS docs, sum(len(t)) AS all_terms FROM d WHERE len(t) > 0),
i AS (SELECT DISTINCT item_id, unnest({_WORDS.format(t="text")}) AS term FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT doc_id, r, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, r, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY doc_id, r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, e GROUP BY term, docs),
s AS (SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // all_terms)))) AS BIGINT) AS score FROM i JOIN p USING (term) JOIN w USING (term), e GROUP BY item_id, doc_id, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}"""
