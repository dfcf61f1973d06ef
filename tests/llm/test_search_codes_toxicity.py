"""Operators 11, 12 and 13."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pumpline.llm import codes, search, toxicity

SF = "/root/testdata/sf0.001"


# operator 11


def plain_ranks(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if c[w])
            if s > 0:
                scores.append((-s, i is None, i if i is not None else 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


WORDS = [*"abcdefgh", "Éa", "éa", "Ω", "x1", "the"]


def some_docs(n, seed):
    r = random.Random(seed)
    rows = [(i, r.choice([" ", "-", "\n"]).join(r.choices(WORDS, [1 + j * j for j in range(len(WORDS))], k=r.randint(1, 30)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "..!"), (5, "a b the"), (5, "a b the"), (None, "a a B h"), (n + 3, "the " * 30000 + "A")]


@pytest.mark.parametrize("shard", [50, 10**6])
def test_op11_equals_brute_force(spark, shard):
    docs = some_docs(150, 1)
    items = [(1, "a b c!"), (2, "the x1 Éa éa the"), (2, "Ω"), (None, "h g"), (4, None), (5, ""), (6, "zz"), (7, "a b c!"), (8, "THE")]
    a = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string").repartition(3)
    b = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int")
    got = sorted((tuple(r) for r in search.ranked(a, b, shard=shard).collect()), key=str)
    assert got == plain_ranks(docs, items)
    assert sorted((tuple(r) for r in search.ranked(a, b, shard=shard, block_bytes=10).collect()), key=str) == got


def test_op11_skips_documents(spark):
    """A rare term fills the heap; documents that only have frequent ones aren't scored."""
    import pyarrow as pa

    n = 5000
    rows = pa.RecordBatch.from_pydict({"id": pa.array(range(n)), "n": pa.array([10] * n), "terms": pa.array([[0, 1] if i % 100 == 7 else [0] for i in range(n)], pa.list_(pa.int32())), "tfs": pa.array([[1, 1] if i % 100 == 7 else [1] for i in range(n)], pa.list_(pa.int32()))})
    heap = []
    scored = search.Shard([rows], np.array([3, 9000]), n, 10 * n).search([0, 1], heap, 10)
    assert scored <= 50 and sorted(-i for _, i in heap) == [7 + 100 * i for i in range(10)]


def test_op11_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.ranked(docs, items).count() == 0 and search.ranked(spark.createDataFrame([(1, "a")], docs.schema), items.limit(0)).count() == 0


# operator 12


def labelled(n=900, seed=3):
    """Toxic documents have several words from a list; a few labels are wrong."""
    r = random.Random(seed)
    bad, plain = ["blark", "snoodle", "grimptor", "grimpta", "grimpel"], [a + b + c for a in ("lo", "ma", "ti", "re") for b in ("na", "su", "ke", "vi") for c in ("", "n", "ro")]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = r.choices(plain, k=r.randint(8, 60))
        for _ in range(max(3, len(words) // 12) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(bad))
        docs.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, int(toxic) if i % 97 else 1 - int(toxic)))
    return docs, labels


def test_op12_held_out(spark):
    docs, labels = labelled()
    odd = [(10_000, None), (10_001, ""), (10_002, "lona tike " * 20000), (10_003, "lona BLARK! gr1mptor blark snoodle."), (None, "x"), (0, docs[0][1])]
    a = spark.createDataFrame([(*d, "x") for d in [*docs, *odd]], "doc_id long, text string, score string")
    b = spark.createDataFrame([*[(*x, 1) for x in labels], (3, None, 1), (None, 1, 1), (77_777, 1, 1), (12, 1, 1), (12, 1, 1)], "doc_id long, toxic int, words int")
    rows = toxicity.scored(a, b).collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 100 and sum(r.predicted == (r.doc_id % 6 == 0) for r in held) >= 0.98 * len(held)
    at = {r.doc_id: r for r in rows}
    assert at[10_000].score == at[10_001].score < 0.5 and at[10_002].predicted == 0 and at[10_003].predicted == 1
    # labels of held-out rows are no input
    free = b.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {(r.doc_id, r.score) for r in toxicity.scored(a, free).collect()} == {(r.doc_id, r.score) for r in rows}


def test_op12_one_kind_of_label_or_none(spark, docs):
    a = docs(["a b", None, "c"], extra=True)
    one = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scored(a, one).collect()} == {1.0}
    assert {r.score for r in toxicity.scored(a, one.limit(0)).collect()} == {0.0}
    assert toxicity.scored(docs([]), one).count() == 0
    both = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert toxicity.scored(docs([]), both).count() == 0 and toxicity.scored(a, both).count() == 3


def test_op12_counts_equal_a_plain_reading():
    lexicon = ["=idle", "^ach", "$rum", "=été"]
    reader = toxicity.Reader(lexicon)
    text = "Idle! idle, achtung ACHRUM été Été-idle x. rum spectrum " * 3
    words = re.findall(r"[^\W_]+", text.lower())
    plain = [words.count("idle"), sum(w.startswith("ach") and len(w) > 3 for w in words), sum(w.endswith("rum") and len(w) > 3 for w in words), words.count("été")]
    n, counts, _ = reader.read(text)
    assert n == len(words) and [counts[i] for i in range(4)] == plain
    assert reader.read(None) == reader.read("") == (0, {}, 0)
    assert reader.read("1dl3 a b")[2] >> toxicity.FORMS.index("disguised") & 1 and not reader.read("idle a b")[2] >> toxicity.FORMS.index("disguised") & 1


def test_op12_label_model_recovers_rates(spark):
    """Votes that are drawn with known rates, labels for a third of the rows."""
    r = np.random.default_rng(5)
    n = 6000
    y = r.random(n) < 0.2
    rate = np.array([[0.02] * 6, [0.6, 0.5, 0.4, 0.4, 0.3, 0.5]])
    fires = r.random((n, 6)) < rate[y.astype(int)]
    fires[:, 5] = fires[:, 0]  # one voter copies another
    rows = []
    for i in range(n):
        found = np.flatnonzero(fires[i]).tolist()
        rows.append((str(i), 100, found, [1] * len(found), 0))
    table = spark.createDataFrame(rows, "id string, words int, entries array<int>, counts array<int>, forms int")
    flips = r.random(n) < 0.02
    labels = spark.createDataFrame([(str(i), float(y[i] != flips[i])) for i in range(0, n, 3)], "id string, y double")
    model = toxicity.Model([f"={i}" for i in range(6)], [(i, 0) for i in range(6)], 0.5)
    start = np.full((2, 6 + len(toxicity.FORMS) + toxicity.MANY), 0.2)
    start[0, :6], start[1, :6] = 0.1, 0.4
    start[:, -5], start[:, -1] = (0.6, 0.1), (0.1, 0.6)
    model.rates, model.shares = start, np.ones(start.shape[1])
    toxicity.estimated(toxicity.patterns(table, labels, model), model)
    assert abs(model.prior - 0.2) < 0.03 and np.abs(model.rates[1, :5] - rate[1, :5]).max() < 0.08 and model.rates[0, :5].max() < 0.05
    assert model.shares[0] < 0.6 and model.shares[5] < 0.6 < model.shares[2]


# operator 13


def plain_codes(rows, parts=4, most=256, rounds=4, scale=1024):
    """Every distance of every part to every entry, in Python integers."""
    good = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:most]
    w = len(good[0][1]) // parts
    books = [[r[1][p * w : p * w + w] for r in first] for p in range(parts)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        found = [[near(p, r[1][p * w : p * w + w])[1] for r in good] for p in range(parts)]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [r[1][p * w : p * w + w] for r, f in zip(good, found[p]) if f == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    out, errors = [], collections.Counter()
    for i, v, label in good:
        best = [near(p, v[p * w : p * w + w]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
        errors[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, errors[label], digest) for i, c, e, label in out), key=str)


@pytest.mark.parametrize("entries", [256, 20])
def test_op13_equals_brute_force(spark, entries):
    r = random.Random(7)
    # coarse components: many ties and equal parts
    rows = [(i, [r.choice([-0.25, 0.0, 0.125, 0.5, -1.0, r.random()]) for _ in range(8)], r.choice([1, 2, None])) for i in range(300)]
    rows += [(3, rows[3][1], 1), (3, [0.5] * 8, 2), (None, [0.25] * 8, 1), (900, None, 1), (901, [None] + [0.5] * 7, 1), (902, [math.nan] + [0.5] * 7, 1), (903, [-math.inf] + [0.5] * 7, 1)]
    table = spark.createDataFrame([(*x, "x") for x in rows], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    got = sorted((tuple(x) for x in codes.coded(table, entries=entries).collect()), key=str)
    assert got == plain_codes(rows, most=entries)


def test_op13_trees_find_the_lowest_of_equals():
    r = np.random.default_rng(1)
    for kind in ("ties", "wide"):
        entries = r.integers(0, 3, (256, 5)) if kind == "ties" else r.integers(-(1 << 27), 1 << 27, (256, 5))
        x = r.integers(0, 3, (3000, 5)) if kind == "ties" else r.integers(-(1 << 27), 1 << 27, (3000, 5))
        d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        index, best = codes.Tree(entries).nearest(x)
        assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_op13_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert codes.coded(spark.createDataFrame([], schema)).count() == 0
    assert codes.coded(spark.createDataFrame([(1, None, "a")], schema)).count() == 0
    rows = codes.coded(spark.createDataFrame([(1, [1.0] * 5, "a"), (2, [1.0] * 5, "a"), (3, [1.0], "a"), (4, [0.0] * 5, None)], schema)).collect()
    assert {(r.vec_id, r.code, r.error) for r in rows} == {(1, "00000000", 0), (2, "00000000", 0), (4, "02020202", 0)}
    with pytest.raises(Exception, match="too large"):
        codes.coded(spark.createDataFrame([(1, [1e30] * 4, "a")], schema)).collect()
