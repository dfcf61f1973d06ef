"""Operator 12: toxicity by weak supervision.

Method.  1. From a bounded sample of labelled documents - LABELLED a label, those with the smallest hashes - lexicon entries are mined: words,
beginnings and ends of words that toxic documents have more often than others, by the likelihood ratio of their document counts at three levels
of frequency.  2. One pass over all documents counts the entries in every whole text.  3. Voters: lexicon entries with a level, chosen so that
each toxic document of the sample has several, and patterns of the text's form (shouting, exclamation marks, symbols, repetition, entries
behind digits and signs that stand for letters).  A voter fires or not.  4. A generative model of all training documents, labelled
or not: a class gives how many of the lexicon's voters fire and which ones these are, and the text's forms.  Expectation maximisation estimates the
prior, the rates of both classes, the accuracy of the given labels - they are a voter that most documents don't have - and the correlations of voters
within classes; a voter counts the less, the more it is correlated with others: its log-likelihood ratio is divided by one plus
the squares of its positive correlations.  Each step sums over all patterns of votes in Spark.
5. A logistic regression on rates of the entries and on the voters is trained on the sample's posterior labels, and scores all documents.

Labels are learned from rows whose crc32(id as text) mod 5 is not 0 only; neither labels nor ids nor any other column is an input of a score.

Defined results: null and empty texts have no entry and get the score of such a text; repeated labels of an id count as their mean;
of several rows with one id one text is learned from, all are scored; labels of unknown or null ids and null labels don't count.  If the labels of the training
rows are all of one kind, each score is their share of ones, without any it is 0.  Texts of any length are read whole.
Equal texts get equal scores.  Empty tables give an empty table; other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pumpline.llm.arrow import byte_slices
from pumpline.llm.language import fold
from pumpline.llm.shared import discard, written

#: Documents of a label that entries are mined and the classifier is trained on, at most.
LABELLED = 4000
#: Lexicon entries that are counted, voters among them, and voters that a toxic document should have.
ENTRIES, VOTERS, WANTED = 600, 64, 3
#: Documents that an entry must occur in, and the least likelihood ratio.
LEAST_DOCS, LEAST_RATIO = 4, 12.0
#: Levels of frequency: at least so many, and at least one of so many words.
LEVELS = ((1, None), (2, 250), (3, 125))
ENDS = range(3, 9)
STEPS = 8
#: Entries of a task's counts before it sends them on.
GATHERED = 300_000
WORD = re.compile(r"[^\W_]+")
SYMBOLS = frozenset("#*$%&|<>")
#: Signs and the letters that they stand for.
DISGUISES = str.maketrans("013457@$", "oieastas")
SYMBOL, DISGUISED = re.compile(r"[#*$%&|<>]"), re.compile(r"[013457@$]")
FORMS = ("shouting", "exclamations", "symbols", "repetition", "disguised")
#: How many voters of the lexicon fire: 0, 1, ... and all above.
MANY = 5
#: Sums that Spark adds up are integers of this unit.
UNIT = 1 << 20
RIDGE = 1e-4


def parts_of(word: str) -> list[str]:
    """The word, its beginnings and its ends."""
    most = [n for n in ENDS if n < len(word)]
    return ["=" + word[:64], *("^" + word[:n] for n in most), *("$" + word[-n:] for n in most)]


def levels_of(count: int, words: int) -> int:
    """How many levels a count reaches."""
    return sum(count >= c and (share is None or count * share >= words) for c, share in LEVELS)


def sample(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[DataFrame, dict[bool, int]]:
    """(id, text, y) of the labelled documents that are learned from, and the labelled ids of either kind; columns id, text; id, y."""
    counts = {r["one"]: r["n"] for r in labels.groupBy((F.col("y") >= 0.5).alias("one")).agg(F.count("*").alias("n")).collect()}
    known = labels.join(docs.select("id").distinct(), "id", "left_semi").withColumn("h", F.xxhash64("id"))
    side = lambda one: known.filter((F.col("y") >= 0.5) == one).orderBy("h", "id").limit(most).select("id", "y")
    chosen = F.broadcast(side(True).unionByName(side(False)))  # 2 * most rows at most
    texts = docs.join(chosen, "id").groupBy("id").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"), F.first("y").alias("y"))
    return written(texts, "labelled"), counts


def mined(texts: DataFrame, entries: int = ENTRIES) -> list[str]:
    """Lexicon entries of the sample, those with the largest likelihood ratio first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[str, list[int]] = {}

        def sent() -> pa.RecordBatch:
            columns = [pa.array(list(gathered), pa.string()), *(pa.array([g[i] for g in gathered.values()], pa.int64()) for i in range(6))]
            gathered.clear()
            return pa.RecordBatch.from_arrays(columns, ["entry", "a0", "b0", "a1", "b1", "a2", "b2"])

        for part in byte_slices(batches, 0):
            for text, y in zip(part.column(0), part.column(1).to_pylist()):
                words = Counter(WORD.findall(text.as_py().lower()))
                n, found = sum(words.values()), Counter()
                for word, c in words.items():
                    for x in parts_of(word):
                        found[x] += c
                for x, c in found.items():
                    g = gathered.setdefault(x, [0] * 6)
                    for level in range(levels_of(c, n)):
                        g[2 * level + (y < 0.5)] += 1
                if len(gathered) > GATHERED:
                    yield sent()
        yield sent()

    names = ["a0", "b0", "a1", "b1", "a2", "b2"]
    counts = texts.select("text", "y").mapInArrow(run, "entry string, " + ", ".join(f"{c} bigint" for c in names))
    counts = counts.groupBy("entry").agg(*[F.sum(c).alias(c) for c in names]).filter(F.col("a0") + F.col("b0") >= LEAST_DOCS)
    all_ = texts.agg(F.count_if(F.col("y") >= 0.5).alias("a"), F.count_if(F.col("y") < 0.5).alias("b")).collect()[0]
    ratio = F.greatest(*[_ratio(F.col(f"a{i}"), F.col(f"b{i}"), all_["a"], all_["b"]) for i in range(3)])
    best = counts.withColumn("ratio", ratio).filter(F.col("ratio") >= LEAST_RATIO)
    # Entries of which all occurrences are shared stand for one another: the longest stays, whole words first.
    order = F.struct((~F.col("entry").startswith("=")).cast("int"), -F.length("entry"), "entry")
    best = best.groupBy(*names, "ratio").agg(F.min_by("entry", order).alias("entry"))
    return [r["entry"] for r in best.orderBy(F.desc("ratio"), "entry").limit(entries).collect()]


def _ratio(a: Column, b: Column, all_a: int, all_b: int) -> Column:
    """Twice the log-likelihood ratio of a of all_a against b of all_b; 0 unless the first share is the larger."""
    x = lambda k, n, p: F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n - k > 0, (n - k) * F.log(1 - p)).otherwise(0.0)
    n, m = F.lit(all_a), F.lit(all_b)
    both = (a + b) / (n + m)
    return F.when(a * m > b * n, 2 * (x(a, n, a / n) + x(b, m, b / m) - x(a, n, both) - x(b, m, both))).otherwise(0.0)


class Reader:
    """Counts a lexicon's entries in texts."""

    def __init__(self, lexicon: list[str]):
        self.entries = {x: i for i, x in enumerate(lexicon)}
        least = ENDS[0]
        self.starts, self.ends = {x[1 : 1 + least] for x in lexicon if x[0] == "^"}, {x[-least:] for x in lexicon if x[0] == "$"}
        self.whole = {x[1:] for x in lexicon if x[0] == "="}

    def _counts(self, words: list[str]) -> dict[int, int]:
        """How often the words have each entry; most words have neither a beginning nor an end of any, and are done at once."""
        starts, ends, whole, least, entries = self.starts, self.ends, self.whole, ENDS[0], self.entries
        found = Counter([w for w in words if w[:least] in starts or w[-least:] in ends or w[:64] in whole])
        counts: dict[int, int] = {}
        for w, c in found.items():
            for x in parts_of(w):
                i = entries.get(x)
                if i is not None:
                    counts[i] = counts.get(i, 0) + c
        return counts

    def read(self, text: str | None) -> tuple[int, dict[int, int], int]:
        """Words, counts of entries, and the forms as bits."""
        tokens = (text or "").split()
        if not tokens:
            return 0, {}, 0
        lowered = text.lower()
        words = WORD.findall(lowered)
        all_, shouted = len(tokens), sum(map(str.isupper, tokens))
        exclaimed = sum("!" in t for t in tokens) if "!" in text else 0
        marked = sum(not SYMBOLS.isdisjoint(t) for t in tokens) if SYMBOL.search(text) else 0
        different = set(tokens)
        odd = [t for t in map(str.lower, different) if not t.isalpha() and DISGUISED.search(t)] if DISGUISED.search(lowered) else []
        disguised = any(not self._counts(WORD.findall(t)) and self._counts(WORD.findall(t.translate(DISGUISES))) for t in odd)
        forms = (2 * shouted >= all_, 4 * exclaimed >= all_, 4 * marked >= all_, all_ >= 20 and 3 * len(different) <= all_, disguised)
        return len(words), self._counts(words), sum(int(f) << j for j, f in enumerate(forms))


def counted(rows: DataFrame, lexicon: list[str], columns: list[str]) -> DataFrame:
    """The given columns, words, entries, counts and forms of each row's text, which is the first column."""
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        for part in byte_slices(batches, 0):
            ns, ends, ids, tfs, forms = [], [0], [], [], []
            for text in part.column(0):
                n, counts, form = reader.read(text.as_py())
                ns.append(n)
                ids += counts
                tfs += counts.values()
                ends.append(len(ids))
                forms.append(form)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(ns, pa.int32()), *lists, pa.array(forms, pa.int32())], [*columns, "words", "entries", "counts", "forms"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.select("text", *columns).mapInArrow(run, f"{kinds}, words int, entries array<int>, counts array<int>, forms int")


@dataclass
class Model:
    """What is learned; voters: (entry, level), behind them the forms."""

    lexicon: list[str]
    voters: list[tuple[int, int]] = field(default_factory=list)
    prior: float = 0.0
    rates: np.ndarray | None = None  # of firing, by class and voter
    labels: tuple[float, float] = (0.9, 0.02)  # of a label 1, given class 1 and 0
    shares: np.ndarray | None = None  # of a voter's evidence that counts
    weights: np.ndarray | None = None
    constant: float = 0.0

    def fires(self, words: np.ndarray, row: np.ndarray, entry: np.ndarray, count: np.ndarray, forms: np.ndarray) -> np.ndarray:
        """Which voters fire and how many, as rows of marks, from counts as (row, entry, count)."""
        v = len(self.voters)
        out = np.zeros((len(words), v + len(FORMS) + MANY), bool)
        of: dict[int, list[tuple[int, int]]] = {}
        for j, (e, level) in enumerate(self.voters):
            of.setdefault(e, []).append((j, level))
        mine = np.flatnonzero(np.isin(entry, list(of)))
        for e, js in of.items():
            at = mine[entry[mine] == e]
            for j, level in js:
                least, share = LEVELS[level]
                hit = at[(count[at] >= least) & (True if share is None else count[at].astype(np.int64) * share >= words[row[at]])]
                out[row[hit], j] = True
        for j in range(len(FORMS)):
            out[:, v + j] = (forms >> j) & 1
        out[np.arange(len(words)), v + len(FORMS) + np.minimum(out[:, :v].sum(axis=1), MANY - 1)] = True
        return out

    def logit(self, fires: np.ndarray) -> np.ndarray:
        """Log-odds of toxicity given the votes, without labels."""
        v, end = len(self.voters), len(self.voters) + len(FORMS)
        which = self.rates[:, :v] / self.rates[:, :v].sum(axis=1, keepdims=True)  # of all that fire
        on, off = np.log(self.rates[1] / self.rates[0]), np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        weight = np.concatenate([np.log(which[1] / which[0]), (on - off)[v:end], on[end:]]) * self.shares
        return math.log(self.prior / (1 - self.prior)) + fires @ weight + (off * self.shares)[v:end].sum()

    def posterior(self, fires: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Given votes and labels, which are NaN where there is none."""
        (a, b), known = self.labels, ~np.isnan(y)
        t = np.where(known, y, 0.0)
        evidence = t * math.log(a / b) + (1 - t) * math.log((1 - a) / (1 - b))
        return _sigmoid(self.logit(fires) + np.where(known, evidence, 0.0))

    def score(self, words: np.ndarray, row: np.ndarray, entry: np.ndarray, count: np.ndarray, fires: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(words), self.constant)
        rate = np.sqrt(count / np.maximum(words[row], 1))
        out = np.bincount(row, rate * self.weights[entry], len(words)) if len(row) else np.zeros(len(words))
        return _sigmoid(out + fires @ self.weights[len(self.lexicon) : -1] + self.weights[-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """words, row, entry, count, forms of a batch of counted rows."""
    column = lambda name: batch.column(batch.schema.get_field_index(name))
    lists = column("entries")
    sizes = np.diff(lists.offsets.to_numpy())
    return column("words").to_numpy(), np.repeat(np.arange(batch.num_rows), sizes), lists.flatten().to_numpy(), column("counts").flatten().to_numpy(), column("forms").to_numpy()


def chosen_voters(flat: tuple, y: np.ndarray, entries: int, most: int = VOTERS) -> list[tuple[int, int]]:
    """(entry, level) of the lexicon's voters: each next one separates the toxic documents that lack voters from the others best."""
    words, row, entry, count, _ = flat
    level = np.array([levels_of(c, w) for c, w in zip(count.tolist(), words[row].tolist())], np.int64) if len(row) else np.zeros(0, np.int64)
    toxic, has, out = y >= 0.5, np.zeros(len(y)), []
    hits = []
    for k in range(len(LEVELS)):
        at = level > k
        hits.append((entry[at], row[at]))
    clean = [np.bincount(e[~toxic[r]], minlength=entries) for e, r in hits]
    all_clean, taken = max(1, int((~toxic).sum())), np.zeros((len(LEVELS), entries), bool)
    while entries and len(out) < most:
        open_ = toxic & (has < WANTED)
        gain = []
        for (e, r), c in zip(hits, clean):
            a = np.bincount(e[open_[r]], minlength=entries).astype(float)
            p, q = (a + 0.1) / (open_.sum() + 1), (c + 1.0) / (all_clean + 2)
            gain.append(np.where((p > q) & (a >= LEAST_DOCS / 2), a * np.log(p / q), 0.0))
        gain = np.where(taken, 0.0, np.array(gain))
        k, e = np.unravel_index(gain.argmax(), gain.shape)
        if gain[k, e] <= LEAST_RATIO / 2:
            return out
        taken[k, e] = True
        out.append((int(e), int(k)))
        own = hits[k][1][hits[k][0] == e]
        has[own] += 1
    return out


def patterns(rows: DataFrame, labels: DataFrame, model: Model) -> DataFrame:
    """(votes, y, n): how many rows vote alike; y is null without a label."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                packed = np.packbits(sent.value.fires(*_flat(batch)), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.tobytes() for p in packed], pa.binary())], ["id", "votes"])

    votes = rows.select("id", "words", "entries", "counts", "forms").mapInArrow(run, "id string, votes binary")
    return written(votes.join(labels, "id", "left").groupBy("votes", "y").agg(F.count("*").alias("n")), "votes")


def estimated(rows: DataFrame, model: Model, steps: int = STEPS) -> None:
    """Expectation maximisation over all patterns: prior, rates, accuracy of labels, correlations."""
    m = len(model.voters) + len(FORMS) + MANY
    context = rows.sparkSession.sparkContext
    for _ in range(steps):
        sent = context.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            both, known = np.zeros((2, m + 1, m + 1)), np.zeros((2, 2))
            for batch in batches:
                if not batch.num_rows:
                    continue
                votes = np.stack([np.frombuffer(v, np.uint8) for v in batch.column(0).to_pylist()])
                fires = np.unpackbits(votes, axis=1)[:, :m].astype(float)
                y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
                n, p = batch.column(2).to_numpy(), sent.value.posterior(fires, y)
                one = np.hstack([fires, np.ones((len(fires), 1))])
                labelled, t = ~np.isnan(y), np.nan_to_num(y)
                for c, q in enumerate((1 - p, p)):
                    both[c] += (one * (n * q)[:, None]).T @ one
                    known[c] += ((n * q * labelled) @ (1 - t), (n * q * labelled) @ t)
            sums = np.rint(np.concatenate([both.ravel(), known.ravel()]) * UNIT).astype(np.int64)
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["at", "x"])

        sums = np.zeros(2 * (m + 1) ** 2 + 4)
        for r in rows.mapInArrow(run, "at bigint, x bigint").groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # the square of the voters' number, twice
            sums[r["at"]] = float(r["x"]) / UNIT
        sent.unpersist()
        both, known = sums[:-4].reshape(2, m + 1, m + 1), sums[-4:].reshape(2, 2)
        n = both[:, m, m]
        model.prior = float((n[1] + 1) / (n.sum() + 2))
        model.rates = (both[:, m, :m] + 0.5) / (n[:, None] + 1)
        rate = lambda c: float(np.clip((known[c, 1] + 1) / (known[c].sum() + 2), 1e-3, 0.999))
        model.labels = (max(0.8, rate(1)), min(0.2, rate(0)))
        # Positive correlations within classes, pooled over both.
        cov = (both[:, :m, :m] - n[:, None, None] * model.rates[:, :, None] * model.rates[:, None, :]).sum(axis=0) / n.sum()
        spread = np.sqrt(np.maximum(cov.diagonal(), 1e-12))
        correlation = np.clip(cov / (spread[:, None] * spread[None, :]), 0, 1)
        np.fill_diagonal(correlation, 0)
        correlation[-MANY:], correlation[:, -MANY:] = 0, 0
        model.shares = 1 / (1 + (correlation**2).sum(axis=1))


def trained(model: Model, flat: tuple, fires: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int = 12) -> None:
    """Logistic regression on posterior labels, by Newton's method."""
    words, row, entry, count, _ = flat
    d = len(model.lexicon)
    x = np.zeros((len(words), d + fires.shape[1] + 1))
    x[row, entry] = np.sqrt(count / np.maximum(words[row], 1))
    x[:, d:-1], x[:, -1] = fires, 1
    weight = weight / weight.sum()
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-9
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        slope = x.T @ (weight * (p - target)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", labelled: int = LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(id_col).cast("string").alias("id"), (fold(F.col(id_col), 5) == 0).alias("held_out"))
    known = labels.filter(F.col(label_id).isNotNull() & F.col(label_col).isNotNull() & (fold(F.col(label_id), 5) != 0))
    known = known.groupBy(F.col(label_id).cast("string").alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    texts, counts = sample(rows.filter(~F.col("held_out")), known, labelled)
    model = Model(mined(texts) if len(counts) == 2 else [])
    table = written(counted(rows, model.lexicon, ["doc_id", "id", "held_out"]), "entries")
    if len(counts) < 2:
        model.constant = float(True in counts)
    else:
        # 2 * labelled rows of ENTRIES counts at most.
        own = next(iter(counted(texts, model.lexicon, ["id", "y"]).toArrow().combine_chunks().to_batches()), None)
        if own is None:
            model.constant = counts[True] / (counts[True] + counts[False])
        else:
            flat, y = _flat(own), own.column(own.schema.get_field_index("y")).to_numpy()
            model.voters = chosen_voters(flat, y, len(model.lexicon))
            fires, toxic = model.fires(*flat), y >= 0.5
            model.prior = counts[True] / (counts[True] + counts[False])
            model.rates = np.array([(fires[c].sum(axis=0) + 0.5) / (c.sum() + 1) for c in (~toxic, toxic)])
            model.shares = np.ones(fires.shape[1])
            votes = patterns(table.filter(~F.col("held_out")), known, model)
            estimated(votes, model)
            discard(votes)
            weight = np.where(toxic, counts[True] / max(1, toxic.sum()), counts[False] / max(1, (~toxic).sum()))
            trained(model, flat, fires.astype(float), model.posterior(fires, y), weight)
    discard(texts)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = _flat(batch)
            fires = sent.value.fires(*flat) if sent.value.weights is not None else None
            score = sent.value.score(*flat[:4], fires)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return table.select("doc_id", "held_out", "words", "entries", "counts", "forms").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
