"""Operator 9: quality rules as a short-circuit cascade.

Method: each rule is a condition on the text that rejects it.  A sample of rows, taken by their hashes, becomes a
table; there each rule's verdicts are counted and its cost is measured, as the time that it takes on the
sampled rows beyond that of the words alone.  The rules are then put in order greedily, the next one
being that with the most rejections per cost among the rows that the earlier ones pass.  The order is
compiled into one CASE expression, so a row is not looked at further once a rule rejects it.  Order
changes the cost only: a text is kept if no rule rejects it, so a clock may decide.

`filtered` has all rules in the cascade, few words and repeated ones among them, and makes a count only where the
cascade comes to it.  `judged` gives out the base counts, so makes them of every row, and has the other rules in the cascade.

Built-in DataFrame functions only.  All counts are made within the row, without a shuffle.

Defined results: null text counts as a text without words; without words all counts are 0 and the base
rule fails; repeated rows each give a row; texts of any length are counted whole; an empty table gives
an empty table; other columns aren't read.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pumpline.llm.shared import discard, written

#: What parts words, as the contract has it: space and the control characters 9 to 13.
BLANKS = "\t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rows that costs and selectivities are estimated on, about; the most that they may be; how often a clock reads a rule on them.
SAMPLE_ROWS, MOST_ROWS, READINGS = 1000, 4000, 1
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def repeated_words(words: Column) -> Column:
    """Words inside windows of 8 words that the text has twice or more."""
    last = F.size(words) - F.lit(WINDOW)
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of_pairs(pairs: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(pairs, a)["h"] == F.get(pairs, b)["h"], F.lit(False))
            twice = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
            starts = F.sort_array(F.transform(twice, lambda j: F.get(pairs, j)["i"]))
            return let(starts, lambda s: F.aggregate(s, F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n")), lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["at"])).alias("n")))["n"])

        return let(pairs, of_pairs)

    return F.when(last < 1, F.lit(0)).otherwise(let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))))


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.length(F.trim(line, F.lit(" " + BLANKS))) > 0)


#: A text's counts, each from the text and its words.
COUNTS: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, words: F.size(words).cast("bigint"),
    "word_chars": lambda text, words: F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w)).cast("bigint"),
    "n_symbols": lambda text, words: (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"),
    "n_dup_lines": lambda text, words: let(lines_of(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
    "n_repeat_words": lambda text, words: repeated_words(words).cast("bigint"),
}
#: Gives a count by its name, the text or the words.
Of = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """reject: the condition, from what is known of a text."""

    name: str
    reject: Callable[[Of], Column]


#: The base: too few words, too many in repeated windows.
BASE = (Rule("few_words", lambda of: of("n_words") < 20), Rule("repeated_words", lambda of: of("n_repeat_words") * 100 > of("n_words") * 30))


def default_rules() -> list[Rule]:
    """Rules for prose; what most of a clean text is passes each of them by far."""
    without = lambda of, chars: F.length(F.translate(of("text"), chars, ""))
    return [
        Rule("symbols", lambda of: of("n_symbols") * 10 > of("n_words")),
        Rule("word_length", lambda of: let(of("word_chars"), lambda n: (n < of("n_words") * 2) | (n > of("n_words") * 20))),
        Rule("duplicate_lines", lambda of: of("n_dup_lines") * 2 > F.size(lines_of(of("text")))),
        Rule("shouting", lambda of: without(of, UPPER) < without(of, UPPER.lower())),
        Rule("exclamations", lambda of: (F.length(of("text")) - without(of, "!")) * 2 > of("n_words")),
        Rule("alphabetic", lambda of: F.size(F.filter(of("words"), lambda w: w.rlike(r"\p{L}"))) * 2 < of("n_words")),
    ]


def _from(text: Column, words: Column) -> Of:
    """Counts made where they are asked for."""
    return lambda name: text if name == "text" else words if name == "words" else COUNTS[name](text, words)


def _stored(text: Column, words: Column) -> Of:
    """Counts that are columns already."""
    return lambda name: text if name == "text" else words if name == "words" else F.col(name)


def _hashable(rows: DataFrame) -> list[Column]:
    """The row's columns that have a hash: maps and variants have none."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema["row"].dataType.fields} if "row" in rows.columns else {}
    return [F.col(f"row.`{c}`") for c, kind in kinds.items() if "map<" not in kind and "variant" not in kind]


def sampled(rows: DataFrame) -> DataFrame:
    """About SAMPLE_ROWS of the rows, those with the smallest hashes, as a table of one column `text`."""
    n = rows.count()
    hashed = F.pmod(F.xxhash64("text", *_hashable(rows)), F.lit(1_000_003))
    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    # Rows that are equal in all columns share a hash, hence the bound.
    return written(rows.filter(hashed < share * 1_000_003).select("text").limit(MOST_ROWS).coalesce(1), "sample")


def _timed(rows: DataFrame, value: Column) -> float:
    """Seconds that a value takes on all rows, the least of some readings; the first one, which compiles, doesn't count."""
    took = []
    for _ in range(READINGS + 1):
        began = time.perf_counter()
        rows.agg(F.count_if(value)).collect()
        took.append(time.perf_counter() - began)
    return min(took[1:])


def costs(sample: DataFrame, rules: list[Rule]) -> list[float]:
    """What each rule takes on the sample beyond the words alone, in seconds, a millisecond at least."""
    alone = _timed(sample, let(words_of(F.col("text")), lambda w: F.size(w) >= 0))
    asked = lambda rule: let(words_of(F.col("text")), lambda w: rule.reject(_from(F.col("text"), w)))
    return [max(1e-3, _timed(sample, asked(rule)) - alone) for rule in rules]


def ordered(sample: DataFrame, rules: list[Rule], cost: Callable[[DataFrame, list[Rule]], list[float]] = costs) -> list[Rule]:
    """The rules by rejections per cost, each among the sampled rows that the earlier ones pass.

    sample: a table of few rows with a column text; only their verdicts come to the driver.
    """
    if not rules:
        return []
    verdicts = lambda w: F.array(*[F.coalesce(r.reject(_from(F.col("text"), w)), F.lit(False)) for r in rules])
    seen = [r["v"] for r in sample.select(let(words_of(F.col("text")), verdicts).alias("v")).collect()]
    if not seen:
        return list(rules)
    of, left, rest, out = cost(sample, rules), seen, list(range(len(rules))), []
    while rest:
        best = max(rest, key=lambda i: (sum(v[i] for v in left) / of[i], -of[i], -i))
        out.append(rules[best])
        rest.remove(best)
        left = [v for v in left if not v[best]]
    return out


def _rows(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def _order(rows: DataFrame, rules: list[Rule]) -> list[Rule]:
    sample = sampled(rows)
    out = ordered(sample, rules)
    discard(sample)
    return out


def _cascade(rules: list[Rule], of: Of) -> Column:
    """Whether no rule rejects; the later ones are asked only where the earlier ones pass."""
    chain = None
    for rule in rules:
        reject = F.coalesce(rule.reject(of), F.lit(False))
        chain = F.when(reject, F.lit(False)) if chain is None else chain.when(reject, F.lit(False))
    return F.lit(True) if chain is None else chain.otherwise(F.lit(True))


def judged(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: id, the base counts, base_failed and kept."""
    rows = _rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    order = _order(rows, default_rules() if rules is None else rules)
    text = F.col("text")
    counts = let(words_of(text), lambda w: F.struct(*[count(text, w).alias(name) for name, count in COUNTS.items()]))
    rows = rows.withColumn("counts", counts).select("row", "text", "counts.*")
    failed = F.lit(False)
    for rule in BASE:
        failed = failed | rule.reject(_stored(text, words_of(text)))
    rows = rows.withColumn("base_failed", failed)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(_cascade(order, _stored(text, words_of(text))))
    return rows.select("row.doc_id", *COUNTS, "base_failed", kept.alias("kept"))


def filtered(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text no rule rejects, those of the base among them."""
    rows = _rows(docs, text_col)
    order = _order(rows, [*BASE, *(default_rules() if rules is None else rules)])
    return rows.filter(let(words_of(F.col("text")), lambda w: _cascade(order, _from(F.col("text"), w)))).select("row.*")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT k, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
f AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g) WHERE c > 1),
r AS (SELECT k, count(DISTINCT i + j) AS n FROM f, (SELECT unnest(range(0, 8)) AS j) GROUP BY k),
c AS (SELECT w.k, doc_id, text, w, len(w) AS n_words,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r ON r.k = w.k),
b AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM c)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_dup_lines > len(lines)
    OR length(regexp_replace(text, '[^A-Z]', '', 'g')) > length(regexp_replace(text, '[^a-z]', '', 'g'))
    OR 2 * length(regexp_replace(text, '[^!]', '', 'g')) > n_words
    OR 2 * len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) < n_words) AS kept
FROM b
"""
