"""Operator 3: url filters by rules and a learned tree of path templates.

A url that a rule fits gets the verdict of the longest such rule.  All others are judged by templates, which
the urls with a rule's verdict - the labelled ones - teach.

Method.  Runs of digits and long hexadecimal strings in a path's segments become marks, and equal shapes of a host
are counted once, with their labels.  Then the tree of each host is walked level by level:

* A node whose children are many for its number of urls has a variable segment, which becomes `*`.
* The other children fall into families by what follows them most often, in 8 hashed buckets and one for the
  path's end.  Each is compared with its family by a chi-square test of these counts; those that it doesn't tell apart
  are merged, whatever their labels, so that labels carry over to branches without any.

A shape that is alone in its node keeps the rest of its path, and leaves the walk; it ends when all have left, at any depth.

A template's purity is its share of rejected labels, smoothed towards its host's, which is smoothed towards the
overall one.  Templates of at least REJECT purity are rejected.

Only aggregates and joins of DataFrames are used.  A host with very many urls is aggregated partially before
each shuffle; no step gathers a host.  Each level is a table in the shared folder.

Defined results: null urls and urls without `://` have an empty host and path, fit no rule and are judged as
the template of an empty path; urls of any length are read whole; repeated rows each give a row; an empty table
gives an empty table; other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pumpline.llm.shared import discard, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A variable segment: at least so many values, and more than so large a share of the urls.
MANY, SHARE = 20, 0.1
BUCKETS = 8
#: The 99th percentile of chi-square with 8 degrees of freedom.
SIMILAR = 20.09
SMOOTHING = 5.0
REJECT = 0.8


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and the start of a path."""

    host: str
    path: str
    verdict: str


RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _by_rules(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.host, r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.host + rule.path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def shape_of(path: Column) -> Column:
    """The path's segments with marks for numbers and long hexadecimal strings."""
    mark = lambda s: F.regexp_replace(F.regexp_replace(s, r"(?i)(?<![0-9a-z])(?=[0-9a-f]*[0-9])[0-9a-f]{8,}(?![0-9a-z])", "<x>"), "[0-9]+", "<n>")
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), mark)


def templates(urls: DataFrame) -> DataFrame:
    """(host, shape, template, n, b, a) of columns host, shape and label (true: to be rejected)."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    tree = urls.groupBy("host", "shape").agg(F.count("*").alias("n"), count(F.col("label")).alias("b"), count(~F.col("label")).alias("a")).withColumn("template", F.lit(""))
    columns, done, level = tree.columns, None, 0
    tree = written(tree, "urls")
    made = [tree]
    buckets = [f"k{i}" for i in range(BUCKETS + 1)]
    while True:
        # What is alone in its node, or ends here, is done; the rest of its path is part of its template.
        nodes = tree.groupBy("host", "template").agg(F.count("*").alias("shapes"), F.sum("n").alias("all"))
        counted = tree.join(nodes, ["host", "template"])
        rest = F.concat("template", F.array_join(F.transform(F.slice("shape", level + 1, F.greatest(F.size("shape") - level, F.lit(0))), lambda s: F.concat(F.lit("/"), s)), ""))
        over = (F.col("shapes") == 1) | (F.size("shape") <= level)
        ended = counted.filter(over).withColumn("template", rest).select(*columns)
        done = ended if done is None else done.unionByName(ended)
        alive = written(counted.filter(~over).withColumn("part", F.get("shape", F.lit(level))).withColumn("next", F.get("shape", F.lit(level + 1))), "alive")
        made.append(alive)
        if not alive.limit(1).count():
            out = written(done, "templates")
            discard(*made)
            return out
        at = F.when(F.col("next").isNull(), BUCKETS).otherwise(F.pmod(F.xxhash64("next"), F.lit(BUCKETS)))
        children = alive.groupBy("host", "template", "part").agg(F.max("all").alias("all"), F.sum("n").alias("n"), *[F.sum(F.when(at == i, F.col("n")).otherwise(0)).alias(k) for i, k in enumerate(buckets)])
        most = F.greatest(*buckets)
        family = F.lit(BUCKETS)
        for i in reversed(range(BUCKETS)):
            family = F.when(F.col(f"k{i}") == most, i).otherwise(family)
        children = written(children.withColumn("family", family), "children")
        made.append(children)
        kinds = children.groupBy("host", "template").agg(F.count("*").alias("kinds"))
        pools = children.groupBy("host", "template", "family").agg(F.count("*").alias("branches"), F.sum("n").alias("pool"), *[F.sum(k).alias(f"p{k}") for k in buckets])
        chi = sum((F.when(F.col(f"p{k}") == 0, 0.0).otherwise(F.pow(F.col(k) - F.col("n") * F.col(f"p{k}") / F.col("pool"), 2) / (F.col("n") * F.col(f"p{k}") / F.col("pool"))) for k in buckets), F.lit(0.0))
        judged = children.join(kinds, ["host", "template"]).join(pools, ["host", "template", "family"])
        variable = (F.col("kinds") >= MANY) & (F.col("kinds") > F.col("all") * SHARE)
        name = F.when(variable, "*").when((F.col("branches") > 1) & (chi <= SIMILAR), F.concat(F.lit("{"), F.col("family"), F.lit("}"))).otherwise(F.col("part"))
        named = judged.select("host", "template", "part", name.alias("name"))
        moved = alive.join(named, ["host", "template", "part"]).withColumn("template", F.concat("template", F.lit("/"), "name"))
        tree = written(moved.select(*columns), "urls")
        made.append(tree)
        level += 1


def rejected(tree: DataFrame, smoothing: float = SMOOTHING, reject: float = REJECT) -> DataFrame:
    """The (host, shape) whose template's smoothed purity is too low to let them pass."""
    total = tree.agg(F.sum("b").alias("b"), F.sum("a").alias("a")).collect()[0]
    overall = (total["b"] or 0) / max((total["b"] or 0) + (total["a"] or 0), 1)
    sums = lambda *keys: tree.groupBy(*keys).agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    smooth = lambda prior: (F.col("b") + prior * smoothing) / (F.col("b") + F.col("a") + smoothing)
    hosts = sums("host").select("host", smooth(F.lit(overall)).alias("prior"))
    bad = sums("host", "template").join(hosts, "host").filter(smooth(F.col("prior")) >= reject).select("host", "template")
    return tree.join(bad, ["host", "template"], "left_semi").select("host", "shape")


def by_rules(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, the longest rule that fits, and its verdict; nulls where none does."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = _by_rules(rules, F.col("host"), F.col("path"))
    return rows.withColumn("rule", rule).withColumn("by_rule", verdict)


def judged(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, the rule that fits, and the verdict."""
    rows = by_rules(pages, rules, id_col, url_col).withColumn("shape", shape_of(F.col("path")))
    tree = templates(rows.select("host", "shape", (F.col("by_rule") == "block").alias("label")))
    bad = rejected(tree).withColumn("bad", F.lit(True))
    out = rows.join(bad, ["host", "shape"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


def op3_urls(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def url_rules(spark, sf_dir: str) -> DataFrame:
    """The rules' part of the query, which SQL can express."""
    return by_rules(spark.read.parquet(f"{sf_dir}/pages.parquet"))


RULES_SQL = r"""
WITH r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT row_number() OVER () AS k, page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS by_rule
FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k, page_id, host, path
"""
