"""Listings of stations: pages, favourites, post codes and search."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

PER_PAGE = 24


def page(rows: DataFrame, number: int = 1, per_page: int = PER_PAGE, order=("id",)) -> DataFrame:
    """One page of rows in a total order; a page beyond the last is empty."""
    if number < 1:
        raise ValueError("pages are numbered from 1")
    return rows.orderBy(*order).offset((number - 1) * per_page).limit(per_page)


def page_count(rows: DataFrame, per_page: int = PER_PAGE) -> int:
    """Pages in all; none for no rows."""
    return math.ceil(rows.count() / per_page)


def links(current: int, last: int, around: int = 2) -> list[int | None]:
    """Page numbers of a paginator: first, last, those around the current one, None for what is left out."""
    shown = sorted({1, last, *range(current - around, current + around + 1)} & set(range(1, last + 1)))
    out: list[int | None] = []
    for n in shown:
        if out and out[-1] is not None and n - out[-1] > 1:
            out.append(None)
        out.append(n)
    return out


def page_links(rows: DataFrame, around: int = 2, per_page: int = PER_PAGE) -> DataFrame:
    """(current, place, page): the links of every page of a listing, as `links` has them; a null page is a gap."""
    last = F.ceil(F.count("*") / per_page).cast("int")
    pages = rows.agg(last.alias("last")).filter("last > 0").select("last", F.explode(F.sequence(F.lit(1), "last")).alias("current"))
    near = F.sequence(F.greatest(F.lit(1), F.col("current") - around), F.least(F.col("last"), F.col("current") + around))
    shown = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(1), F.col("last")), near)))
    before = lambda x, i: (i > 0) & (x - F.get(shown, i - 1) > 1)
    with_gaps = F.flatten(F.transform(shown, lambda x, i: F.when(before(x, i), F.array(F.lit(None).cast("int"), x)).otherwise(F.array(x))))
    return pages.select("current", F.posexplode(with_gaps).alias("place", "page"))


def one(stations: DataFrame, station: str) -> DataFrame:
    return stations.filter(F.col("id") == station.lower())


def favourites(stations: DataFrame, number: int = 1) -> DataFrame:
    return page(stations.filter(F.col("favorite")), number)


def by_post_code(stations: DataFrame, post_code: str, number: int = 1) -> DataFrame:
    return page(stations.filter(F.col("address.postCode") == post_code), number)


def toggled(stations: DataFrame, station: str) -> DataFrame:
    """All stations, the given one's favourite flag turned."""
    flag = F.coalesce(F.col("favorite"), F.lit(False))
    return stations.withColumn("favorite", F.when(F.col("id") == station, ~flag).otherwise(flag))


def searched(stations: DataFrame, query: str) -> DataFrame:
    """Stations of which a word of name, street, city or post code begins with the query, those with more such fields first.

    The score is the number of fields; a hosted search engine's relevance isn't reproduced.
    """
    wanted = query.strip().lower()
    fields = [F.col("name"), F.col("address.street"), F.col("address.city"), F.col("address.postCode")]
    hit = lambda f: F.coalesce(F.exists(F.split(F.lower(f), r"[^\p{L}\p{N}]+"), lambda t: t.startswith(wanted)), F.lit(False)).cast("int")
    score = sum((hit(f) for f in fields[1:]), hit(fields[0]))
    rows = stations.withColumn("score", score)
    return rows.filter(F.col("score") > 0) if wanted else rows.filter(F.lit(False))


def search_page(stations: DataFrame, query: str, number: int = 1) -> DataFrame:
    return page(searched(stations, query), number, order=(F.desc("score"), "id"))
