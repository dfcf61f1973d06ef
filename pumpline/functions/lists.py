"""Expressions on a day's list of prices: entries are structs with id, date and price, in order of date."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Seconds of a day in UTC; no day has 23 or 25 hours there.
DAY_SECONDS = 86_400


def column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def by_date(prices) -> Column:
    """Entries by date, then id."""
    keyed = F.transform(column(prices), lambda p: F.struct(p["date"].alias("a"), p["id"].alias("b"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda x: x["p"])


def by_price(prices) -> Column:
    """Entries by price, those of a price by date, then id."""
    keyed = F.transform(column(prices), lambda p: F.struct(p["price"].alias("a"), p["date"].alias("b"), p["id"].alias("c"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda x: x["p"])


def without_last(values) -> Column:
    return F.slice(column(values), F.lit(1), F.greatest(F.size(column(values)) - 1, F.lit(0)))


def shifted(prices) -> Column:
    """Each entry's predecessor's price: null first, the last entry's price left out."""
    prices = column(prices)
    return F.transform(prices, lambda p, i: F.when(i > 0, F.get(prices, i - 1)["price"]))


def zipped(a, b, of_a: list[str], of_b: list[str], defaults: dict[str, Column]) -> Column:
    """Structs of two lists merged place by place: b's field stands before a's, and the default where neither has one.

    The shorter list counts as filled with nulls; of_a, of_b: the structs' fields.
    """
    def merged(x: Column, y: Column) -> Column:
        values = {f: [*([y[f]] if f in of_b else []), *([x[f]] if f in of_a else []), *([defaults[f]] if f in defaults else [])] for f in dict.fromkeys([*of_a, *of_b, *defaults])}
        return F.struct(*[F.coalesce(*v).alias(f) for f, v in values.items()])

    return F.zip_with(column(a), column(b), merged)


def with_previous(prices) -> Column:
    """Entries with the previous entry's price; the first has none yet."""
    before = F.transform(shifted(prices), lambda p: F.struct(p.alias("previousPrice")))
    return zipped(prices, before, ["id", "date", "price"], ["previousPrice"], {})


def with_opening(prices, opening) -> Column:
    """Entries without a previous price get the day's opening price."""
    opening = column(opening)
    return F.transform(column(prices), lambda p: F.struct(p["id"].alias("id"), p["date"].alias("date"), p["price"].alias("price"), F.coalesce(p["previousPrice"], opening).alias("previousPrice")))


def with_change(prices) -> Column:
    """Entries with their difference to the previous price, not rounded; null without one."""
    return F.transform(column(prices), lambda p: F.struct(p["id"].alias("id"), p["date"].alias("date"), p["price"].alias("price"), p["previousPrice"].alias("previousPrice"), (p["price"] - p["previousPrice"]).alias("change")))


def validity(prices, day, opening) -> Column:
    """Segments (start, until, price): from midnight with the opening or first price, then each until the next report, the last until midnight."""
    prices, day, opening = column(prices), column(day), column(opening)
    start = F.struct(day.alias("start"), F.coalesce(opening, F.get(prices, F.lit(0))["price"]).alias("price"))
    starts = F.concat(F.array(start), F.transform(prices, lambda p: F.struct(p["date"].alias("start"), p["price"].alias("price"))))
    ends = F.concat(F.transform(prices, lambda p: p["date"]), F.array((day + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz")))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s["start"].alias("start"), e.alias("until"), s["price"].alias("price")))


def seconds_between(start, end) -> Column:
    """Boundaries of seconds between two times, as whole seconds are counted."""
    return F.unix_timestamp(column(end).cast("timestamp")) - F.unix_timestamp(column(start).cast("timestamp"))


def rounded(value, digits: int) -> Column:
    """Half to even, of the scaled double as it stands."""
    return F.rint(column(value) * 10.0**digits) / 10.0**digits


def weighted_average(prices, day, opening) -> Column:
    """The price's average over the day's seconds, to 3 digits.

    The reports' segments are added in their order and the one from midnight at last: a sum of doubles depends on the order, and where the
    average lies at half a unit of its last digit, so does the rounded one.
    """
    prices, day, opening = column(prices), column(day), column(opening)
    segments = validity(prices, day, opening)
    first = F.get(prices, F.lit(0))
    until = F.coalesce(first["date"], (day + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz"))
    midnight = seconds_between(day, until) * F.coalesce(opening, first["price"])
    total = F.aggregate(F.slice(segments, F.lit(2), F.size(prices)), F.lit(0.0), lambda acc, s: acc + seconds_between(s["start"], s["until"]) * s["price"]) + midnight
    return rounded(total / DAY_SECONDS, 3)


def closing(prices) -> Column:
    return F.try_element_at(column(prices), F.lit(-1))["price"]


def lowest(prices) -> Column:
    """The entry with the lowest price; of equals the earliest."""
    return F.get(by_price(prices), F.lit(0))


def highest(prices, earliest: bool = False) -> Column:
    """The entry with the highest price; of equals the latest, or the earliest as live reports have it."""
    if not earliest:
        return F.try_element_at(by_price(prices), F.lit(-1))
    keyed = F.transform(column(prices), lambda p: F.struct((-p["price"]).alias("a"), p["date"].alias("b"), p["id"].alias("c"), p.alias("p")))
    return F.get(F.array_sort(keyed), F.lit(0))["p"]


def appended(prices, entry) -> Column:
    """The list with a report behind it, whose previous price is the last entry's."""
    prices, entry = column(prices), column(entry)
    last = F.try_element_at(prices, F.lit(-1))["price"]
    new = F.struct(entry["id"].alias("id"), entry["date"].alias("date"), entry["price"].alias("price"), last.alias("previousPrice"), (entry["price"] - last).alias("change"))
    return F.concat(prices, F.array(new))


def replaced_if(entry, new, above: bool) -> Column:
    """new if there is no entry or new's price is strictly above (below) its."""
    entry, new = column(entry), column(new)
    better = new["price"] > entry["price"] if above else new["price"] < entry["price"]
    return F.when(entry.isNull() | better, new).otherwise(entry)


def opening_in_first(prices, opening) -> Column:
    """The first entry with the opening price as its previous price, the rest as they are."""
    opening = column(opening)
    first = lambda p: F.struct(p["id"].alias("id"), p["date"].alias("date"), p["price"].alias("price"), opening.alias("previousPrice"), (p["price"] - opening).alias("change"))
    return F.transform(column(prices), lambda p, i: F.when(i == 0, first(p)).otherwise(p))


def latest_of(entries, new, depth: int | None = 30) -> Column:
    """A list of daily entries, the latest first, with a new one in place of that of its day; depth None: not cut."""
    entries, new = column(entries), column(new)
    others = F.filter(F.coalesce(entries, F.array()), lambda x: x["day"] != new["day"])
    keyed = F.transform(F.concat(others, F.array(new)), lambda x: F.struct(x["day"].alias("day"), x.alias("x")))
    out = F.transform(F.reverse(F.array_sort(keyed)), lambda k: k["x"])
    return out if depth is None else F.slice(out, 1, depth)


def named_percentiles(values, names=("p50", "p90", "p95", "p99")) -> Column:
    return F.struct(*[F.get(column(values), F.lit(i)).alias(n) for i, n in enumerate(names)])
