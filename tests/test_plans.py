"""Plans: what is pushed into scans, how often rows move, and that no Python runs."""

import re

import pytest

from pumpline import catalog
from pumpline.operators import aggregates, daily, latest, stations
from pumpline.plans import domain

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[-1]


def exchanges(df) -> int:
    return len(re.findall(r"\bExchange (?:hash|range|single)", plan(df), re.I))


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(domain.reports(spark, DIR))
    assert "GreaterThanOrEqual(value,0.5)" in text and "props" not in text


def test_grouping_and_windows_share_one_exchange(spark):
    assert exchanges(daily.daily_prices(domain.reports(spark, DIR))) == 1
    assert exchanges(aggregates.by_day_and_fuel(daily.daily_prices(domain.reports(spark, DIR)))) == 2


def test_spread_grouping_moves_lists_once(spark):
    """A station that holds much of all reports: its days are spread, and only closing prices meet for the openings."""
    reports = domain.reports(spark, DIR)
    text = plan(daily.daily_prices(reports, colocate=False))
    moved = [line for line in text.splitlines() if "Exchange hashpartitioning(station" in line]
    assert moved and all("day" in line.split("hashpartitioning(")[1].split("), ")[0] or "prices" not in line for line in moved)
    spread, dealt = (sorted(map(str, daily.daily_prices(reports, colocate=c).collect())) for c in (False, True))
    assert spread == dealt


def test_ranks_are_limited_before_the_shuffle(spark):
    rows = daily.daily_prices(domain.reports(spark, DIR), colocate=False)
    assert "WindowGroupLimit" in plan(latest.ranked(rows.select("id", "station", "fuel", "day", "closingPrice")))


def test_pages_are_top_k(spark):
    assert "TakeOrderedAndProject" in plan(stations.page(domain.stations(spark, DIR), 2))


@pytest.mark.parametrize("name", catalog.NAMES)
def test_neither_python_nor_cross_joins(spark, name):
    text = plan(catalog.queries()[name](spark, DIR))
    assert not re.search("Python|Pandas|Arrow|Cartesian|BroadcastNestedLoop", text)
