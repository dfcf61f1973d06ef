"""Summaries, the index of words, listings by part, and hot stations."""

import bisect
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pumpline.operators import charts, daily, latest, listing, prefixes, stations, summaries
from pumpline.plans import domain

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def averages(spark, rows):
    address = "struct<id: string, address: struct<postCode: string>>"
    return spark.createDataFrame([(datetime(2024, 1, d), "e5", (str(i), (code,)), x) for i, (d, code, x) in enumerate(rows)], f"day timestamp_ntz, fuel string, station {address}, weightedAveragePrice double")


@pytest.mark.parametrize(("salts", "ties"), [(1, False), (1, True), (3, False)])
def test_merged_percentiles_stay_within_their_bound(spark, salts, ties):
    r = random.Random(salts)
    rows = [(1 + i % 4, str(i % 3), round(r.gauss(1.5, 0.2), 1 if ties else 6)) for i in range(5000)]
    got = summaries.summarised(averages(spark, rows), runs=16, salts=salts)
    assert got.agg(F.sum("weight")).first()[0] == 5000 and got.count() <= 12 * salts * 16
    merged = summaries.percentiles(got, "fuel").first()
    values = sorted(x for _, _, x in rows)
    for share, name in zip((0.5, 0.9, 0.95, 0.99), ("p50", "p90", "p95", "p99")):
        x, want = merged.percentiles[name], share * 5000
        off = max(0, bisect.bisect_left(values, x) - want, want - bisect.bisect_right(values, x))
        assert off <= 5000 / (2 * 16) + 12 * salts


def test_small_groups_are_exact(spark):
    rows = [(1, "a", float(i)) for i in range(50)] + [(2, "b", 3.0)]
    got = summaries.percentiles(summaries.summarised(averages(spark, rows)), "day").orderBy("day").collect()
    assert got[0].percentiles.p50 == 24.5 and got[1].percentiles.p99 == 3.0 and [g.n for g in got] == [50, 1]


def test_the_index_finds_what_the_search_finds(spark, tmp_path):
    address = "struct<street: string, houseNumber: string, postCode: string, city: string>"
    rows = [("1", "Öl & Gas", ("Mill Lane", "1", "12345", "Oldtown")), ("2", "OIL-Depot oil", ("Ölweg", "2", "1234", None)), ("3", None, (None, None, None, None)), ("4", "a 12", ("b", "c", "d", "Mil.Oil"))]
    table = spark.createDataFrame([(*r, 1) for r in rows], f"id string, name string, address {address}, field int")
    index = prefixes.write(table, str(tmp_path / "words"))
    for query in ("o", " OIL ", "öl", "12", "1234", "mil", "d", "x", "", "mill lane", "\U0001f600"):
        want = {(r.id, r.score) for r in stations.searched(table, query).collect()}
        assert {(r.id, r.score) for r in prefixes.searched(index, table, query).collect()} == want
    text = plan(prefixes.searched(index, table, "mil"))
    assert "GreaterThanOrEqual(word,mil)" in text and "LessThan(word,mil" in text


def test_no_task_holds_the_words_of_many_stations(spark, tmp_path):
    """Words repeat within a field only, so nothing is aggregated; a word of all stations doesn't lie in one task."""
    address = "struct<street: string, houseNumber: string, postCode: string, city: string>"
    rows = [(str(i), "Station station 7", (None, "1", "7", "Station")) for i in range(400)]
    table = spark.createDataFrame(rows, f"id string, name string, address {address}")
    assert "Aggregate" not in plan(prefixes.words(table))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = prefixes.write(table, str(tmp_path / "words"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert index.count() == index.distinct().count() == 1600
    assert index.filter("word = 'station'").select(F.col("_metadata.file_path")).distinct().count() > 1


def test_every_page_of_a_listing(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i * 7919 % 1000:04}", i) for i in range(205)], "id string, part_of int")
    found = listing.write(rows, str(tmp_path / "listing"), parts=6)
    assert found.pages() == 9
    for number in range(1, 11):
        page = found.page(number)
        assert [r.id for r in page.collect()] == [r.id for r in stations.page(rows, number).collect()] and page.columns == rows.columns
        read = re.search(r"PartitionFilters: \[[^\]]*\]", plan(page))
        assert number > 9 or (read and "part#" in read.group(0) and read.group(0).count(",") <= 3)
    with pytest.raises(ValueError):
        found.page(0)
    assert listing.write(rows.limit(0), str(tmp_path / "none")).page(1).count() == 0


def test_links_of_all_pages(spark):
    for n in (0, 1, 24, 25, 240, 241):
        got = {}
        for r in stations.page_links(spark.range(n), 2).orderBy("current", "place").collect():
            got.setdefault(r.current, []).append(r.page)
        last = stations.page_count(spark.range(n))
        assert got == {c: stations.links(c, last, 2) for c in range(1, last + 1)}


def test_openings_of_a_hot_station(spark):
    """One station with nine tenths of all rows is spread over tasks by month; nulls and gaps of months are passed over."""
    r = random.Random(2)
    rows = [("hot", "e5", datetime(2020 + i // 336, 1 + i // 28 % 12, 1 + i % 28), float(i) if i % 13 else None) for i in range(900) if i // 28 not in (3, 4, 9)]
    rows += [(f"s{i}", "e5", datetime(2020, 1 + r.randrange(12), 1 + r.randrange(28)), 1.0 + i) for i in range(100)]
    known = spark.createDataFrame(rows, "station string, fuel string, day timestamp_ntz, closingPrice double")
    probes = known.select("station", "fuel", "day").unionByName(spark.createDataFrame([("hot", "e5", datetime(2020, 4, 5)), ("none", "e5", datetime(2020, 4, 5)), ("hot", "e5", datetime(2019, 4, 5))], "station string, fuel string, day timestamp_ntz"))
    key = lambda df: sorted(map(str, df.collect()))
    spread = daily.opening_as_of(probes, known, spread=True)
    assert key(spread) == key(daily.opening_as_of(probes, known))
    moved = [line for line in plan(spread).splitlines() if "Exchange hashpartitioning(station" in line]
    assert moved and any("month" in line.split("), ")[0] for line in moved)


def test_last_days_of_the_products(spark):
    rows = spark.createDataFrame([("s", f, datetime(2024, 1, d)) for f in ("diesel", "e5", "e10") for d in range(1, 32)], "station string, fuel string, day timestamp_ntz")
    for fuel, found in (("diesel", latest.last_days_diesel), ("e5", latest.last_days_e5), ("e10", latest.last_days_e10)):
        got = found(rows, "s").collect()
        assert [r.day.day for r in got] == list(range(31, 1, -1)) and {r.fuel for r in got} == {fuel}


def test_merged_filters():
    assert charts.merged_filter({"fuel": "e5", "day": ("a", "b")}, {"day": ("c", "d"), "station": "s"}) == {"fuel": "e5", "day": ("c", "d"), "station": "s"}
    assert charts.merged_filter({"day": "x"}, {"day": ("c", "d"), "fuel": "e10"}) == {"day": "x", "fuel": "e10"}


def test_charts_read_summaries_only(spark, tmp_path):
    from pumpline.plans import imports
    from pumpline.sources.store import Store

    store = Store(spark, str(tmp_path))
    store.by_day("daily").append(daily.daily_prices(domain.reports(spark, DIR), domain.stations(spark, DIR)))
    days = imports.keep_summaries(store)
    assert days == store.by_day("daily").parts() and imports.keep_summaries(store) == []
    chosen = summaries.percentiles(store.by_day("summaries").read(days[:3]), "fuel")
    assert all("/summaries/data/" in f for f in chosen.inputFiles()) and chosen.count() == 5


def test_merges_into_buckets_leave_stored_rows_in_place(spark, tmp_path):
    from pumpline.sources.store import Store, keep_existing, merge_fields, replace_matching

    table = Store(spark, str(tmp_path)).bucketed("rows", ["k"], 4)
    stored = table.write(spark.createDataFrame([(i, f"old{i}", i) for i in range(100)], "k int, x string, y int"))
    new = spark.createDataFrame([(i, f"new{i}", None) for i in range(90, 120)], "k int, x string, y int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for merge, size in ((merge_fields, 120), (keep_existing, 120), (replace_matching, 120)):
            merged = merge(stored, new, ["k"])
            lines = plan(merged).split("== Initial Plan ==")[0].splitlines()
            depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
            scans = [i for i, line in enumerate(lines) if "FileScan parquet" in line and "Bucketed: true" in line]
            assert scans
            if merge is merge_fields:
                for i in scans:  # nothing above a scan of stored rows deals them anew
                    above, at = [], depth(lines[i])
                    for line in reversed(lines[:i]):
                        if depth(line) < at:
                            at = depth(line)
                            above.append(line)
                    assert not any("Exchange" in line for line in above)
            assert merged.count() == size
        assert table.write(merge_fields(table.read(), new, ["k"])).filter("k = 95").first() == (95, "new95", 95)
        again = Store(spark.newSession(), str(tmp_path)).bucketed("rows", ["k"], 4).read()
        assert again.count() == 120
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
