"""Single live reports on a stored day, and streams of reports."""

from datetime import datetime

import pytest

from pumpline.operators import daily
from pumpline.sources.store import Store
from pumpline.streaming import incremental

PRICE = "struct<id: string, date: timestamp_ntz, price: double, previousPrice: double, change: double>"
ENTRY = "struct<id: string, date: timestamp_ntz, price: double>"
ROWS = f"station string, fuel string, day timestamp_ntz, prices array<{PRICE}>, openingPrice double, closingPrice double, lowestPrice {ENTRY}, highestPrice {ENTRY}, weightedAveragePrice double"
REPORT = "id string, date timestamp_ntz, station string, fuel string, price double"


@pytest.fixture
def rows(spark):
    at = datetime(2024, 11, 19, 3, 7, 29)
    entry = ("first", at, 1.569)
    return spark.createDataFrame([("s", "diesel", datetime(2024, 11, 19), [(*entry, 1.599, 1.569 - 1.599)], 1.599, 1.569, entry, entry, 1.573)], ROWS)


@pytest.mark.parametrize(
    ("price", "day", "count", "previous", "opening", "average", "lowest", "highest"),
    [
        (1.629, 19, 2, 1.569, 1.599, 1.618, "first", "new"),
        (1.529, 19, 2, 1.569, 1.599, 1.543, "new", "first"),
        (1.529, 18, 1, None, None, 1.529, "new", "new"),
        (1.529, 20, 1, 1.569, 1.569, 1.539, "new", "new"),
    ],
)
def test_report(spark, rows, price, day, count, previous, opening, average, lowest, highest):
    report = spark.createDataFrame([("new", datetime(2024, 11, day, 6, 7, 29), "s", "diesel", price)], REPORT)
    row = incremental.reported(rows, report).filter(f"dayofmonth(day) = {day}").collect()[0]
    last = row.prices[-1]
    assert len(row.prices) == count and row.closingPrice == price
    assert last.previousPrice == previous and (last.change is None if previous is None else last.change == pytest.approx(price - previous))
    assert row.openingPrice == opening and row.weightedAveragePrice == pytest.approx(average, abs=1e-4)
    assert (row.lowestPrice.id, row.highestPrice.id) == (lowest, highest)


def test_several_reports_of_a_group_at_once(spark, rows):
    """As if one came after the other, and a new day opens with what the day before closes with."""
    made = [("a", datetime(2024, 11, 19, 6), "s", "diesel", 1.7), ("b", datetime(2024, 11, 19, 5), "s", "diesel", 1.5), ("c", datetime(2024, 11, 20, 1), "s", "diesel", 1.4), ("d", datetime(2024, 11, 20, 2), "s", "diesel", 1.7)]
    out = {r.day.day: r for r in incremental.reported(rows, spark.createDataFrame(made, REPORT)).collect()}
    assert [p.id for p in out[19].prices] == ["first", "b", "a"] and out[19].closingPrice == 1.7
    assert (out[19].lowestPrice.id, out[19].highestPrice.id) == ("b", "a")
    assert [(p.id, p.previousPrice) for p in out[20].prices] == [("c", 1.7), ("d", 1.4)] and out[20].openingPrice == 1.7
    one = rows
    for i in (1, 0, 2, 3):
        one = incremental.reported(one, spark.createDataFrame([made[i]], REPORT)).drop("isTouched")
    assert {r.day.day: r.asDict(True) for r in one.collect()} == {d: {k: v for k, v in r.asDict(True).items() if k != "isTouched"} for d, r in out.items()}


def test_refreshed_stations(spark, rows):
    late = spark.createDataFrame([("new", datetime(2024, 11, 20, 6), "s", "diesel", 1.1)], REPORT)
    first = incremental.refreshed(spark.createDataFrame([("s", "n"), ("t", "m")], "id string, name string"), rows)
    changed = incremental.reported(rows, late).filter("isTouched").select(*rows.columns)
    again = {r.id: r for r in incremental.refreshed(first, changed, depth=1).collect()}
    assert again["s"].latestPrice["diesel"].closingPrice == 1.1 and len(again["s"].latestPrices["diesel"]) == 1
    assert again["s"].name == "n" and again["t"].latestPrices is None
    both = {r.id: r for r in incremental.refreshed(first, changed).collect()}
    assert [x.closingPrice for x in both["s"].latestPrices["diesel"]] == [1.1, 1.569]


def test_a_batch_writes_its_days_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    at = lambda i, d, h, p, s="s": (i, datetime(2024, 1, d, h), s, "e5", p)
    process = lambda *rows: incremental.process(store, spark.createDataFrame(rows, REPORT))
    process(at("a", 1, 1, 1.0), at("b", 2, 1, 1.1), at("c", 5, 1, 1.2), at("d", 3, 1, 2.0, "t"))
    before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "store" / "daily").glob("data/w*/part=*/*.parquet")}
    changed = process(at("e", 2, 3, 1.5))  # the day behind it opens with 1.5 now
    assert sorted(r.day.day for r in changed.collect()) == [2, 5]
    after = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "store" / "daily").glob("data/w*/part=*/*.parquet")}
    names = {p.split("part=")[1] for p in set(before) & set(after)}
    assert {n[:10] for n in names} >= {"2024-01-01", "2024-01-03"} and not {p.split("part=")[1][:10] for p in set(after) - set(before)} & {"2024-01-01", "2024-01-03"}
    rows = {(r.station, r.day.day): r for r in store.by_day("daily").read().collect()}
    assert rows["s", 5].openingPrice == 1.5 and len(rows["s", 2].prices) == 2 and rows["t", 3].closingPrice == 2.0
    process(at("e", 2, 3, 1.5))
    assert {(r.station, r.day.day): r for r in store.by_day("daily").read().collect()} == rows


def test_stream_equals_batch(spark, tmp_path):
    made = [(str(i), datetime(2024, 1, 1 + i % 5, i % 23, i % 60, i), f"s{i % 3}", "e5", 1.0 + (i * 7 % 11) / 10) for i in range(40)]
    for k in range(2):
        spark.createDataFrame(made[k::2], REPORT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(REPORT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        incremental.start(stream, str(tmp_path / "store"), str(tmp_path / "checkpoint")).awaitTermination(180)
    store = Store(spark, str(tmp_path / "store"))
    key = lambda x: (x[0], x[1])
    assert sorted(pick_safe(store.by_day("daily").read()), key=key) == sorted(pick_safe(daily.daily_prices(spark.createDataFrame(made, REPORT))), key=key)
    assert {r.id for r in store.by_bucket("latest").read().collect()} == {"s0", "s1", "s2"}


def pick_safe(df):
    return [(r.station, str(r.day), r.openingPrice, r.closingPrice, r.weightedAveragePrice, len(r.prices)) for r in df.collect()]


STEPS = [f"{t} {s}" for t in ("reports", "daily", "closings", "closing_months", "latest") for s in ("written", "committed", "cleaned")]


@pytest.mark.parametrize("steps", [STEPS[i::3] for i in range(3)], ids=lambda s: ", ".join(s))
def test_batches_that_break_off_and_run_again(spark, tmp_path, steps):
    """Whatever step breaks off, readers see each row once, and after another run all is as if nothing had happened."""
    from pumpline.catalog import Breaking

    made = [(str(i), datetime(2024, 1 + i % 3, 1 + i % 5, i % 23, i % 60), f"s{i % 3}", "e5", 1.0 + (i * 7 % 11) / 10) for i in range(40)]
    first, second = (spark.createDataFrame(made[k::2], REPORT) for k in range(2))
    incremental.process(Store(spark, str(tmp_path), 4), first)
    at = Breaking(spark, str(tmp_path), steps, buckets=4)
    while True:
        try:
            incremental.process(at, second)
            break
        except InterruptedError:
            keys = [(r.station, r.fuel, r.day) for r in at.by_day("daily").read().collect()]
            assert len(keys) == len(set(keys)) and at.by_day("reports").read().count() in (20, 40)
    assert not at.steps
    key = lambda x: (x[0], x[1])
    want = sorted(pick_safe(daily.daily_prices(spark.createDataFrame(made, REPORT))), key=key)
    assert sorted(pick_safe(at.by_day("daily").read()), key=key) == want
    days = at.by_month_and_bucket("closings").read().collect()
    assert sorted((r.station, str(r.day), r.closingPrice) for r in days) == [(s, d, c) for s, d, _, c, _, _ in want]
    at.by_day("daily").vacuum()
    assert sorted(pick_safe(at.by_day("daily").read()), key=key) == want


def test_files_of_a_batch_do_not_grow_with_stored_days(spark, tmp_path):
    """The index of closing prices: files that are read for the neighbours of a report's day."""
    from pumpline.sources.closings import Closings

    counts = []
    for years in (1, 6):
        store = Store(spark, str(tmp_path / str(years)), 4)
        rows = spark.createDataFrame([("s", "e5", datetime(2010 + y, m, d), y + m / 100 + d / 10000) for y in range(years) for m in (1, 5, 9) for d in (3, 20)], "station string, fuel string, day timestamp_ntz, closingPrice double")
        Closings(store).put(rows)
        keys = spark.createDataFrame([("s", "e5", datetime(2010, 5, 10)), ("s", "e5", datetime(2010, 7, 1)), ("t", "e5", datetime(2010, 5, 1))], "station string, fuel string, day timestamp_ntz")
        around = Closings(store).around(keys)
        counts.append(len(around.inputFiles()))
        found = {str(r.day)[:10]: round(r.openingPrice, 6) for r in daily.opening_as_of(keys.filter("station = 's'"), around).collect()}
        assert found == {"2010-05-10": 0.0503, "2010-07-01": 0.052}
        later = sorted(str(r.day)[:10] for r in around.collect() if r.day > datetime(2010, 7, 1))
        assert later[0] == "2010-09-03"  # the day behind it that opens with its closing price
    assert counts[0] == counts[1]


def test_appended_parts_are_compacted(spark, tmp_path):
    """After many batches a day is held by few writes, and few folders are listed."""
    table = Store(spark, str(tmp_path)).by_day("reports")
    for i in range(20):
        table.append(spark.createDataFrame([(i, datetime(2024, 1, 1 + i % 2))], "id int, day timestamp_ntz"))
        table.compact(4)
    assert table.read().count() == 20 and max(map(len, table.manifest().writes.values())) <= 5
    assert len(list((tmp_path / "reports" / "commits").glob("m*"))) == 2 and len(list((tmp_path / "reports" / "data").glob("w*"))) <= 14
    number = table.manifest().number
    table.append(spark.createDataFrame([(99, datetime(2024, 1, 2))], "id int, day timestamp_ntz"))
    assert table.changed_since(number) == ["2024-01-02"]


def test_of_two_writers_the_later_fails(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    a, rows = store.by_day("t"), spark.createDataFrame([(1, datetime(2024, 1, 1))], "id int, day timestamp_ntz")
    a.append(rows)
    before = a.manifest()
    a.append(rows)
    a.manifest = lambda: before
    with pytest.raises(RuntimeError, match="another writer"):
        a.append(rows)
    assert store.by_day("t").read().count() == 2


def test_merged_rows_move_once(spark, tmp_path, monkeypatch):
    """New rows stand in place of those of their key, the others stay, and rows move once."""
    from pumpline.sources.store import PartTable

    table = Store(spark, str(tmp_path)).by_day("t")
    rows = lambda *made: spark.createDataFrame(made, "k int, v string, day timestamp_ntz")
    one, two = datetime(2024, 1, 1), datetime(2024, 1, 2)
    table.append(rows((1, "a", one), (2, "b", one), (1, "c", two)))
    seen, do = [], PartTable.replace

    def kept(self, made, *args, **named):
        seen.append(made)
        return do(self, made, *args, **named)

    monkeypatch.setattr(PartTable, "replace", kept)
    assert table.merge(rows((2, "new", one), (3, "d", one)), ["2024-01-01"], ["k"]) == ["2024-01-01"]
    assert sorted((r.k, r.v) for r in table.read().collect()) == [(1, "a"), (1, "c"), (2, "new"), (3, "d")]
    assert seen[0]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
