"""Files, merges, the store, and the batch commands."""

from datetime import datetime

import pytest

from pumpline import schemas
from pumpline.operators import stations
from pumpline.plans import imports
from pumpline.sources import csv
from pumpline.sources.store import ImportResult, Store, assert_unique, keep_existing, merge_fields, replace_matching, upsert_stations

A, B = "AAAAAAAA-0000-4000-8000-00000000000A", "BBBBBBBB-0000-4000-8000-00000000000B"
REPORTS = f"""date,station_uuid,diesel,e5,e10,dieselchange,e5change,e10change
2024-02-19 04:10:11+01,{A},1.569,-0.001,0.499,1,1,1
2024-02-19 07:10:11+01,{A},1.629,1.7,,1,0,1
2024-02-20 07:10:11,{A},1.529,1.701,abc,1,2,1
2024-02-20 07:10:11,{B},0.5,0.5,0.5,1,1,1
"""
STATIONS = f"""uuid,name,brand,street,house_number,post_code,city,latitude,longitude
{A},NORTH PUMPS,North,MILL LANE,7,54321,RIVERTON,51.25,7.5
{B},other,O,x,2,10179,y,91,0
"""


@pytest.fixture
def files(tmp_path):
    (tmp_path / "reports" / "deep").mkdir(parents=True)
    (tmp_path / "reports" / "deep" / "a.csv").write_text(REPORTS)
    (tmp_path / "reports" / "b.csv").write_text("dieselchange,diesel,date,station_uuid,e5,e5change\n0,1.111,2024-02-20 08:00:00,C,1.7,1\n")
    (tmp_path / "reports" / "empty.csv").write_text("")
    (tmp_path / "reports" / "note.txt").write_text("no csv")
    (tmp_path / "stations.csv").write_text(STATIONS)
    return tmp_path


def test_reports(spark, files):
    rows = csv.read_reports(spark, str(files / "reports")).collect()
    got = sorted((r.station, r.fuel, r.date, r.price) for r in rows)
    a, b = A.lower(), B.lower()
    assert got == sorted([
        (a, "diesel", datetime(2024, 2, 19, 3, 10, 11), 1.569),
        (a, "diesel", datetime(2024, 2, 19, 6, 10, 11), 1.629),
        (a, "diesel", datetime(2024, 2, 20, 7, 10, 11), 1.529),
        ("c", "e5", datetime(2024, 2, 20, 8), 1.7),  # another file, with its columns in another order
        *[(b, f, datetime(2024, 2, 20, 7, 10, 11), 0.5) for f in schemas.FUELS],
    ])


@pytest.mark.parametrize("line", ["x", "x,y,z"])
def test_rows_of_another_length_than_their_header_fail(spark, tmp_path, line):
    (tmp_path / "a.csv").write_text(f"date,station_uuid\n{line}\n")
    for schema in ("date string, station_uuid string", "date string"):
        with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
            csv.read_csv(spark, str(tmp_path), schema).collect()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_fields(spark, tmp_path, end):
    """Commas, doubled quotes and line breaks in quotes; a header in quotes; a malformed row between them."""
    rows = ['"name","street, part",city', '"The ""Best"" Stop",Mill Lane,x', '"Two', 'Lines",, y ', 'a,b,"c,""d"""', "short,row", "last,one,z"]
    (tmp_path / "a.csv").write_text(end.join(rows) + end)
    (tmp_path / "b.csv").write_text("name,city\nplain,here\n")
    (tmp_path / "c d.csv").write_text('city,name\n"one\ntwo",n\n')
    schema = "name string, `street, part` string, city string".replace("`street, part`", "street")
    got = csv.read_csv(spark, str(tmp_path), schema, quarantine=True).collect()
    good = sorted((r.name, r.city) for r in got if r.bad is None)
    assert good == sorted([('The "Best" Stop', "x"), (f"Two{chr(10)}Lines", " y "), ("a", 'c,"d"'), ("last", "z"), ("plain", "here"), ("n", "one\ntwo")])
    assert [(r.bad, r.name, r.file.rsplit("/", 1)[1]) for r in got if r.bad is not None] == [("short,row", None, "a.csv")]
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        csv.read_csv(spark, str(tmp_path), schema).collect()


def test_results_of_files(spark, files):
    """Malformed rows go to the quarantine, with their file; results by file."""
    store = Store(spark, str(files / "store"), buckets=4)
    (files / "reports" / "bad.csv").write_text(REPORTS.splitlines()[0] + f'\n2024-02-25 09:00:00,{A},1.4,9.9,9.9,1,0,0\ntoo,"few"\n1,2,3,4,5,6,7,8,9\n')
    imports.import_stations(spark, store, str(files / "stations.csv"))
    assert imports.import_reports(spark, store, str(files / "reports")) == ImportResult(7, 1, 0, 2)
    name = lambda r: r.file.rsplit("/", 1)[1]
    results = {name(r): (r.inserted, r.skipped, r.failed) for r in store.by_day("import_results").read().collect()}
    assert results == {"a.csv": (6, 0, 0), "b.csv": (0, 1, 0), "bad.csv": (1, 0, 2)}
    assert sorted((name(r), r.bad, r.kind) for r in store.by_day("quarantine").read().collect()) == [("bad.csv", "1,2,3,4,5,6,7,8,9", "reports"), ("bad.csv", 'too,"few"', "reports")]


def test_stations_that_are_there_several_times(spark, files):
    """The last row of the last file counts."""
    for name, text in (("x1.csv", "first"), ("x2.csv", "second")):
        (files / name).write_text(STATIONS + f"{A},{text},N,s,1,1,c,1,1\n")
    store = Store(spark, str(files / "store"))
    imports.import_stations(spark, store, [str(files / "x1.csv"), str(files / "x2.csv")])
    assert {r.id: r.name for r in store.read("stations").collect()}[A.lower()] == "Second"


def test_no_files(spark, tmp_path):
    assert csv.read_csv(spark, str(tmp_path), "date string").count() == 0


def test_times_do_not_depend_on_the_zone_of_the_session(spark, files):
    want = sorted((r.station, r.fuel, r.date) for r in csv.read_reports(spark, str(files / "reports")).collect())
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sorted((r.station, r.fuel, r.date) for r in csv.read_reports(spark, str(files / "reports")).collect()) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_stations(spark, files):
    rows = {r.id: r for r in csv.read_stations(spark, str(files / "stations.csv")).collect()}
    assert rows[A.lower()].name == "North Pumps" and rows[A.lower()].location.coordinates == [7.5, 51.25]
    assert rows[B.lower()].location is None


def test_commands(spark, files):
    store = Store(spark, str(files / "store"))
    assert imports.import_stations(spark, store, str(files / "stations.csv")) == ImportResult(2, 0)
    assert imports.import_stations(spark, store, str(files / "stations.csv")) == ImportResult(0, 2)
    assert imports.import_reports(spark, store, str(files / "reports")) == ImportResult(6, 1)
    rows = {(r.station.id, r.fuel, r.day.day): r for r in store.by_day("daily").read().collect()}
    second = rows[A.lower(), "diesel", 20]
    assert (second.openingPrice, second.prices[0].previousPrice) == (1.629, 1.629)
    assert rows[A.lower(), "diesel", 19].openingPrice is None
    assert store.by_day("aggregates").read().count() == 4
    latest = {r.id: r for r in store.read("stations").collect()}
    assert latest[A.lower()].latestPrice["diesel"].closingPrice == 1.529 and len(latest[A.lower()].latestPrices["diesel"]) == 2
    # what is there stays, and a later import's opening price comes from it
    (files / "more.csv").write_text(REPORTS.splitlines()[0] + f"\n2024-02-20 09:00:00,{A},9.9,9.9,9.9,1,0,0\n2024-02-22 09:00:00,{A},1.4,9.9,9.9,1,0,0\n")
    assert imports.import_reports(spark, store, str(files / "more.csv")) == ImportResult(1, 1)
    rows = {(r.station.id, r.fuel, r.day.day): r for r in store.by_day("daily").read().collect()}
    assert rows[A.lower(), "diesel", 20].closingPrice == 1.529 and rows[A.lower(), "diesel", 22].openingPrice == 1.529
    assert store.names("staged") == []
    imports.repair_openings(store)
    imports.import_reports(spark, store, clear=True)
    assert store.by_day("daily").read().count() == 0


def test_latest_lists_follow_changed_days(spark, files):
    """After several imports the lists equal those that are made from all daily rows; only touched buckets are written."""
    from pumpline.operators import latest

    store = Store(spark, str(files / "store"), 4)
    imports.import_stations(spark, store, str(files / "stations.csv"))
    imports.import_reports(spark, store, str(files / "reports"))
    before = store.by_bucket("latest", "id").manifest()
    (files / "late.csv").write_text(REPORTS.splitlines()[0] + f"\n2024-02-18 09:00:00,{A},1.9,9.9,9.9,1,0,0\n2024-02-25 09:00:00,{A},1.4,9.9,9.9,1,0,0\n")
    imports.import_reports(spark, store, str(files / "late.csv"))
    shown = lambda df: {r.id: {f: [(str(x.day), x.closingPrice, len(x.prices)) for x in v] for f, v in r.latestPrices.items()} for r in df.collect() if r.latestPrices}
    kept, whole = store.by_bucket("latest", "id"), latest.per_station(store.by_day("daily").read().drop("station_id"))
    assert shown(kept.read()) == shown(whole) == shown(store.read("stations"))
    assert len(shown(whole)[A.lower()]["diesel"]) == 4 and len([p for p, w in kept.manifest().writes.items() if before.writes.get(p) != w]) == 1
    assert imports.keep_latest(store) == []


def test_an_import_of_no_rows(spark, files):
    store = Store(spark, str(files / "store"), 4)
    (files / "none").mkdir()
    imports.import_stations(spark, store, str(files / "stations.csv"))
    assert imports.import_reports(spark, store, str(files / "none")) == ImportResult()
    assert imports.import_reports(spark, store, str(files / "reports" / "empty.csv")) == ImportResult()


def test_recovery(spark, files):
    store = Store(spark, str(files / "store"))
    imports.import_stations(spark, store, str(files / "stations.csv"))
    store.write("staged_reports", csv.read_reports(spark, str(files / "reports")))
    assert imports.import_reports(spark, store, recover=True) == ImportResult(6, 1)


def test_an_import_that_breaks_off_behind_its_append(spark, files):
    """Recovered, its days are there once, and later imports find their closing prices."""
    from pumpline.catalog import Breaking

    store = Store(spark, str(files / "store"), 4)
    imports.import_stations(spark, store, str(files / "stations.csv"))
    broken = Breaking(spark, str(files / "store"), ["daily committed"], 4)
    with pytest.raises(InterruptedError):
        imports.import_reports(spark, broken, str(files / "reports"))
    assert imports.import_reports(spark, store, recover=True) == ImportResult(0, 7) and store.by_day("daily").read().count() == 5
    (files / "more.csv").write_text(REPORTS.splitlines()[0] + f"\n2024-04-22 09:00:00,{A},1.4,9.9,9.9,1,0,0\n")
    imports.import_reports(spark, store, str(files / "more.csv"))
    assert store.by_day("daily").read(["2024-04-22"]).first().openingPrice == 1.529


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k int, x string, y int")
    new = spark.createDataFrame([(2, "c", None), (3, "d", 7)], "k int, x string, y int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(keep_existing(old, new, ["k"])) == [(1, "a", None), (2, "b", 5), (3, "d", 7)]
    assert {r[:2] for r in rows(replace_matching(old, new, ["k"]))} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in merge_fields(old, new, ["k"]).collect()} == {(1, "a", None), (2, "c", 5), (3, "d", 7)}
    with pytest.raises(ValueError):
        assert_unique(old.union(old), ["k"])
    stations_ = spark.createDataFrame([("i", "n", True)], "id string, name string, favorite boolean")
    again = spark.createDataFrame([("i", "m", False)], "id string, name string, favorite boolean")
    assert rows(upsert_stations(stations_, again)) == [("i", "m", True)]
    assert rows(upsert_stations(stations_, again, strict=True)) == [("i", "m", False)]


def test_aggregates_follow_changed_days(spark, files):
    """After a late import, only its days are aggregated again; all equal the full recomputation."""
    store = Store(spark, str(files / "store"), buckets=4)
    imports.import_stations(spark, store, str(files / "stations.csv"))
    imports.import_reports(spark, store, str(files / "reports"))
    table = store.by_day("aggregates")
    assert imports.keep_aggregates(store) == [] and table.parts() == ["2024-02-19", "2024-02-20"]
    before = table.manifest()
    (files / "late.csv").write_text(REPORTS.splitlines()[0] + f"\n2024-02-20 09:00:00,{B},9.9,9.9,9.9,1,0,0\n2024-02-22 09:00:00,{A},1.4,9.9,9.9,1,0,0\n")
    imports.import_reports(spark, store, str(files / "late.csv"))
    after = table.manifest()
    assert {p for p, w in after.writes.items() if before.writes.get(p) != w} == {"2024-02-22"}  # of the 20th, B's row was there
    kept = sorted(map(str, table.read().collect()))
    imports.recompute_aggregates(store)
    assert sorted(map(str, table.read().collect())) == kept and len(kept) == 5
    # a run that broke off before its aggregates is made up for
    store.by_day("daily").replace(store.by_day("daily").read(["2024-02-22"]).limit(0), of=["2024-02-22"])
    imports.keep_aggregates(store)
    assert table.parts() == ["2024-02-19", "2024-02-20"]


def test_pages(spark):
    rows = spark.createDataFrame([(f"{i:02}",) for i in range(30)], "id string")
    assert [r.id for r in stations.page(rows, 2).collect()] == [f"{i:02}" for i in range(24, 30)]
    assert stations.page(rows, 3).count() == 0 and stations.page_count(rows) == 2 and stations.page_count(rows.limit(0)) == 0
    assert stations.links(5, 9, 1) == [1, None, 4, 5, 6, None, 9]
    with pytest.raises(ValueError):
        stations.page(rows, 0)


def test_lists_of_an_import_move_once(spark, files, monkeypatch):
    """Days are dealt by lists and opening prices alone, and the lists of latest rows take one exchange for stored and new rows."""
    from pumpline.sources.store import PartTable

    seen = {}
    for step in ("append", "replace"):
        def kept(table, rows, *args, _do=getattr(PartTable, step), **named):
            seen[table.name] = rows
            return _do(table, rows, *args, **named)

        monkeypatch.setattr(PartTable, step, kept)
    store = Store(spark, str(files / "store"), 4)
    imports.import_stations(spark, store, str(files / "stations.csv"))
    for text in ("2024-02-19 09:00:00", "2024-02-22 09:00:00"):
        (files / "one.csv").write_text(REPORTS.splitlines()[0] + f"\n{text},{A},1.4,9.9,9.9,1,0,0\n")
        assert imports.import_reports(spark, store, str(files / "one.csv")).inserted == 1
    assert not {"lowestPrice", "highestPrice", "weightedAveragePrice", "id"} & set(seen["daily"].columns)
    assert seen["latest"]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert store.by_bucket("latest", "id").read().columns == ["id", "latestPrices"]  # the latest row is the list's first
    last = store.read("stations").filter(f"id = '{A.lower()}'").first()
    assert [x.day.day for x in last.latestPrices["diesel"]] == [22, 19] and last.latestPrice["diesel"] == last.latestPrices["diesel"][0]
    assert last.latestPrice["diesel"].openingPrice == 1.4 and len(last.latestPrice["diesel"].id) == 32
