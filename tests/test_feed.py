import pytest

from railweave.catalog import orphan_refs
from railweave.errors import FeedError, LimitError, OverrideError, RulesError
from railweave.operators.calendar import day_offset, day_origin
from railweave.operators.profile import profile
from railweave.operators.stations import apply_overrides
from railweave.pack import closure, digest, read, write
from railweave.planner import solve
from railweave.rules import Include, Rules, Selection, parse_clock, read_rules, read_selection
from railweave.sources.tables import load_feed
from railweave.sources.zipfeed import Archive, Limits
from railweave.synth import feed_zip
from tests.feeds import PIER, pier_zip


def test_pier_feed_and_profile(spark):
    feed = load_feed(spark, pier_zip(folder="gtfs/"))
    assert feed.tables["stops"].count() == 4 and feed.tables["stop_times"].count() == 2
    got = {(r.metric, r.key): r.value for r in profile(feed).collect()}
    assert got["valid_from", ""] == "2027-03-01" and got["valid_to", ""] == "2027-04-10"
    assert got["trips", ""] == "1" and got["hierarchy_depth", ""] == "1" and got["orphan_stops", ""] == "0"
    assert got["trips_by_type", "0"] == "1" and got["files", "transfers.txt"] == "missing"


def test_trips_without_a_running_day(spark):
    # The span of "never" covers the feed's validity, but its only days are taken out.
    feed = load_feed(spark, pier_zip({
        "trips.txt": PIER["trips.txt"] + "P,never,ghost,West Pier\n",
        "stop_times.txt": PIER["stop_times.txt"] + "ghost,14:10:00,14:10:00,east:a,4\nghost,14:22:00,14:22:00,west:a,8\n",
        "calendar.txt": PIER["calendar.txt"] + "never,0,0,0,0,0,0,1,20270307,20270314\n",
        "calendar_dates.txt": "service_id,date,exception_type\nnever,20270307,2\nnever,20270314,2\n",
    }))
    got = {(r.metric, r.key): r.value for r in profile(feed).collect()}
    assert got["trips", ""] == "2" and got["trips_without_service_days", ""] == "1"


def test_orphan_references_of_whole_tables(spark, tmp_path):
    spark.createDataFrame([(1, 1), (1, 2), (9, 2), (10, 7), (10, 8)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1,), (10,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1,), (7,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    assert {r.what: r.n for r in orphan_refs(spark, str(tmp_path)).collect()} == {"unknown order": 1, "unknown part": 3}


def test_values_and_references(spark):
    feed = load_feed(spark, pier_zip({
        "trips.txt": "route_id,service_id,trip_id\nP,daily,run\nX,daily,stray\n",
        "stop_times.txt": "﻿trip_id,arrival_time,departure_time,stop_id,stop_sequence\nrun,24:05:30,24:06:00,west:a,30\nrun, 23:55:00 ,,east:a,10\nrun,,,east:a,20\nlost,08:00:00,08:00:00,east:a,1\nrun,08:00:00,08:00:00,nowhere,40\n",
        "frequencies.txt": "trip_id,start_time,end_time,headway_secs\nrun,06:00:00,07:00:00,1200\n",
    }))
    w = feed.warnings
    assert (w["trips_unknown_route"], w["stop_times_unknown_trip"], w["stop_times_unknown_stop"], w["interpolated"]) == (1, 1, 1, 1)
    assert (w["filled_time"], w["missing_time"], w["trips_without_stop_times"]) == (1, 0, 0)
    rows = {(r.trip_id, r.seq): (r.arrival, r.departure) for r in feed.tables["stop_times"].collect()}
    assert rows["run", 10] == (86100, 86100) and rows["run", 30] == (86730, 86760) and rows["run", 20] == (86415, 86415)
    assert rows["run@06:20:00", 10] == (22800, 22800) and len(rows) == 12


@pytest.mark.parametrize("name,text,where", [
    ("stops.txt", PIER["stops.txt"] + "east,Again,1,1,0,\n", 6),
    ("stops.txt", PIER["stops.txt"] + "far,Far,91,1,0,\n", 6),
    ("stops.txt", PIER["stops.txt"].replace("stop_id,", "id,"), 1),
    ("stop_times.txt", PIER["stop_times.txt"] + "run,8:99:00,,east:a,9\n", 4),
    ("stop_times.txt", PIER["stop_times.txt"] + "run,14:00:00,14:00:00,east:a,8\n", 4),
    ("calendar.txt", PIER["calendar.txt"].replace("daily,1", "daily,2"), 2),
    ("frequencies.txt", "trip_id,start_time,end_time,headway_secs\nrun,07:00:00,06:00:00,60\n", 2),
    ("transfers.txt", "from_stop_id,to_stop_id,transfer_type,min_transfer_time\neast:a,west:a,2,-1\n", 2),
])
def test_errors_name_the_line(spark, name, text, where):
    with pytest.raises(FeedError) as e:
        load_feed(spark, pier_zip({name: text}))
    assert e.value.file == name and e.value.line == where


def test_limits_and_archives():
    data = pier_zip()
    for limits in (Limits(compressed=100), Limits(entries=3), Limits(uncompressed=100), Limits(line=20), Limits(rows=1)):
        with pytest.raises(LimitError):
            a = Archive(data, limits)
            for n in a.members:
                list(a.rows(n))
    with pytest.raises(FeedError):
        Archive(b"not a zip")


def test_days_that_change_their_clock():
    from datetime import date

    d = date.fromisoformat
    assert day_offset(d("2026-10-24"), d("2026-10-25"), "Europe/Berlin") == -90_000
    assert day_offset(d("2026-03-28"), d("2026-03-29"), "Europe/Berlin") == -82_800
    with pytest.raises(FeedError):
        day_origin(d("2011-12-30"), "Pacific/Apia")


def test_rules():
    assert parse_clock("26:00") == 93_600 and parse_clock("4:30:05") == 16_205
    r = read_rules('date = "2026-11-12"\nconnector_modes = ["rail"]\n[min_transfer_s]\nsame_station = 90\n')
    assert r.connector_modes == ("rail",) and r.min_transfer_s.same_station == 90
    with pytest.raises(RulesError) as e:
        Rules(date="x", walking_speed_kmh=0, connector_modes=("boat",), latest_end="04:00").checked()
    assert len(str(e.value).splitlines()) == 4
    for text in ("speed = 1", "[min_transfer_s]\nx = 1"):
        with pytest.raises(RulesError):
            read_rules(text)
    assert read_selection('name = "m"\n[[include]]\nroute_types = [1]\n').include[0].route_types == (1,)


def test_overrides():
    base = [{"id": "P", "name": "P", "members": ["a", "b"]}, {"id": "Q", "name": "Q", "members": ["c"]}, {"id": "R", "name": "R", "members": ["d"]}]
    out = apply_overrides(base, {"split": [{"stops": ["b"], "id": "PB"}], "merge": [{"stations": ["Q", "R"]}], "rename": [{"station": "PB", "name": "New"}]})
    assert [(s["id"], s["name"], s["members"]) for s in out] == [("P", "P", ["a"]), ("PB", "New", ["b"]), ("Q", "Q", ["c", "d"])]
    for bad in ({"split": [{"stops": ["a", "b"]}]}, {"split": [{"stops": ["z"]}]}, {"merge": [{"stations": ["P"]}]}, {"rename": [{"station": "Z", "name": "x"}]}, {"split": [{"stops": ["a", "c"]}]}):
        with pytest.raises(OverrideError):
            apply_overrides(base, bad)


def test_packs(spark, tmp_path):
    feed = load_feed(spark, pier_zip())
    path = f"file://{tmp_path}/pack"
    header = write(feed.tables, path)
    back = read(spark, path)
    assert set(back) == set(feed.tables) and digest(back["stops"]) == header["tables"]["stops"]["sha256"]
    assert digest(feed.tables["stops"].repartition(3)) == digest(feed.tables["stops"])
    trips = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None), ("d", None)], "trip_id string, block_id string")
    linked = spark.createDataFrame([("b", "c")], "trip_id string, next_trip string")
    kept = closure(trips, trips.filter("trip_id = 'a'"), linked)
    assert {r.trip_id for r in kept.collect()} == {"a", "b", "c"}


def test_solve_from_zip_to_verified_tour(spark):
    rules = Rules(date="2026-11-12", earliest_start="06:00", latest_end="12:00", connector_modes=("bus",))
    found = solve(spark, feed_zip(3, 5), rules, Selection("metro", (Include(route_types=(1,)),)), step=3600)
    assert found["violations"] == [] and found["itinerary"]
    assert 0 < found["static_bound"] <= found["profile_bound"] <= found["seconds"]
    assert feed_zip(3, 5) == feed_zip(3, 5)
