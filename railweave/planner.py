"""From the bytes of a feed to a verified tour."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import written
from .functions.names import display_name
from .operators import chains
from .operators.calendar import active_on, service_days
from .operators.network import Network, build
from .operators.selection import select_targets, visit_route_types
from .operators.stations import cluster
from .plans.itinerary import to_itinerary
from .plans.kernel import Bundle, greedy
from .plans.tours import best_run, greedy_jobs, greedy_runs, profile_bound, static_bound
from .rules import Rules, Selection
from .sources.tables import Feed, load_feed
from .verify.verifier import SCHEMA, Context, verify


@dataclass
class Basis:
    feed: Feed
    sha256: str
    stations: DataFrame
    stop_station: DataFrame
    calls: DataFrame  # of all service days of the plan, offset to its date
    trips: DataFrame
    targets: DataFrame
    visit_ranges: list[tuple[int, int]]
    active: DataFrame
    network: Network


def prepare(spark: SparkSession, data: bytes, rules: Rules, selection: Selection) -> Basis:
    """Loads, clusters, selects and builds the network of the plan date."""
    rules.checked()
    feed = load_feed(spark, data)
    t = feed.tables
    stations, stop_station = cluster(t["stops"])
    stations, stop_station = written(stations), written(stop_station)
    routes = t["routes"].withColumn("route", display_name(F.col("route_short_name"), F.col("route_long_name")))
    ranges = visit_route_types(routes, selection)
    trips = written(t["trips"].filter("not is_template").join(routes.select("route_id", "route_type", "route"), "route_id"))
    timetable = t["stop_times"] = written(t["stop_times"])
    latest = timetable.agg(F.max("arrival").alias("m")).first().m or 0
    start, end = rules.window
    days = service_days(date.fromisoformat(rules.date), feed.zone, latest, start, end)
    table = spark.createDataFrame([(d, off) for d, off in days], "date date, offset int")
    active = written(active_on(t["calendar"], t["calendar_dates"], table.select("date")))
    # A handful of service days: each trip runs on those its service does.
    runs = trips.join(active, "service_id").join(F.broadcast(table), "date")
    calls = timetable.join(stop_station.select("stop_id", "station"), "stop_id").join(runs.select(F.col("trip_id"), "date", "offset", "route_id", "route_type"), "trip_id")
    calls = calls.select(F.concat_ws("|", "trip_id", "date").alias("trip_id"), F.col("trip_id").alias("gtfs_id"), F.col("date").alias("service_date"), "offset", "seq", "stop_id", "station", (F.col("arrival") + F.col("offset")).cast("int").alias("arrival"), (F.col("departure") + F.col("offset")).cast("int").alias("departure"), "pickup_type", "drop_off_type", "route_id", "route_type")
    calls = written(calls)
    targets = written(select_targets(calls, routes, stations, selection))
    known = stop_station.select("stop_id", "station")
    moves = t["transfers"].filter("from_route_id is null and to_route_id is null and from_trip_id is null and to_trip_id is null and transfer_type in (2, 3)")
    moves = moves.join(known.select(F.col("stop_id").alias("from_stop_id"), F.col("station").alias("from_station")), "from_stop_id").join(known.select(F.col("stop_id").alias("to_stop_id"), F.col("station").alias("to_station")), "to_stop_id").select("from_station", "to_station", "transfer_type", "min_transfer_time")
    network = build(calls, stations, targets, rules, ranges, transfers=moves)
    network.connections, network.footpaths, network.change_time = (written(x) for x in (network.connections, network.footpaths, network.change_time))
    return Basis(feed, hashlib.sha256(data).hexdigest(), stations, stop_station, calls, trips, targets, ranges, active, network)


def context(spark: SparkSession, b: Basis, rules: Rules | None = None) -> Context:
    """What the verifier checks against: the raw timetable, not the network."""
    t = b.feed.tables
    stops = written(t["stops"].join(b.stop_station, "stop_id").join(b.stations.select("station", "station_id"), "station").select("stop_id", "parent_station", "station_id"))
    per = t["stop_times"].groupBy("trip_id").agg(F.min_by("departure", "seq").alias("first_dep"), F.max_by("arrival", "seq").alias("last_arr"), F.min_by("stop_id", "seq").alias("a"), F.max_by("stop_id", "seq").alias("z"), F.count("*").alias("calls"))
    at = stops.select("stop_id", "station_id")
    per = per.join(at.select(F.col("stop_id").alias("a"), F.col("station_id").alias("first_station")), "a").join(at.select(F.col("stop_id").alias("z"), F.col("station_id").alias("last_station")), "z")
    runs = b.trips.join(per, "trip_id").join(b.active, "service_id").withColumn("service_date", F.col("date"))
    keyed = runs.select(F.concat_ws("|", "trip_id", "date").alias("trip_id"), "service_date", "block_id", "first_dep", "last_arr", "first_station", "last_station", F.col("route_type").isin([r[0] for r in b.visit_ranges]).alias("visits"), "calls")
    moves = t["transfers"].filter("from_trip_id is not null and to_trip_id is not null").join(b.active.select("date").distinct())
    pair = lambda kind: moves.filter(F.col("transfer_type") == kind).select(F.concat_ws("|", "from_trip_id", "date").alias("trip_id"), F.concat_ws("|", "to_trip_id", "date").alias("next_trip"))
    seat = written(chains.continuations(keyed, pair(4), pair(5)).select(F.split("trip_id", "\\|")[0].alias("trip_id"), F.split("next_trip", "\\|")[0].alias("next_trip"), F.split("trip_id", "\\|")[1].cast("date").alias("date")))
    walks = spark.createDataFrame([], "entry int, from string, to string, seconds int, forbid boolean, both boolean")
    targets = sorted(r.station_id for r in b.targets.join(b.stations, "station").select("station_id").collect())
    expected = json.dumps(asdict(rules)) if rules else None
    return Context(b.trips, t["stop_times"], stops, b.stations.select("station_id", "lat", "lon"), b.active, t["transfers"], seat, walks, targets, b.visit_ranges, b.feed.zone, b.sha256, expected)


def solve(spark: SparkSession, data: bytes, rules: Rules, selection: Selection, step: int = 1800, bounds: bool = True) -> dict:
    """The best greedy tour with its bounds; shown only if the verifier agrees.

    Keys: feasible, unserved, runs, seconds, static_bound, profile_bound, itinerary, violations.
    """
    from .operators.network import unserved

    b = prepare(spark, data, rules, selection)
    start, end = rules.window
    missing = [r.station for r in unserved(b.targets, b.network.connections, start, end).collect()]
    if missing:
        return {"feasible": False, "unserved": missing}
    net = Bundle.of(b.network)
    if rules.start != "any":
        starts = [r.station for r in b.stations.filter(F.col("station_id") == rules.start).select("station").collect()]
    else:
        starts = net.targets
    runs = written(greedy_runs(greedy_jobs(spark, starts, list(range(start, end, step))), net))
    best = best_run(runs).first()
    if best is None:
        return {"feasible": False, "unserved": []}
    low = static_bound(b.network, net.targets, best.seconds) if bounds else None
    tight = profile_bound(spark, net, best.seconds) if bounds else None
    if bounds and max(low or 0, tight or 0) > best.seconds:
        raise AssertionError("a bound is over the tour")
    legs = greedy(net, best.start, best.t0)
    names = {r.station: r.station_id for r in b.stations.select("station", "station_id").collect()}
    used = sorted({net.trip_ids[x[1]] for x in legs if x[0] == "ride"})
    rows = b.calls.filter(F.col("trip_id").isin(used)).join(b.trips.select(F.col("trip_id").alias("gtfs_id"), "route", "trip_headsign"), "gtfs_id").orderBy("trip_id", "seq").collect()
    trips, calls = {}, {}
    for r in rows:
        trips[r.trip_id] = (r.gtfs_id, r.service_date.isoformat(), r.offset, r.route, r.trip_headsign or "")
        calls.setdefault(r.trip_id, []).append(r.stop_id)
    feed = {"id": "feed", "sha256": b.sha256, "feed_version": "", "attribution": ""}
    text = to_itinerary(net, legs, rules, names, trips, calls, feed, b.feed.zone, SCHEMA, max(low or 0, tight or 0) or None)
    found, outcome = verify(spark.createDataFrame([("tour", text)], "itinerary_id string, json string"), context(spark, b, rules))
    wrong = [tuple(r) for r in found.collect()]
    same = outcome.first().duration_s == best.seconds
    return {"feasible": True, "unserved": [], "runs": runs.count(), "seconds": best.seconds, "static_bound": low, "profile_bound": tight, "itinerary": text if not wrong and same else None, "violations": wrong}


def lookahead(day: str, n: int = 28) -> list[str]:
    first = date.fromisoformat(day)
    return [(first + timedelta(days=k)).isoformat() for k in range(n)]
