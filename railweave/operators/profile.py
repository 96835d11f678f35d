"""What a feed holds: counts, ranges and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import is_dhid
from ..sources.tables import Feed
from .calendar import active_on, validity
from .network import backwards_trips
from .stations import parent_roots

#: FIXED VALUES: names of location types.
LOCATIONS = {0: "platform", 1: "station", 2: "entrance", 3: "node", 4: "boarding area"}
OPTIONAL = ("feed_info.txt", "calendar.txt", "calendar_dates.txt", "frequencies.txt", "transfers.txt")


def duplicate_trips(trips: DataFrame, calls: DataFrame) -> DataFrame:
    """(route_id, service_id, n): surplus trips that call everywhere at the same times."""
    pattern = calls.groupBy("trip_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("seq", "stop_id", "arrival", "departure")))), 256).alias("pattern"))
    return trips.join(pattern, "trip_id").groupBy("route_id", "service_id", "pattern").agg((F.count("*") - 1).alias("n")).filter("n > 0").select("route_id", "service_id", "n")


def orphan_stops(stops: DataFrame, calls: DataFrame) -> DataFrame:
    """Platforms and stations under which nothing is served."""
    roots = parent_roots(stops)
    served = calls.select("stop_id").distinct()
    used = served.union(served.join(roots, "stop_id").select("root")).union(served.join(stops.filter("parent_station <> ''"), "stop_id").select("parent_station")).distinct()
    return stops.filter("location_type in (0, 1)").join(used, "stop_id", "left_anti").select("stop_id")


def idle_trips(trips: DataFrame, feed: Feed) -> DataFrame:
    """Trips whose service runs on no day of the feed's validity."""
    calendar, exceptions = feed.tables["calendar"], feed.tables["calendar_dates"]
    valid = validity(calendar, exceptions, feed.tables["feed_info"])
    days = valid.filter("start <= end").select(F.explode(F.sequence("start", "end")).alias("date"))
    return trips.join(active_on(calendar, exceptions, days).select("service_id").distinct(), "service_id", "left_anti").select("trip_id")


def profile(feed: Feed) -> DataFrame:
    """(metric, key, value) rows of a feed's profile."""
    t = feed.tables
    spark = t["stops"].sparkSession
    trips, calls, stops = t["trips"].filter("not is_template"), t["stop_times"], t["stops"]
    one = lambda df, metric, expr: df.agg(expr.alias("v")).select(F.lit(metric).alias("metric"), F.lit("").alias("key"), F.col("v").cast("string").alias("value"))
    by = lambda df, metric, key: df.groupBy(key.cast("string").alias("key")).agg(F.count("*").cast("string").alias("value")).select(F.lit(metric).alias("metric"), "key", "value")
    n = F.count("*")
    location = F.create_map(*(F.lit(x) for k, v in LOCATIONS.items() for x in (k, v)))
    by_route = trips.join(t["routes"].select("route_id", "route_type"), "route_id")
    valid = validity(t["calendar"], t["calendar_dates"], t["feed_info"])
    parts = [
        one(t["agency"], "agencies", n),
        by(t["routes"], "routes_by_type", F.col("route_type")),
        by(by_route, "trips_by_type", F.col("route_type")),
        by(stops, "stops_by_location_type", location[F.col("location_type")]),
        one(stops, "stops_with_parent", F.count_if(F.col("parent_station") != "")),
        one(parent_roots(stops), "hierarchy_depth", F.max("depth")),
        one(stops, "dhid_share", F.round(F.avg(is_dhid(F.col("stop_id")).cast("double")), 4)),
        stops.filter("parent_station <> ''").orderBy("stop_idx").limit(3).select(F.lit("platform_examples").alias("metric"), F.col("stop_id").alias("key"), F.col("parent_station").alias("value")),
        one(trips, "trips", n),
        one(calls, "stop_times", n),
        one(trips, "services", F.countDistinct("service_id")),
        one(calls.groupBy("trip_id").agg(F.max("arrival").alias("m")), "trips_past_midnight", F.count_if(F.col("m") >= 86_400)),
        one(calls, "latest_time", F.max(F.greatest("arrival", "departure"))),
        one(t["frequencies"], "frequency_rows", n),
        one(t["frequencies"], "frequency_templates", F.countDistinct("trip_id")),
        one(t["frequencies"], "frequency_runs", F.coalesce(F.sum(F.ceil((F.col("end") - F.col("start")) / F.col("headway"))), F.lit(0))),
        one(t["frequencies"], "frequency_exact", F.count_if(F.col("exact_times") == "1")),
        one(t["transfers"], "transfers", n),
        by(calls, "pickup_drop_off", F.concat_ws("/", "pickup_type", "drop_off_type")),
        one(valid, "valid_from", F.first("start")),
        one(valid, "valid_to", F.first("end")),
        one(orphan_stops(stops, calls), "orphan_stops", n),
        one(idle_trips(trips, feed), "trips_without_service_days", n),
        one(backwards_trips(calls), "trips_non_monotonic", n),
        one(duplicate_trips(trips, calls), "duplicate_trips", F.coalesce(F.sum("n"), F.lit(0))),
        one(stops, "stops_without_coordinates", F.count_if(F.col("stop_lat").isNull() | F.col("stop_lon").isNull())),
        spark.createDataFrame([("warnings", k, str(v)) for k, v in sorted(feed.warnings.items())], "metric string, key string, value string"),
        spark.createDataFrame([("files", f, "empty" if f in feed.empty else "present") for f in feed.files] + [("files", f, "missing") for f in OPTIONAL if f not in feed.files], "metric string, key string, value string"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
