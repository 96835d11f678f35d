"""Batch verification: every rule is a condition over one table of resolved legs.

Legs are exploded once and joined to the trips and calls they name; windows over an
itinerary's legs give the place and clock before each leg.  A leg that cannot be
resolved makes the place unknown for the next one.  The result is a table of
(itinerary_id, leg, code, message), empty for valid itineraries.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import written
from ..functions.clock import parse_clock
from ..functions.geo import haversine
from ..functions.names import in_ranges
from ..operators.chains import decisive_transfers
from ..rules import MODES

SCHEMA = "railweave-itinerary/0"
RULES_DDL = "mode string, selection string, station_overrides string, walks string, date string, earliest_start string, latest_end string, start string, end string, allow_walking boolean, walking_speed_kmh double, walk_detour_factor double, max_walk_m double, connector_modes array<string>, min_transfer_s struct<same_station:int,walk_link:int>, tight_transfer_s int, count_pass_through boolean, stay_aboard_through_terminus boolean"
LEG_DDL = "type string, trip_id string, service_date string, route string, headsign string, board_stop_id string, board_time string, alight_stop_id string, alight_time string, stations array<string>, stay_aboard boolean, from_station string, to_station string, start string, end string, metres double, walking_speed_kmh double, station string"
_colon = lambda ddl: ", ".join(f"{c.split(' ', 1)[0]}: {c.split(' ', 1)[1]}" for c in ddl.split(", "))
ITINERARY_DDL = f"schema string, feed struct<id:string,sha256:string,feed_version:string,attribution:string>, timezone string, date string, rules struct<{_colon(RULES_DDL)}>, targets array<string>, legs array<struct<{_colon(LEG_DDL)}>>, summary struct<first_visit:string,last_visit:string,duration_s:long,stations_visited:long,transfers:long,walk_m:double>, lower_bound_s long, gap double"


@dataclass
class Context:
    """What itineraries are checked against.

    trips(trip_id, service_id, route_id, route_type, is_template, template),
    calls(trip_id, seq, stop_id, arrival, departure, pickup_type, drop_off_type),
    stops(stop_id, parent_station, station_id), stations(station_id, lat, lon),
    active(service_id, date), transfers as in decisive_transfers, in_seat(date,
    trip_id, next_trip), walks(entry, from, to, seconds, forbid, both) by station id.
    """

    trips: DataFrame
    calls: DataFrame
    stops: DataFrame
    stations: DataFrame
    active: DataFrame
    transfers: DataFrame
    in_seat: DataFrame
    walks: DataFrame
    targets: list[str]
    visit_ranges: list[tuple[int, int]]
    zone: str
    feed_sha256: str | None = None
    expected_rules: str | None = None  # JSON
    schema: str = SCHEMA
    extra: dict = field(default_factory=dict)


def _origin(day: Column, zone: str) -> Column:
    """Unix seconds of noon minus twelve hours; null for a day the zone skipped."""
    noon = F.to_timestamp(F.concat(day.cast("string"), F.lit(" 12:00:00")))
    there = F.to_utc_timestamp(noon, zone)
    return F.when(F.from_utc_timestamp(there, zone) == noon, F.unix_timestamp(there) - 43_200)


def _day(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def _rule(code: str, bad: Column, message: Column | str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message")))


def _found(rows: DataFrame, leg: Column, rules: list[Column]) -> DataFrame:
    return rows.select("itinerary_id", leg.cast("int").alias("leg"), F.explode(F.array_compact(F.array(*rules))).alias("v")).select("itinerary_id", "leg", "v.code", "v.message")


def parse(itineraries: DataFrame, ctx: Context) -> DataFrame:
    """itineraries(itinerary_id, json) parsed, with the rules that count as `r`."""
    rows = itineraries.select("itinerary_id", F.from_json("json", ITINERARY_DDL).alias("it")).select("itinerary_id", "it.*")
    expected = F.from_json(F.lit(ctx.expected_rules), RULES_DDL) if ctx.expected_rules else F.col("rules")
    return rows.withColumn("r", expected).withColumn("day", _day(F.col("date"))).withColumn("plan_origin", _origin(F.col("day"), ctx.zone))


def header_rules(rows: DataFrame, ctx: Context) -> DataFrame:
    r = lambda c: F.col(f"r.{c}")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rules = [
        _rule("SCHEMA", ~F.col("schema").eqNullSafe(F.lit(ctx.schema)), f"expected schema {ctx.schema}"),
        _rule("TIMEZONE_MISMATCH", ~F.col("timezone").eqNullSafe(F.lit(ctx.zone)), f"the feed says {ctx.zone}"),
        _rule("BAD_DATE", F.col("day").isNull() | F.col("plan_origin").isNull(), "bad plan date"),
    ]
    if ctx.feed_sha256:
        rules.append(_rule("FEED_MISMATCH", ~F.col("feed.sha256").eqNullSafe(F.lit(ctx.feed_sha256)), "built from another feed"))
    out = _found(rows, F.lit(None), rules)
    more = [
        _rule("RULES_MISMATCH", ~F.to_json("rules").eqNullSafe(F.to_json("r")), "planned under other rules"),
        _rule("BAD_RULES", ~(finite(r("walking_speed_kmh")) & (r("walking_speed_kmh") > 0)), "walking_speed_kmh must be above 0"),
        _rule("BAD_RULES", ~(finite(r("walk_detour_factor")) & (r("walk_detour_factor") >= 1)), "walk_detour_factor must be at least 1"),
        _rule("BAD_RULES", ~(finite(r("max_walk_m")) & (r("max_walk_m") >= 0)), "max_walk_m must be 0 or more"),
        _rule("BAD_RULES", (r("min_transfer_s.same_station") < 1) | (r("min_transfer_s.walk_link") < 1), "minimum transfer times must be at least 1 second"),
        _rule("BAD_RULES", F.exists(r("connector_modes"), lambda m: ~m.isin(list(MODES))), "unknown connector mode"),
    ]
    return out.unionByName(_found(rows.filter("plan_origin is not null"), F.lit(None), more))


def resolved(rows: DataFrame, ctx: Context) -> DataFrame:
    """One row a leg with what it names, and the state before it."""
    legs = rows.filter("plan_origin is not null").select("itinerary_id", "r", "plan_origin", F.posexplode("legs").alias("leg", "l")).select("itinerary_id", "r", "plan_origin", "leg", "l.*")
    legs = legs.withColumn("stay", F.coalesce("stay_aboard", F.lit(False)) & (F.col("type") == "ride")).withColumn("sd", _day(F.col("service_date")))
    legs = legs.withColumn("t0", parse_clock(F.when(F.col("type") == "ride", F.col("board_time")).otherwise(F.col("start")))).withColumn("t1", parse_clock(F.when(F.col("type") == "ride", F.col("alight_time")).otherwise(F.col("end"))))
    trips = ctx.trips.select(F.col("trip_id"), F.lit(True).alias("known_trip"), "service_id", "route_id", "route_type", "is_template", F.coalesce("template", "trip_id").alias("rule_trip"))
    legs = legs.join(trips, "trip_id", "left")
    legs = legs.join(ctx.active.select("service_id", F.col("date").alias("sd"), F.lit(True).alias("runs")).distinct(), ["service_id", "sd"], "left")
    key = ["itinerary_id", "leg"]
    call = ctx.calls.select("trip_id", "seq", "stop_id", "arrival", "departure", "pickup_type", "drop_off_type")
    named = legs.filter("type = 'ride'").select(*key, "trip_id", "board_stop_id", "alight_stop_id", "t0", "t1")
    on = named.join(call, "trip_id").filter((F.col("stop_id") == F.col("board_stop_id")) & (F.col("departure") == F.col("t0")))
    on = on.groupBy(*key).agg(F.min(F.struct("seq", "departure", "pickup_type")).alias("on"))
    off = named.join(on, key).join(call, "trip_id").filter((F.col("stop_id") == F.col("alight_stop_id")) & (F.col("arrival") == F.col("t1")) & (F.col("seq") > F.col("on.seq")))
    off = off.groupBy(*key).agg(F.min(F.struct("seq", "arrival", "drop_off_type")).alias("off"))
    ends = ctx.calls.groupBy("trip_id").agg(F.min("seq").alias("first_seq"), F.max(F.struct("seq", "stop_id", "arrival")).alias("terminus"))
    legs = legs.join(on, key, "left").join(off, key, "left").join(ends, "trip_id", "left")
    at = ctx.stops.select("stop_id", "station_id", F.when(F.col("parent_station") != "", F.col("parent_station")).alias("parent"))
    for side in ("board", "alight"):
        legs = legs.join(at.select(F.col("stop_id").alias(f"{side}_stop_id"), F.col("station_id").alias(f"{side}_station"), F.col("parent").alias(f"{side}_parent")), f"{side}_stop_id", "left")
    for side in ("from", "to"):
        legs = legs.join(ctx.stations.select(F.col("station_id").alias(f"{side}_station"), F.lit(True).alias(f"{side}_known"), F.col("lat").alias(f"{side}_lat"), F.col("lon").alias(f"{side}_lon")), f"{side}_station", "left")
    ride, walk, wait = (F.col("type") == k for k in ("ride", "walk", "wait"))
    legs = legs.withColumn("origin", _origin(F.col("sd"), ctx.zone))
    trouble = (
        F.when(ride & F.col("known_trip").isNull(), "TRIP_UNKNOWN")
        .when(ride & F.col("is_template"), "TRIP_NOT_RUN")
        .when(ride & F.col("sd").isNull(), "BAD_DATE")
        .when(F.col("t0").isNull() | F.col("t1").isNull(), "BAD_TIME")
        .when(ride & F.col("on").isNull(), "BOARD_STOP_NOT_ON_TRIP")
        .when(ride & F.col("off").isNull(), "ALIGHT_STOP_NOT_ON_TRIP")
        .when(ride & F.col("origin").isNull(), "BAD_DATE")
        .when(walk & (F.col("from_known").isNull() | F.col("to_known").isNull()), "UNKNOWN_STATION")
    )
    legs = legs.withColumn("trouble", trouble).withColumn("hard", F.col("trouble").isNotNull() & ~wait)
    base = F.when(ride, F.col("origin")).otherwise(F.col("plan_origin"))
    legs = legs.withColumn("begin", base + F.col("t0")).withColumn("finish", base + F.col("t1"))
    order = Window.partitionBy("itinerary_id").orderBy("leg")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.sum(c.cast("int")).over(past), F.lit(0))
    legs = legs.withColumn("resets", count(F.col("hard"))).withColumn("moves", count(~wait))
    legs = legs.withColumn("next_stays", F.coalesce(F.lead("stay").over(order), F.lit(False)))
    since = Window.partitionBy("itinerary_id", "resets").orderBy("leg").rowsBetween(Window.unboundedPreceding, -1)
    still = Window.partitionBy("itinerary_id", "resets", "moves").orderBy("leg").rowsBetween(Window.unboundedPreceding, -1)
    here = F.struct(F.when(ride, F.col("alight_station")).otherwise(F.col("to_station")).alias("station"), F.col("finish").alias("clock"), F.col("type").alias("kind"))
    rode = F.struct(F.col("alight_stop_id").alias("stop"), F.col("alight_parent").alias("parent"), "trip_id", "rule_trip", "route_id", "service_date", F.col("finish").alias("at"), F.col("terminus"))
    legs = legs.withColumn("p", F.last(F.when(~wait, here), True).over(since)).withColumn("waited", F.max(F.when(wait & F.col("trouble").isNull(), F.col("finish"))).over(still)).withColumn("q", F.last(F.when(ride, rode), True).over(since))
    return legs.withColumn("clock", F.when(F.col("p").isNotNull(), F.greatest(F.col("p.clock"), F.col("waited"))))


def leg_rules(legs: DataFrame, ctx: Context) -> DataFrame:
    ride, walk, wait = (F.col("type") == k for k in ("ride", "walk", "wait"))
    ok = F.col("trouble").isNull()
    there = F.col("p").isNotNull()
    r = lambda c: F.col(f"r.{c}")
    connectors = F.lit(False)
    for m, ranges in MODES.items():
        connectors = connectors | (F.array_contains(r("connector_modes"), m) & in_ranges(F.col("route_type"), list(ranges)))
    allowed = in_ranges(F.col("route_type"), ctx.visit_ranges) | F.coalesce(connectors, F.lit(False))
    resolved_trip = F.col("known_trip") & ~F.col("is_template") & F.col("sd").isNotNull()

    # The transfer row that decides each change of trips.
    off_ride = F.col("p.kind") == "ride"
    same = off_ride & (F.col("q.trip_id") == F.col("trip_id")) & (F.col("q.service_date") == F.col("service_date"))
    continuing = F.col("stay") | F.coalesce(same, F.lit(False))
    change_id = F.concat_ws("\x1f", F.col("itinerary_id").cast("string"), F.col("leg").cast("string"))
    changes = legs.filter(ride & ok & there & F.col("q").isNotNull() & ~continuing).select(change_id.alias("change"), F.col("q.stop").alias("from_stop"), F.col("q.parent").alias("from_parent"), F.col("board_stop_id").alias("to_stop"), F.col("board_parent").alias("to_parent"), F.col("q.route_id").alias("from_route"), F.col("route_id").alias("to_route"), F.col("q.rule_trip").alias("from_trip"), F.col("rule_trip").alias("to_trip"))
    decided = decisive_transfers(changes, ctx.transfers).select("change", F.col("transfer_type").alias("kind"), F.col("min_transfer_time").alias("least"))
    legs = legs.withColumn("change", change_id).join(decided, "change", "left")
    own = F.when(off_ride, r("min_transfer_s.same_station")).otherwise(0)
    need = F.when(F.col("kind") == 2, F.greatest(own, F.col("least"))).otherwise(own)
    changing = ride & ok & there & F.col("q").isNotNull() & ~continuing

    seat = ctx.in_seat.select(F.col("trip_id").alias("seat_from"), F.col("next_trip").alias("seat_to"), F.col("date").alias("seat_date"), F.lit(True).alias("seated")).distinct()
    legs = legs.join(seat, (F.col("q.trip_id") == F.col("seat_from")) & (F.col("trip_id") == F.col("seat_to")) & (F.col("sd") == F.col("seat_date")), "left")
    goes_on = (F.col("on.seq") == F.col("first_seq")) & off_ride & (F.col("q.stop") == F.col("q.terminus.stop_id")) & (F.col("q.service_date") == F.col("service_date")) & (F.col("clock") == F.col("origin") + F.col("q.terminus.arrival")) & F.col("seated")

    metres = haversine(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon"))
    w = ctx.walks.select("entry", F.col("from").alias("from_station"), F.col("to").alias("to_station"), "seconds", "forbid", "both")
    each = w.drop("both").unionByName(w.filter("both").select("entry", F.col("to_station").alias("from_station"), F.col("from_station").alias("to_station"), "seconds", "forbid"))
    last = each.groupBy("from_station", "to_station").agg(F.max_by(F.struct("seconds", "forbid"), "entry").alias("measured"))
    legs = legs.join(last, ["from_station", "to_station"], "left").withColumn("metres_apart", metres)
    estimate = F.ceil(F.try_divide(F.col("metres_apart") * r("walk_detour_factor"), r("walking_speed_kmh") / 3.6))
    walk_need = F.greatest(F.coalesce(F.col("measured.seconds").cast("long"), estimate), r("min_transfer_s.walk_link").cast("long"))
    walked = walk & ok

    claimed = F.filter("stations", lambda x, i: (i == 0) | (x != F.get("stations", i - 1)))
    seen = _stations_seen(legs, ctx)
    legs = legs.join(seen, ["itinerary_id", "leg"], "left")
    actual = F.coalesce(F.col("seen"), F.array().cast("array<string>"))
    begin_place = F.when(ride, F.col("board_station")).when(walk, F.col("from_station")).otherwise(F.col("station"))
    usable = ok & there
    rules = [
        _rule("WALK_NOT_ALLOWED", walk & ~r("allow_walking"), "the rules do not allow walking"),
        F.when(F.col("trouble").isNotNull(), F.struct(F.col("trouble").alias("code"), F.concat(F.lit("the leg cannot be resolved: "), F.coalesce("trip_id", "from_station", "station")).alias("message"))),
        _rule("SERVICE_NOT_RUNNING", ride & resolved_trip & F.col("runs").isNull(), "the trip does not run that day"),
        _rule("MODE_NOT_ALLOWED", ride & resolved_trip & ~allowed, "the rules do not allow this route type"),
        _rule("PICKUP_NOT_ALLOWED", ride & F.col("off").isNotNull() & ok & ~F.col("stay") & (F.col("on.pickup_type") == 1), "no pickup there"),
        _rule("DROP_OFF_NOT_ALLOWED", ride & ok & ~F.col("next_stays") & (F.col("off.drop_off_type") == 1), "no drop-off there"),
        _rule("NOT_CONTIGUOUS", usable & (F.col("p.station") != begin_place), "starts elsewhere than the leg before ends"),
        _rule("TIME_TRAVEL", usable & (F.col("begin") < F.col("clock")), "starts before the leg before ends"),
        _rule("TIME_TRAVEL", wait & ok & (F.col("finish") < F.col("begin")), "ends before it starts"),
        _rule("FORBIDDEN_TRANSFER", changing & (F.col("kind") == 3), "transfers.txt forbids this change"),
        _rule("TRANSFER_TOO_SHORT", changing & (F.col("begin") < F.col("q.at") + need), F.concat(F.lit("needs seconds: "), need.cast("string"))),
        _rule("STAY_ABOARD_NOT_ALLOWED", ok & F.col("stay") & ~r("stay_aboard_through_terminus"), "the rules do not allow staying aboard"),
        _rule("NOT_A_CONTINUATION", ok & F.col("stay") & ~F.coalesce(goes_on, F.lit(False)), "the trip does not continue the one before"),
        _rule("STATIONS_MISMATCH", ride & ok & (F.size("stations") > 0) & (claimed != actual), "the trip visits other stations"),
        _rule("WALK_SAME_STATION", walked & (F.col("from_station") == F.col("to_station")), "a walk from a station to itself"),
        _rule("WALK_CHAINED", walked & (F.col("p.kind") == "walk"), "two walks in a row"),
        _rule("WALK_UNMEASURABLE", walked & F.col("metres_apart").isNull(), "no coordinates"),
        _rule("WALK_TOO_LONG", walked & (F.col("metres_apart") > r("max_walk_m") + 0.5), "over the limit"),
        _rule("WALK_FORBIDDEN", walked & F.col("measured.forbid"), "the walks file forbids it"),
        _rule("WALK_TOO_FAST", walked & F.col("metres_apart").isNotNull() & (F.col("finish") - F.col("begin") < walk_need), F.concat(F.lit("needs seconds: "), walk_need.cast("string"))),
    ]
    return _found(legs, F.col("leg"), rules)


def _visited_calls(legs: DataFrame, ctx: Context) -> DataFrame:
    """Calls that a ride visits: (itinerary_id, leg, seq, station_id, at)."""
    rides = legs.filter((F.col("type") == "ride") & F.col("trouble").isNull()).filter(in_ranges(F.col("route_type"), ctx.visit_ranges)).select("itinerary_id", "leg", "trip_id", "origin", F.col("on.seq").alias("a"), F.col("off.seq").alias("b"), F.col("r.count_pass_through").alias("passing"))
    calls = rides.join(ctx.calls, "trip_id").filter(F.col("seq").between(F.col("a"), F.col("b")))
    calls = calls.filter(~((F.col("pickup_type") == 1) & (F.col("drop_off_type") == 1)) | F.col("passing"))
    at = F.col("origin") + F.when(F.col("seq") == F.col("a"), F.col("departure")).otherwise(F.col("arrival"))
    return calls.join(ctx.stops.select("stop_id", "station_id"), "stop_id").select("itinerary_id", "leg", "seq", "station_id", at.alias("at"))


def _stations_seen(legs: DataFrame, ctx: Context) -> DataFrame:
    rows = _visited_calls(legs, ctx).groupBy("itinerary_id", "leg").agg(F.array_sort(F.collect_list(F.struct("seq", "station_id"))).alias("c"))
    rows = rows.select("itinerary_id", "leg", F.col("c.station_id").alias("s"))
    return rows.select("itinerary_id", "leg", F.filter("s", lambda x, i: (i == 0) | (x != F.get("s", i - 1))).alias("seen"))


def final_rules(rows: DataFrame, legs: DataFrame, ctx: Context) -> tuple[DataFrame, DataFrame]:
    """(violations, outcome): targets, window, ends and summary; outcome(itinerary_id, duration_s, stations_visited)."""
    spark = rows.sparkSession
    first = _visited_calls(legs, ctx).groupBy("itinerary_id", "station_id").agg(F.min("at").alias("at"))
    targets = spark.createDataFrame([(t,) for t in ctx.targets], "station_id string")
    heads = rows.filter("plan_origin is not null").select("itinerary_id", "r", "plan_origin", "targets", "summary")
    # The selection is one short list, so every itinerary meets it whole.
    want = heads.select("itinerary_id").crossJoin(F.broadcast(targets)).join(first, ["itinerary_id", "station_id"], "left")
    missing = want.filter("at is null").select("itinerary_id", F.lit(None).cast("int").alias("leg"), F.lit("MISSING_TARGET").alias("code"), F.concat(F.lit("never visited: "), "station_id").alias("message"))
    ends = want.groupBy("itinerary_id").agg(F.count_if(F.col("at").isNull()).alias("left"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.collect_list(F.struct("station_id", "at")).alias("all"))
    visited = first.groupBy("itinerary_id").agg(F.count("*").alias("stations_visited"))
    done = heads.join(ends, "itinerary_id", "left").join(visited, "itinerary_id", "left")
    complete = (F.col("left") == 0) & F.col("lo").isNotNull()
    ws, we = parse_clock(F.col("r.earliest_start")), parse_clock(F.col("r.latest_end"))
    among = lambda t, s: F.exists("all", lambda x: (x["at"] == F.col(t)) & (x["station_id"] == F.col(s)))
    rules = [
        _rule("TARGETS_MISMATCH", (F.size("targets") > 0) & (F.array_sort("targets") != F.lit(sorted(ctx.targets))), "another target list than the selection"),
        _rule("OUTSIDE_WINDOW", complete & (F.col("lo") < F.col("plan_origin") + ws), "the first visit is before earliest_start"),
        _rule("OUTSIDE_WINDOW", complete & (F.col("hi") > F.col("plan_origin") + we), "the last visit is after latest_end"),
        _rule("BAD_RULES", complete & (ws.isNull() | we.isNull()), "unreadable earliest_start or latest_end"),
        _rule("START_MISMATCH", complete & (F.col("r.start") != "any") & ~among("lo", "r.start"), "the first visit is elsewhere"),
        _rule("END_MISMATCH", complete & (F.col("r.end") != "any") & ~among("hi", "r.end"), "the last visit is elsewhere"),
        _rule("SUMMARY_MISMATCH", complete & ~(F.col("hi") - F.col("lo")).eqNullSafe(F.col("summary.duration_s")), "the legs give another duration"),
    ]
    outcome = done.select("itinerary_id", F.when(complete, F.col("hi") - F.col("lo")).alias("duration_s"), F.coalesce("stations_visited", F.lit(0)).alias("stations_visited"))
    return missing.unionByName(_found(done, F.lit(None), rules)), outcome


def verify(itineraries: DataFrame, ctx: Context) -> tuple[DataFrame, DataFrame]:
    """(violations, outcome) of itineraries(itinerary_id, json).

    Under a zone that nobody knows, no time can be read: each itinerary gets that one code.
    """
    try:
        ZoneInfo(ctx.zone)
    except (ZoneInfoNotFoundError, ValueError):
        none = F.lit(None)
        stopped = itineraries.select("itinerary_id", none.cast("int").alias("leg"), F.lit("FEED_TIMEZONE").alias("code"), F.lit(f"no such time zone: {ctx.zone}").alias("message"))
        return stopped, itineraries.select("itinerary_id", none.cast("long").alias("duration_s"), F.lit(0).cast("long").alias("stations_visited"))
    rows = parse(itineraries, ctx)
    legs = written(resolved(rows, ctx))
    ends, outcome = final_rules(rows, legs, ctx)
    return header_rules(rows, ctx).unionByName(leg_rules(legs, ctx)).unionByName(ends), outcome
