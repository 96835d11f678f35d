"""The tables of a feed as DataFrames, checked and completed."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import FeedError, LimitError
from ..functions.clock import format_time, parse_date, parse_time
from .zipfeed import Archive, Limits

#: FIXED VALUES: columns that are read (those marked * must be there).
COLUMNS = {
    "feed_info.txt": "feed_publisher_name feed_publisher_url feed_lang feed_start_date feed_end_date feed_version",
    "agency.txt": "agency_id agency_name* agency_url agency_timezone*",
    "stops.txt": "stop_id* stop_code stop_name stop_lat stop_lon location_type parent_station platform_code",
    "routes.txt": "route_id* agency_id route_short_name route_long_name route_type*",
    "trips.txt": "route_id* service_id* trip_id* trip_headsign trip_short_name direction_id block_id shape_id",
    "calendar.txt": "service_id* monday* tuesday* wednesday* thursday* friday* saturday* sunday* start_date* end_date*",
    "calendar_dates.txt": "service_id* date* exception_type*",
    "stop_times.txt": "trip_id* arrival_time departure_time stop_id* stop_sequence* pickup_type drop_off_type shape_dist_traveled",
    "frequencies.txt": "trip_id* start_time* end_time* headway_secs* exact_times",
    "transfers.txt": "from_stop_id to_stop_id from_route_id to_route_id from_trip_id to_trip_id transfer_type* min_transfer_time",
}
REQUIRED = ("agency.txt", "stops.txt", "routes.txt", "trips.txt", "stop_times.txt")
CHUNK = 200_000


@dataclass
class Feed:
    tables: dict[str, DataFrame]
    warnings: dict[str, int]
    zone: str
    files: list[str]
    empty: list[str]


def raw_table(spark: SparkSession, archive: Archive, name: str) -> tuple[DataFrame, int]:
    """All-string rows with `line` and `file_order`, and their number."""
    cols = [c.rstrip("*") for c in COLUMNS[name].split()]
    required = tuple(c.rstrip("*") for c in COLUMNS[name].split() if c.endswith("*"))
    schema = ", ".join(f"`{c}` string" for c in cols) + ", line int, file_order int"
    if name not in archive:
        return spark.createDataFrame([], schema), 0
    rows = [(*(r.get(c, "") for c in cols), line, i) for i, (line, r) in enumerate(archive.rows(name, required))]
    parts = [spark.createDataFrame(rows[i : i + CHUNK], schema) for i in range(0, len(rows), CHUNK)] or [spark.createDataFrame([], schema)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out, len(rows)


def _none(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def _number(c: str, kind: str) -> Column:
    return F.col(c).try_cast(kind)


class Checks:
    """Checks of rows, looked at together in one job."""

    def __init__(self):
        self.asked: list[tuple[str, str, DataFrame]] = []

    def refuse(self, df: DataFrame, bad: Column, file: str, reason: str) -> None:
        """An error for the first row that is bad."""
        self.asked.append((file, reason, df.filter(bad).agg(F.min("line").alias("line"))))

    def once(self, df: DataFrame, keys: list[str], file: str) -> None:
        twice = df.groupBy(*keys).agg(F.count("*").alias("n"), F.max("line").alias("line")).filter("n > 1")
        self.asked.append((file, f"{', '.join(keys)} occurs twice", twice.agg(F.min("line").alias("line"))))

    def number(self, df: DataFrame, c: str, kind: str, low: float, high: float, file: str, default: float | None = None) -> DataFrame:
        """Column c as a number in [low, high]; empty is the default (an error if none)."""
        v = _number(c, kind)
        bad = (F.col(c) != "") & (v.isNull() | ~v.between(low, high))
        if default is None:
            bad = bad | (F.col(c) == "")
        self.refuse(df, bad, file, f"bad {c}")
        return df.withColumn(c, F.coalesce(v, F.lit(default).cast(kind)))

    def time(self, df: DataFrame, c: str, file: str, required: bool = False) -> DataFrame:
        return self._parsed(df, c, parse_time(F.col(c)), file, required)

    def date(self, df: DataFrame, c: str, file: str, required: bool = True) -> DataFrame:
        return self._parsed(df, c, parse_date(F.col(c)), file, required)

    def _parsed(self, df: DataFrame, c: str, v: Column, file: str, required: bool) -> DataFrame:
        bad = (F.col(c) != "") & v.isNull()
        self.refuse(df, bad | (F.col(c) == "") if required else bad, file, f"bad {c}")
        return df.withColumn(c, v)

    def run(self) -> None:
        """Raises what the first check asked for found, if any found something."""
        asked, self.asked = self.asked, []
        if not asked:
            return
        found = reduce(DataFrame.unionByName, [df.select(F.lit(i).alias("i"), "line") for i, (_, _, df) in enumerate(asked)])
        rows = sorted((r.i, r.line) for r in found.filter("line is not null").collect())
        if rows:
            i, line = rows[0]
            raise FeedError(asked[i][0], line, asked[i][1])


def complete_times(calls: DataFrame) -> DataFrame:
    """calls(trip_id, seq, arrival, departure, dist) with missing times filled in.

    One time fills both; rows without any lie between the departure before and the
    arrival after, by distance where all three rows have one and it grows, else by
    position; rows without a neighbour get 0.
    """
    one = calls.withColumn("arr", F.coalesce("arrival", "departure")).withColumn("dep", F.coalesce("departure", "arrival"))
    w = Window.partitionBy("trip_id").orderBy("seq")
    past, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    one = one.withColumn("place", F.row_number().over(w))
    timed = F.when(F.col("dep").isNotNull(), F.struct(F.col("dep").alias("t"), "place", "dist"))
    coming = F.when(F.col("dep").isNotNull(), F.struct(F.col("arr").alias("t"), "place", "dist"))
    rows = one.withColumn("a", F.last(timed, True).over(past)).withColumn("b", F.first(coming, True).over(ahead))
    by_dist = (F.col("dist") - F.col("a.dist")) / F.nullif(F.col("b.dist") - F.col("a.dist"), F.lit(0.0))
    by_place = (F.col("place") - F.col("a.place")) / (F.col("b.place") - F.col("a.place"))
    part = F.when(F.col("b.dist") > F.col("a.dist"), F.coalesce(by_dist, by_place)).otherwise(by_place)
    between = F.round(F.col("a.t") + (F.col("b.t") - F.col("a.t")) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), part))).cast("int")
    filled = F.coalesce(between, F.lit(0))
    return rows.select(*[c for c in calls.columns if c not in ("arrival", "departure")], F.coalesce("arr", filled).alias("arrival"), F.coalesce("dep", filled).alias("departure"))


def time_counts(calls: DataFrame) -> dict[str, int]:
    """How many rows complete_times() fills from their other time, from timed neighbours, or with 0."""
    w = Window.partitionBy("trip_id")
    timed = F.coalesce("arrival", "departure").isNotNull()
    at = F.when(timed, F.col("seq"))
    rows = calls.select(F.col("arrival").isNull().alias("no_arr"), F.col("departure").isNull().alias("no_dep"), F.coalesce(F.col("seq").between(F.min(at).over(w), F.max(at).over(w)), F.lit(False)).alias("inner"))
    untimed = F.col("no_arr") & F.col("no_dep")
    found = rows.agg(F.count_if(F.col("no_arr") != F.col("no_dep")).alias("filled_time"), F.count_if(untimed & F.col("inner")).alias("interpolated"), F.count_if(untimed & ~F.col("inner")).alias("missing_time")).first()
    return found.asDict()


def overlapping_frequencies(freq: DataFrame) -> DataFrame:
    """(trip_id, start) of rows that start before the row before them ends."""
    before = F.lag("end").over(Window.partitionBy("trip_id").orderBy("start"))
    return freq.select("trip_id", "start", before.alias("before")).filter("before > start").select("trip_id", "start")


def expand_frequencies(calls: DataFrame, freq: DataFrame) -> DataFrame:
    """Calls of every run of the templates in freq(trip_id, start, end, headway)."""
    first = calls.groupBy("trip_id").agg(F.min_by("departure", "seq").alias("first_dep"), F.min("seq").alias("first_seq"))
    runs = freq.select("trip_id", F.explode(F.sequence("start", F.col("end") - 1, "headway")).alias("go"))
    rows = calls.join(first, "trip_id").join(runs, "trip_id").withColumn("shift", F.col("go") - F.col("first_dep"))
    arrival, departure = F.col("arrival") + F.col("shift"), (F.col("departure") + F.col("shift")).cast("int")
    early = (arrival < 0) & (F.col("seq") == F.col("first_seq"))
    return rows.select(F.concat("trip_id", F.lit("@"), format_time(F.col("go"))).alias("trip_id"), F.col("trip_id").alias("template"), *[c for c in calls.columns if c not in ("trip_id", "arrival", "departure")], F.when(early, departure).otherwise(arrival).cast("int").alias("arrival"), departure.alias("departure"))


def load_feed(spark: SparkSession, data: bytes, limits: Limits | None = None) -> Feed:
    """A feed from the bytes of its zip.

    Broken values are errors with file and line; references that resolve to nothing
    drop their row and are counted.
    """
    archive = Archive(data, limits)
    for name in REQUIRED:
        if name not in archive:
            raise FeedError(name, None, "missing")
    if "calendar.txt" not in archive and "calendar_dates.txt" not in archive:
        raise FeedError("calendar.txt", None, "missing, and so is calendar_dates.txt")
    raw, sizes = {}, {}
    for name in COLUMNS:
        df, sizes[name] = raw_table(spark, archive, name)
        raw[name] = df.cache()
    empty = sorted(n for n in archive.members if n.endswith(".txt") and next(iter(archive.rows(n)), None) is None)
    lost: dict[str, DataFrame] = {}
    checks = Checks()
    t: dict[str, DataFrame] = {}

    info = raw["feed_info.txt"].orderBy("file_order").limit(1)
    for c in ("feed_start_date", "feed_end_date"):
        info = checks.date(info, c, "feed_info.txt", False)
    t["feed_info"], t["agency"] = info, raw["agency.txt"]
    zones = [r.agency_timezone for r in raw["agency.txt"].orderBy("file_order").collect()]
    if not zones:
        raise FeedError("agency.txt", None, "no agency")
    try:
        ZoneInfo(zones[0])
    except Exception as e:
        raise FeedError("agency.txt", 2, f"unknown time zone {zones[0]!r}") from e

    stops = raw["stops.txt"]
    checks.refuse(stops, F.col("stop_id") == "", "stops.txt", "empty stop_id")
    checks.once(stops, ["stop_id"], "stops.txt")
    for c, top in (("stop_lat", 90), ("stop_lon", 180)):
        v = _number(c, "double")
        checks.refuse(stops, (F.col(c) != "") & (v.isNull() | F.isnan(v) | (F.abs(v) > top)), "stops.txt", f"bad {c}")
        stops = stops.withColumn(c, v)
    stops = checks.number(stops, "location_type", "int", 0, 4, "stops.txt", 0)
    stops = stops.withColumn("stop_idx", F.col("file_order"))
    known = stops.select(F.col("stop_id").alias("parent_station"))
    lost["unknown_parent"] = stops.filter("parent_station <> ''").join(known, "parent_station", "left_anti")
    t["stops"] = stops

    routes = checks.number(raw["routes.txt"], "route_type", "int", 0, 65_535, "routes.txt")
    checks.once(routes, ["route_id"], "routes.txt")
    t["routes"] = routes

    trips = raw["trips.txt"]
    checks.once(trips, ["trip_id"], "trips.txt")
    checks.refuse(trips, ~F.col("direction_id").isin("", "0", "1"), "trips.txt", "bad direction_id")
    lost["trips_unknown_route"] = trips.join(routes, "route_id", "left_anti")
    trips = trips.join(routes.select("route_id"), "route_id", "left_semi").withColumn("block_id", _none("block_id"))
    t["trips"] = trips

    calendar = raw["calendar.txt"]
    for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"):
        checks.refuse(calendar, ~F.col(d).isin("0", "1"), "calendar.txt", f"bad {d}")
        calendar = calendar.withColumn(d, _number(d, "int"))
    for c in ("start_date", "end_date"):
        calendar = checks.date(calendar, c, "calendar.txt")
    t["calendar"] = calendar
    dates = checks.date(raw["calendar_dates.txt"], "date", "calendar_dates.txt")
    lost["bad_exception_type"] = dates.filter(~F.col("exception_type").isin("1", "2"))
    t["calendar_dates"] = dates.filter(F.col("exception_type").isin("1", "2")).withColumn("exception_type", F.col("exception_type").cast("int"))

    calls = raw["stop_times.txt"]
    lost["stop_times_unknown_trip"] = calls.join(trips, "trip_id", "left_anti")
    calls = calls.join(trips.select("trip_id"), "trip_id", "left_semi")
    lost["stop_times_unknown_stop"] = calls.join(stops, "stop_id", "left_anti")
    calls = calls.join(stops.select("stop_id"), "stop_id", "left_semi")
    calls = checks.number(calls, "stop_sequence", "int", 0, 2**31 - 1, "stop_times.txt")
    for c in ("pickup_type", "drop_off_type"):
        calls = checks.number(calls, c, "int", 0, 3, "stop_times.txt", 0)
    for c in ("arrival_time", "departure_time"):
        calls = checks.time(calls, c, "stop_times.txt")
    dist = _number("shape_dist_traveled", "double")
    calls = calls.select("trip_id", "stop_id", F.col("stop_sequence").alias("seq"), F.col("arrival_time").alias("arrival"), F.col("departure_time").alias("departure"), "pickup_type", "drop_off_type", F.when(~F.isnan(dist), dist).alias("dist"), "line")
    checks.once(calls, ["trip_id", "seq"], "stop_times.txt")
    untimed = calls
    lost["trips_without_stop_times"] = trips.join(calls, "trip_id", "left_anti")
    calls = complete_times(calls).drop("line", "dist")

    freq = raw["frequencies.txt"]
    lost["frequencies_unknown_trip"] = freq.join(trips, "trip_id", "left_anti")
    freq = freq.join(trips.select("trip_id"), "trip_id", "left_semi")
    for c in ("start_time", "end_time"):
        freq = checks.time(freq, c, "frequencies.txt", True)
    freq = checks.number(freq, "headway_secs", "int", 1, 2**31 - 1, "frequencies.txt")
    checks.refuse(freq, F.col("end_time") <= F.col("start_time"), "frequencies.txt", "ends before it starts")
    freq = freq.select("trip_id", F.col("start_time").alias("start"), F.col("end_time").alias("end"), F.col("headway_secs").alias("headway"), "exact_times", "line")
    # What follows computes with the values checked so far.
    checks.run()
    if overlapping_frequencies(freq).limit(1).count():
        raise FeedError("frequencies.txt", None, "headways overlap")
    t["frequencies"] = freq
    templates = freq.select("trip_id").distinct()
    size = calls.groupBy("trip_id").count().join(freq, "trip_id").agg(F.sum(F.col("count") * F.ceil((F.col("end") - F.col("start")) / F.col("headway"))).alias("n")).first().n or 0
    if size > archive.limits.rows:
        raise LimitError("frequencies.txt", None, f"more than {archive.limits.rows} rows when expanded")
    runs = expand_frequencies(calls, freq)
    new = runs.select("trip_id", "template").distinct().join(trips.withColumnRenamed("trip_id", "template"), "template")
    if new.join(trips.select("trip_id"), "trip_id", "left_semi").limit(1).count():
        raise FeedError("frequencies.txt", None, "a run's id is that of a trip")
    t["trips"] = trips.withColumn("template", F.lit(None).cast("string")).unionByName(new).join(templates.withColumn("is_template", F.lit(True)), "trip_id", "left").withColumn("is_template", F.coalesce("is_template", F.lit(False)))
    t["stop_times"] = calls.unionByName(runs.drop("template"))

    moves = raw["transfers.txt"]
    kind, least = _number("transfer_type", "int"), _number("min_transfer_time", "int")
    kind = F.when(F.col("transfer_type") == "", 0).otherwise(kind)
    checks.refuse(moves, (F.col("min_transfer_time") != "") & (least.isNull() | (least < 0)), "transfers.txt", "bad min_transfer_time")
    bad = kind.isNull() | ~kind.between(0, 5) | ((kind == 2) & least.isNull())
    for c, ids, key in (("stop", stops, "stop_id"), ("route", routes, "route_id"), ("trip", trips, "trip_id")):
        for side in ("from", "to"):
            col = f"{side}_{c}_id"
            moves = moves.join(ids.select(F.col(key).alias(f"known_{col}")).distinct(), F.col(col) == F.col(f"known_{col}"), "left")
            bad = bad | ((F.col(col) != "") & F.col(f"known_{col}").isNull())
    moves = moves.withColumn("bad", bad)
    lost["transfers_skipped"] = moves.filter("bad")
    t["transfers"] = moves.filter("not bad").select("file_order", *(_none(f"{s}_{c}_id").alias(f"{s}_{c}_id") for c in ("stop", "route", "trip") for s in ("from", "to")), kind.alias("transfer_type"), least.alias("min_transfer_time"))
    checks.run()
    counts = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("warning"), "n") for k, df in lost.items()])
    warn = {r.warning: r.n for r in counts.collect()} | time_counts(untimed)
    return Feed(t, warn, zones[0], sorted(n for n in archive.members if n.endswith(".txt")), empty)


def today(zone: str) -> str:
    return datetime.now(ZoneInfo(zone)).date().isoformat()
