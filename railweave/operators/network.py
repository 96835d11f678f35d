"""Hops between consecutive calls, and what a plan's network is made of.

Hops are built by one window keyed on the trip; filters on trips come before it.
Every distance join goes through grid cells, so it is an equi-join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NetworkError
from ..functions.geo import METRES_PER_DEGREE, cell, haversine, lon_cell, neighbours, walk_duration
from ..functions.names import in_ranges
from ..rules import Rules

MOST_CALLS = 65_537
MOST_LINKS_PER_STATION = 2_000
MOST_LINKS = 5_000_000


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, first: int = 1) -> DataFrame:
    """df with a row number within keys."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, (n + (first - 1)).cast("int"))


def pickup_allowed() -> Column:
    return F.col("pickup_type") != 1


def drop_off_allowed() -> Column:
    return F.col("drop_off_type") != 1


def is_pass_through() -> Column:
    return (F.col("pickup_type") == 1) & (F.col("drop_off_type") == 1)


def backwards_trips(calls: DataFrame) -> DataFrame:
    """(trip_id) of trips whose calls go back in time."""
    later = F.lead("arrival").over(Window.partitionBy("trip_id").orderBy("seq"))
    bad = (F.col("departure") < F.col("arrival")) | F.coalesce(later < F.col("departure"), F.lit(False))
    return calls.select("trip_id", bad.alias("bad")).filter("bad").select("trip_id").distinct()


def window_trips(calls: DataFrame, start: int, end: int, offset: Column | int = 0) -> DataFrame:
    """(trip_id, first_dep, last_arr, calls) of trips that overlap the window."""
    off = offset if isinstance(offset, Column) else F.lit(offset)
    by = calls.groupBy("trip_id").agg(F.min_by("departure", "seq").alias("first_dep"), F.max_by("arrival", "seq").alias("last_arr"), F.count("*").cast("int").alias("calls"))
    return by.filter((F.col("first_dep") + off <= end) & (F.col("last_arr") + off >= start))


def hops(calls: DataFrame, keep: list[str] | None = None, visits: Column | None = None) -> DataFrame:
    """Hops of calls(trip_id, seq, station, arrival, departure, pickup_type, drop_off_type, ...).

    pos counts from 0; an arrival before the departure is lifted to it; a call that
    is passed through never counts as a visit.
    """
    w = Window.partitionBy("trip_id").orderBy("seq")
    flags = {"pickup_type", "drop_off_type"} <= set(calls.columns)
    seen = ~is_pass_through() & (visits if visits is not None else F.lit(True)) if flags else F.lit(True)
    rows = calls.withColumn("seen", seen)
    out = rows.select(
        "trip_id",
        (F.row_number().over(w) - 1).cast("int").alias("pos"),
        F.col("station").alias("dep_station"),
        F.lead("station").over(w).alias("arr_station"),
        F.col("departure").alias("dep"),
        F.greatest(F.lead("arrival").over(w), F.col("departure")).alias("arr"),
        F.lead("arrival").over(w).alias("raw_arr"),
        *([pickup_allowed().alias("pickup"), (F.lead("drop_off_type").over(w) != 1).alias("drop_off"), F.col("seen").alias("visit_dep"), F.lead("seen").over(w).alias("visit_arr")] if flags else []),
        *(keep or []),
    )
    return out.filter("raw_arr is not null").drop("raw_arr")


def walk_links(stations: DataFrame, metres: float, detour: float, kmh: float, least: int) -> DataFrame:
    """(from, to, metres, duration) of ordered pairs of stations within `metres`.

    Cells are at least as wide as the reach, so partners lie in neighbouring cells.
    """
    if metres < 1:
        return stations.select(F.col("station").alias("from"), F.col("station").alias("to"), F.lit(0.0).alias("metres"), F.lit(0).alias("duration")).limit(0)
    size = metres / METRES_PER_DEGREE * 1.01
    placed = stations.filter("lat is not null and lon is not null")
    row = cell(F.col("lat"), size)
    a = placed.select(F.col("station").alias("from"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), row.alias("r0")).withColumn("r", neighbours(F.col("r0")))
    a = a.withColumn("c", neighbours(lon_cell(F.col("lon1"), F.col("r"), size)))
    b = placed.select(F.col("station").alias("to"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), row.alias("r"))
    b = b.withColumn("c", lon_cell(F.col("lon2"), F.col("r"), size))
    found = a.join(b, ["r", "c"]).filter(F.col("from") != F.col("to"))
    d = haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    found = found.withColumn("metres", d).filter(F.col("metres") <= metres)
    return found.select("from", "to", "metres", walk_duration(F.col("metres"), detour, kmh, least).alias("duration"))


def apply_walks(links: DataFrame, overrides: DataFrame, least: int) -> DataFrame:
    """Links with measured durations, without forbidden ones.

    overrides(entry, from, to, seconds, forbid, both): the last entry for a
    direction wins; measured seconds are lifted to `least`; none makes a link.
    """
    each = overrides.select("entry", "from", "to", "seconds", "forbid").unionByName(overrides.filter("both").select("entry", F.col("to").alias("from"), F.col("from").alias("to"), "seconds", "forbid"))
    last = each.groupBy("from", "to").agg(F.max_by(F.struct("seconds", "forbid"), "entry").alias("o"))
    joined = links.join(last, ["from", "to"], "left")
    kept = joined.filter(~F.coalesce(F.col("o.forbid"), F.lit(False)))
    return kept.select("from", "to", "metres", F.when(F.col("o.seconds").isNotNull(), F.greatest(F.col("o.seconds"), F.lit(least))).otherwise(F.col("duration")).cast("int").alias("duration"))


def checked_links(links: DataFrame) -> DataFrame:
    """links, or an error where a station or the network has too many."""
    most = links.groupBy("from").count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    if (most["most"] or 0) > MOST_LINKS_PER_STATION or (most["all"] or 0) > MOST_LINKS:
        raise NetworkError("too many walk links")
    return links


def transfer_minimums(stations: DataFrame, links: DataFrame, transfers: DataFrame, same_station: int) -> tuple[DataFrame, DataFrame]:
    """(change_time, links) after transfers(from_station, to_station, transfer_type, min_transfer_time).

    Type 2 raises the change time of a station or the duration of a link that
    exists; type 3 refuses the network.
    """
    if transfers.filter("transfer_type = 3").limit(1).count():
        raise NetworkError("a forbidden transfer lies in the network")
    least = transfers.filter("transfer_type = 2").groupBy(F.col("from_station").alias("from"), F.col("to_station").alias("to")).agg(F.max("min_transfer_time").alias("least"))
    own = least.filter(F.col("from") == F.col("to")).select(F.col("from").alias("station"), "least")
    change = stations.select("station").join(own, "station", "left").select("station", F.greatest(F.lit(same_station), F.col("least")).cast("int").alias("seconds"))
    links = links.join(least, ["from", "to"], "left").withColumn("duration", F.greatest("duration", "least").cast("int")).drop("least")
    return change, links


def unserved(targets: DataFrame, rows: DataFrame, start: int, end: int) -> DataFrame:
    """Targets that no hop visits within the window."""
    seen = rows.filter(F.col("visit_dep") & F.col("pickup") & F.col("dep").between(start, end)).select(F.col("dep_station").alias("station"))
    seen = seen.union(rows.filter(F.col("visit_arr") & F.col("arr").between(start, end)).select("arr_station"))
    return targets.join(seen.distinct(), "station", "left_anti")


def violations(rows: DataFrame, change: DataFrame, links: DataFrame) -> DataFrame:
    """(rule, n): broken invariants of a network; empty if sound."""
    w = Window.partitionBy("trip_id").orderBy("pos")
    chain = rows.withColumn("next_station", F.lead("dep_station").over(w)).withColumn("next_dep", F.lead("dep").over(w))
    found = chain.agg(
        F.count_if(F.col("arr") < F.col("dep")).alias("arrival before departure"),
        F.count_if(F.col("next_station") != F.col("arr_station")).alias("hops do not chain"),
        F.count_if(F.col("next_dep") < F.col("arr")).alias("departure before arrival"),
    )
    out = found.select(F.explode(F.array(*(F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("n")) for c in found.columns))).alias("x")).select("x.*")
    out = out.union(change.agg(F.lit("change under one second"), F.count_if(F.col("seconds") < 1))).union(links.agg(F.lit("walk under one second"), F.count_if(F.col("duration") < 1)))
    return out.filter("n > 0")


@dataclass
class Network:
    """DataFrames of one plan: connections, footpaths, change_time, targets, window."""

    connections: DataFrame
    footpaths: DataFrame
    change_time: DataFrame
    targets: DataFrame
    window: tuple[int, int]
    report: DataFrame


def build(calls: DataFrame, stations: DataFrame, targets: DataFrame, rules: Rules, visit_ranges: list[tuple[int, int]], walks: DataFrame | None = None, transfers: DataFrame | None = None) -> Network:
    """The network of calls(trip_id, seq, station, arrival, departure, ..., route_type) already offset to the plan date."""
    rules.checked()
    if rules.mode != "stops" or rules.end != "any":
        raise NetworkError("only mode stops with any end is planned")
    start, end = rules.window
    modes = visit_ranges + rules.connector_ranges
    of_mode = calls.filter(in_ranges(F.col("route_type"), modes))
    back = backwards_trips(of_mode)
    inside = window_trips(of_mode, start, end)
    kept = of_mode.join(inside.filter(F.col("calls").between(2, MOST_CALLS)).select("trip_id"), "trip_id", "left_semi").join(back, "trip_id", "left_anti")
    visits = in_ranges(F.col("route_type"), visit_ranges)
    if not rules.count_pass_through:
        rows = hops(kept, ["route_type"], visits)
    else:
        rows = hops(kept, ["route_type"], visits).withColumn("visit_dep", in_ranges(F.col("route_type"), visit_ranges)).withColumn("visit_arr", in_ranges(F.col("route_type"), visit_ranges))
    used = rows.select(F.col("dep_station").alias("station")).union(rows.select("arr_station")).union(targets.select("station")).distinct()
    here = stations.join(used, "station", "left_semi")
    reach = rules.max_walk_m if rules.allow_walking else 0.0
    links = walk_links(here, reach, rules.walk_detour_factor, rules.walking_speed_kmh, rules.min_transfer_s.walk_link)
    if walks is not None:
        links = apply_walks(links, walks, rules.min_transfer_s.walk_link)
    if transfers is not None:
        change, links = transfer_minimums(here, links, transfers, rules.min_transfer_s.same_station)
    else:
        change = here.select("station", F.lit(rules.min_transfer_s.same_station).alias("seconds"))
    skipped = back.join(inside, "trip_id", "left_semi").agg(F.count("*").alias("trips_backwards"))
    long = inside.filter(F.col("calls") > MOST_CALLS).agg(F.count("*").alias("trips_too_long"))
    return Network(rows, links, change, targets, (start, end), skipped.crossJoin(long))
