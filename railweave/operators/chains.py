"""Which trip a vehicle runs next, and the transfer row that decides a change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import components


def block_successors(trips: DataFrame) -> DataFrame:
    """(trip_id, next_trip) of trips(service_date, block_id, trip_id, first_dep, ...) of one vehicle.

    The next trip by first departure; none where both depart at the same time.
    """
    w = Window.partitionBy("service_date", "block_id").orderBy("first_dep", "trip_id")
    rows = trips.filter("block_id is not null").select("trip_id", "first_dep", F.lead("trip_id").over(w).alias("next_trip"), F.lead("first_dep").over(w).alias("next_dep"))
    return rows.filter("next_trip is not null and next_dep > first_dep").select("trip_id", "next_trip")


def continuations(trips: DataFrame, linked: DataFrame, vetoed: DataFrame) -> DataFrame:
    """(trip_id, next_trip) that one may stay aboard for.

    trips(trip_id, service_date, block_id, first_dep, last_arr, first_station,
    last_station, visits, calls); linked and vetoed(trip_id, next_trip) come from
    in-seat transfer rows.  Linked trips win over the block's successor; a successor
    that is vetoed is none; the join needs two calls on each side, one station, no
    departure before the arrival, the same visiting kind, and must be one to one.
    """
    by_block = block_successors(trips).join(vetoed, ["trip_id", "next_trip"], "left_anti").join(linked.select("trip_id").distinct(), "trip_id", "left_anti")
    pairs = linked.select("trip_id", "next_trip").union(by_block).distinct()
    a = trips.select("trip_id", "service_date", F.col("last_arr").alias("a_arr"), F.col("last_station").alias("a_at"), F.col("visits").alias("a_visits"), F.col("calls").alias("a_calls"))
    b = trips.select(F.col("trip_id").alias("next_trip"), F.col("service_date").alias("b_date"), F.col("first_dep").alias("b_dep"), F.col("first_station").alias("b_at"), F.col("visits").alias("b_visits"), F.col("calls").alias("b_calls"))
    pairs = pairs.join(a, "trip_id").join(b, "next_trip").filter("service_date = b_date")
    out = F.count("*").over(Window.partitionBy("trip_id"))
    into = F.count("*").over(Window.partitionBy("next_trip"))
    pairs = pairs.withColumn("n_out", out).withColumn("n_into", into).filter("n_out = 1 and n_into = 1 and trip_id <> next_trip")
    return pairs.filter("a_calls >= 2 and b_calls >= 2 and a_at = b_at and b_dep >= a_arr and a_visits = b_visits").select("trip_id", "next_trip")


def chains(pairs: DataFrame, trips: DataFrame) -> DataFrame:
    """(trip_id, chain, part): trips joined by continuations, in running order."""
    numbers = trips.select("trip_id", F.xxhash64("trip_id").alias("k"), "first_dep")
    a = pairs.join(numbers.select("trip_id", F.col("k").alias("a")), "trip_id").join(numbers.select(F.col("trip_id").alias("next_trip"), F.col("k").alias("b")), "next_trip")
    joined = components(a.select("a", "b"))
    rows = numbers.join(joined, F.col("k") == F.col("node"), "left").withColumn("g", F.coalesce("root", "k"))
    w = Window.partitionBy("g").orderBy("first_dep", "trip_id")
    return rows.select("trip_id", F.first("trip_id").over(w).alias("chain"), (F.row_number().over(w) - 1).cast("int").alias("part"))


def decisive_transfers(changes: DataFrame, transfers: DataFrame) -> DataFrame:
    """Of each change the most specific transfer row.

    changes(change, from_stop, from_parent, to_stop, to_parent, from_route, to_route,
    from_trip, to_trip) meet transfers(file_order, from_stop_id, to_stop_id, ...) by
    stop or parent; route and trip references must match where set.  Specificity: both
    trips, trip and route, one trip, both routes, one route, stops alone; then stops
    named exactly; then file order.
    """
    ends = lambda side: F.explode(F.array_distinct(F.array(F.col(f"{side}_stop"), F.coalesce(f"{side}_parent", f"{side}_stop"))))
    rows = changes.withColumn("from_stop_id", ends("from")).withColumn("to_stop_id", ends("to"))
    t = transfers.select("file_order", "from_stop_id", "to_stop_id", "from_route_id", "to_route_id", "from_trip_id", "to_trip_id", "transfer_type", "min_transfer_time")
    found = rows.join(t, ["from_stop_id", "to_stop_id"])
    for name in ("route", "trip"):
        for side in ("from", "to"):
            found = found.filter(F.col(f"{side}_{name}_id").isNull() | (F.col(f"{side}_{name}_id") == F.col(f"{side}_{name}")))
    n = lambda name: F.col(f"from_{name}_id").isNotNull().cast("int") + F.col(f"to_{name}_id").isNotNull().cast("int")
    rank = F.when(n("trip") == 2, 1).when((n("trip") == 1) & (n("route") > 0), 2).when(n("trip") == 1, 3).when(n("route") == 2, 4).when(n("route") == 1, 5).otherwise(6)
    exact = (F.col("from_stop_id") != F.col("from_stop")).cast("int") + (F.col("to_stop_id") != F.col("to_stop")).cast("int")
    best = F.row_number().over(Window.partitionBy("change").orderBy(rank, exact, "file_order"))
    return found.withColumn("rank", rank.cast("int")).withColumn("best", best).filter("best = 1").select("change", "file_order", "rank", "transfer_type", "min_transfer_time")
