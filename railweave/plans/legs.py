"""Plans as rows: legs(plan, leg, kind, trip_id, from_pos, to_pos, start, end, metres)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ridden_hops(legs: DataFrame, connections: DataFrame) -> DataFrame:
    """Hops of every ride of every plan."""
    rides = legs.filter("kind = 'ride'").select("plan", "leg", "trip_id", "from_pos", "to_pos")
    return rides.join(connections, "trip_id").filter(F.col("pos").between(F.col("from_pos"), F.col("to_pos")))


def plan_visits(legs: DataFrame, connections: DataFrame) -> DataFrame:
    """(plan, station, visit): first visits, by boarding or arriving."""
    h = ridden_hops(legs, connections)
    seen = h.filter("visit_dep and pos = from_pos").select("plan", F.col("dep_station").alias("station"), F.col("dep").alias("at"))
    seen = seen.unionByName(h.filter("visit_arr").select("plan", F.col("arr_station").alias("station"), F.col("arr").alias("at")))
    return seen.groupBy("plan", "station").agg(F.min("at").alias("visit"))


def plan_duration(visits: DataFrame, targets: DataFrame) -> DataFrame:
    """(plan, first, last, seconds) of plans that visit every target."""
    n = targets.agg(F.countDistinct("station").alias("n"))
    seen = visits.join(targets.distinct(), "station").groupBy("plan").agg(F.min("visit").alias("first"), F.max("visit").alias("last"), F.count("*").alias("seen"))
    return seen.join(n, F.col("seen") == F.col("n")).select("plan", "first", "last", (F.col("last") - F.col("first")).alias("seconds"))


def transfer_slacks(legs: DataFrame, connections: DataFrame, change_time: DataFrame) -> DataFrame:
    """(plan, leg, station, walked, slack): time to spare at each change of trips."""
    ends = connections.select("trip_id", "pos", "dep_station", "arr_station", "dep", "arr")
    a = ends.select("trip_id", F.col("pos").alias("from_pos"), F.col("dep_station").alias("station"), F.col("dep").alias("board"))
    b = ends.select("trip_id", F.col("pos").alias("to_pos"), F.col("arr_station").alias("off_station"), F.col("arr").alias("off"))
    rows = legs.join(a, ["trip_id", "from_pos"], "left").join(b, ["trip_id", "to_pos"], "left")
    past = Window.partitionBy("plan").orderBy("leg").rowsBetween(Window.unboundedPreceding, -1)
    ride = F.when(F.col("kind") == "ride", F.struct("leg", "trip_id", "off_station", "off"))
    walk = F.when(F.col("kind") == "walk", F.struct("leg", "end"))
    rows = rows.withColumn("p", F.last(ride, True).over(past)).withColumn("w", F.last(walk, True).over(past)).filter("kind = 'ride' and p is not null and p.trip_id <> trip_id")
    rows = rows.withColumn("walked", F.coalesce(F.col("w.leg") > F.col("p.leg"), F.lit(False)))
    rows = rows.join(change_time.select(F.col("station").alias("at"), "seconds"), F.col("p.off_station") == F.col("at"))
    ready = F.when(F.col("walked"), F.col("w.end")).otherwise(F.col("p.off") + F.col("seconds"))
    return rows.select("plan", "leg", "station", "walked", (F.col("board") - ready).cast("int").alias("slack"))


def summary(legs: DataFrame, visits: DataFrame) -> DataFrame:
    """(plan, transfers, walk_m, stations_visited)."""
    s = legs.groupBy("plan").agg(F.greatest(F.lit(0).cast("long"), F.count_if(F.col("kind") == "ride") - 1).alias("transfers"), F.round(F.sum(F.when(F.col("kind") == "walk", F.col("metres")).otherwise(0.0)), 1).alias("walk_m"))
    return s.join(visits.groupBy("plan").agg(F.count("*").alias("stations_visited")), "plan")
