"""Timetables seen in tables of events.

Each user and day of `events` is a trip, each event a call: the event's key names
the platform, its type says whether one may board and alight.  The lens gives the
tables of a feed, so that every operator runs on them as on a real feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.network import numbered

STATIONS = 20
PLAN_DATE = "2024-01-15"
TOUR_DATE = "2024-01-01"


def route_type(route: Column) -> Column:
    return F.when(route <= 3, 1).when(route == 4, 0).when(route <= 6, 3).otherwise(2)


def calls(spark: SparkSession, sf_dir: str, day: str | None = PLAN_DATE) -> DataFrame:
    """stop_times of the lens, in one or all days, with what hop building needs."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.col("ts").cast("timestamp")
    if day:
        e = e.filter((F.to_date(ts) == F.lit(day).cast("date")))
    k = F.get_json_object("props", "$.k").cast("int")
    t = F.floor((F.unix_micros(ts) - F.unix_micros(F.date_trunc("day", ts))) / 1_000_000).cast("int")
    route = F.pmod("user_id", F.lit(8)).cast("int")
    rows = e.select(
        F.concat_ws("@", F.col("user_id").cast("string"), F.to_date(ts).cast("string")).alias("trip_id"),
        F.to_date(ts).alias("service_date"),
        route.alias("route_id"),
        route_type(route).alias("route_type"),
        F.pmod("user_id", F.lit(50)).cast("int").alias("block_id"),
        F.concat(F.lit("P"), k.cast("string")).alias("stop_id"),
        F.pmod(k, F.lit(STATIONS)).cast("int").alias("station"),
        t.alias("arrival"),
        t.alias("departure"),
        "event_type",
        "event_id",
    )
    rows = rows.withColumn("pickup_type", F.when(F.col("event_type").isin("error", "purchase"), 1).otherwise(0)).withColumn("drop_off_type", F.when(F.col("event_type").isin("error", "signup"), 1).otherwise(0))
    return numbered(rows, ["trip_id"], ["arrival", "event_id"], "seq").drop("event_type", "event_id")


def tour_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lens with one trip a user: seconds run on from the first day."""
    c = calls(spark, sf_dir, None)
    shift = F.datediff("service_date", F.lit(TOUR_DATE).cast("date")) * 86_400
    c = c.filter((F.col("service_date") >= F.lit(TOUR_DATE).cast("date")) & (shift <= 2 * 86_400))
    c = c.withColumn("arrival", (F.col("arrival") + shift).cast("int")).withColumn("departure", (F.col("departure") + shift).cast("int"))
    c = c.withColumn("day_seq", F.col("seq")).withColumn("trip_id", F.split("trip_id", "@")[0])
    return numbered(c.drop("seq"), ["trip_id"], ["service_date", "day_seq"], "seq").drop("day_seq")


def stations(spark: SparkSession) -> DataFrame:
    i = F.col("id").cast("int")
    return spark.range(STATIONS).select(i.alias("station"), F.concat(F.lit("S"), i.cast("string")).alias("station_id"), (F.lit(48.10) + F.lit(0.004) * F.floor(i / 5)).cast("double").alias("lat"), (F.lit(11.50) + F.lit(0.006) * F.pmod(i, F.lit(5))).cast("double").alias("lon"))


def freight_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger lens: orders are trips, their lines calls at the suppliers' nations."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("station"))
    day = F.datediff(F.to_date(F.col("l_shipdate").cast("timestamp")), F.lit("1995-01-01").cast("date"))
    rows = line.join(supplier, "l_suppkey").select(F.col("l_orderkey").alias("trip_id"), "station", day.alias("arrival"), day.alias("departure"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return numbered(rows, ["trip_id"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"], "seq").drop("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")


# The same lens for DuckDB.
CALLS_SQL = f"""
lens_calls AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY trip_id ORDER BY arrival, event_id) AS INTEGER) AS seq FROM (
        SELECT user_id::VARCHAR || '@' || CAST(ts AS DATE)::VARCHAR AS trip_id, CAST(ts AS DATE) AS service_date,
               CAST(user_id % 8 AS INTEGER) AS route_id,
               CASE WHEN user_id % 8 <= 3 THEN 1 WHEN user_id % 8 = 4 THEN 0 WHEN user_id % 8 <= 6 THEN 3 ELSE 2 END AS route_type,
               CAST(user_id % 50 AS INTEGER) AS block_id,
               'P' || CAST(json_extract(props, '$.k') AS INTEGER) AS stop_id,
               CAST(CAST(json_extract(props, '$.k') AS INTEGER) % {STATIONS} AS INTEGER) AS station,
               CAST((epoch_us(ts) - epoch_us(date_trunc('day', ts))) // 1000000 AS INTEGER) AS arrival,
               CAST((epoch_us(ts) - epoch_us(date_trunc('day', ts))) // 1000000 AS INTEGER) AS departure,
               CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END AS pickup_type,
               CASE WHEN event_type IN ('error', 'signup') THEN 1 ELSE 0 END AS drop_off_type, event_id
        FROM events)
)"""
DAY_SQL = f"{CALLS_SQL}, day_calls AS (SELECT * FROM lens_calls WHERE service_date = DATE '{PLAN_DATE}')"
STATIONS_SQL = f"lens_stations AS (SELECT CAST(i AS INTEGER) AS station, 'S' || i AS station_id, 48.10::DOUBLE + 0.004::DOUBLE * (i // 5) AS lat, 11.50::DOUBLE + 0.006::DOUBLE * (i % 5) AS lon FROM range({STATIONS}) t(i))"
FREIGHT_SQL = """
freight_calls AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY trip_id ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS seq FROM (
        SELECT l_orderkey AS trip_id, s_nationkey AS station, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS arrival,
               CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS departure, l_shipdate, l_linenumber, l_partkey, l_suppkey
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
)"""
