"""Service days."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import FeedError

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: Days that a weekly pattern is followed from either end, at least; more by its removals.
REACH = 7


def last_patterns(calendar: DataFrame) -> DataFrame:
    """One weekly pattern a service: its last row (file_order)."""
    n = F.row_number().over(Window.partitionBy("service_id").orderBy(F.desc("file_order")))
    return calendar.withColumn("n", n).filter("n = 1").drop("n")


def weekly(day: Column) -> Column:
    """Whether the pattern's flag for the weekday of day is set."""
    return F.array(*(F.col(d).cast("boolean") for d in DAYS))[F.weekday(day)]


def active_on(calendar: DataFrame, exceptions: DataFrame, dates: DataFrame) -> DataFrame:
    """(service_id, date) pairs that run: removed beats added beats weekly."""
    exact = exceptions.groupBy("service_id", "date").agg(F.max("exception_type").alias("kind"))
    regular = last_patterns(calendar).join(F.broadcast(dates), F.col("date").between(F.col("start_date"), F.col("end_date"))).filter(weekly(F.col("date"))).select("service_id", "date")
    added = exact.join(dates, "date").filter("kind = 1").select("service_id", "date")
    return regular.union(added).distinct().join(exact.filter("kind = 2").select("service_id", "date"), ["service_id", "date"], "left_anti")


def service_range(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(service_id, first, last): first and last running day of each service.

    A weekly pattern is followed for at most 7 * (exceptions + 1) days from either
    end, since every 7 days hold each weekday and each removal hides one.
    """
    n = exceptions.groupBy("service_id").agg(F.count("*").alias("n"))
    rows = last_patterns(calendar).join(n, "service_id", "left").withColumn("reach", (REACH * (F.coalesce("n", F.lit(0)) + 1)).cast("int"))
    head = F.sequence("start_date", F.least("end_date", F.date_add("start_date", F.col("reach"))))
    tail = F.sequence(F.greatest("start_date", F.date_sub("end_date", F.col("reach"))), F.col("end_date"))
    days = rows.filter("start_date <= end_date").withColumn("date", F.explode(F.array_union(head, tail))).filter(weekly(F.col("date"))).select("service_id", "date")
    exact = exceptions.groupBy("service_id", "date").agg(F.max("exception_type").alias("kind"))
    days = days.union(exact.filter("kind = 1").select("service_id", "date")).distinct().join(exact.filter("kind = 2").select("service_id", "date"), ["service_id", "date"], "left_anti")
    return days.groupBy("service_id").agg(F.min("date").alias("first"), F.max("date").alias("last"))


def validity(calendar: DataFrame, exceptions: DataFrame, info: DataFrame) -> DataFrame:
    """(start, end): declared ends win one by one over derived ones."""
    derived = service_range(calendar, exceptions).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    declared = info.agg(F.first("feed_start_date", True).alias("s"), F.first("feed_end_date", True).alias("e"))
    # Two rows of one each.
    return derived.crossJoin(declared).select(F.coalesce("s", "first").alias("start"), F.coalesce("e", "last").alias("end"))


def day_origin(day: date, zone: str) -> int:
    """Unix seconds of noon minus twelve hours; an error for a date the zone skipped."""
    tz = ZoneInfo(zone)
    noon = datetime(day.year, day.month, day.day, 12, tzinfo=tz)
    seconds = int(noon.timestamp())
    if datetime.fromtimestamp(seconds, tz).date() != day:
        raise FeedError("agency.txt", None, f"{day} does not exist in {zone}")
    return seconds - 43_200


def day_offset(day: date, plan: date, zone: str) -> int:
    """Seconds from the plan date's origin to that of day."""
    return day_origin(day, zone) - day_origin(plan, zone)


def service_days(plan: date, zone: str, latest: int, start: int, end: int) -> list[tuple[date, int]]:
    """Days whose trips may reach the window, with their offsets."""
    low, high = (start - latest - 3600) // 86_400, (end + 3600) // 86_400
    out = []
    for k in range(low, high + 1):
        day = plan + timedelta(days=k)
        try:
            out.append((day, day_offset(day, plan, zone)))
        except FeedError:
            if k == 0:
                raise
    return out
