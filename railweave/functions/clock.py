"""Times are whole seconds from the start of the service day; they may pass 24 hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LATEST = 7 * 86_400


def parse_time(text: Column) -> Column:
    """Seconds of H:MM:SS to HHH:MM:SS up to 168:00:00, else null."""
    t = F.trim(text)
    part = lambda k: F.split(t, ":")[k].cast("int")
    seconds = part(0) * 3600 + part(1) * 60 + part(2)
    ok = t.rlike(r"^[0-9]{1,3}:[0-5][0-9]:[0-5][0-9]$")
    found = F.when(ok, seconds)
    return F.when(found <= LATEST, found)


def parse_clock(text: Column) -> Column:
    """Like parse_time, seconds optional."""
    t = F.trim(text)
    return parse_time(F.when(F.size(F.split(t, ":")) == 2, F.concat(t, F.lit(":00"))).otherwise(t))


def format_time(seconds: Column) -> Column:
    """Signed HH:MM:SS."""
    s = F.abs(seconds)
    return F.when(seconds.isNotNull(), F.format_string("%s%02d:%02d:%02d", F.when(seconds < 0, "-").otherwise(""), F.expr("0") + F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))))


def parse_date(text: Column) -> Column:
    """Date of eight digits, else null."""
    return F.when(text.rlike("^[0-9]{8}$"), F.try_to_date(text, "yyyyMMdd"))
