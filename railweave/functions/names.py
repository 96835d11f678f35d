"""Names and identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FIXED VALUES: letters written out before names are compared.
FOLDS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}


def normalise_name(name: Column) -> Column:
    """Lower case, umlauts written out, letters and digits only."""
    out = F.lower(name)
    for a, b in FOLDS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"[^\p{L}\p{N}]", "")


def dhid_prefix(stop_id: Column) -> Column:
    """Country, municipality and station part of a DHID, else null."""
    found = F.regexp_extract(stop_id, r"^[a-z]{2}:[0-9]{5}:[^:]+", 0)
    return F.when(found != "", found)


def is_dhid(stop_id: Column) -> Column:
    return stop_id.rlike(r"^[a-z]{2}:[0-9]{5}:")


def glob_pattern(glob: str) -> str:
    """Anchored regular expression of a glob with * and ?."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def matches_glob(text: Column, glob: str) -> Column:
    return text.rlike(glob_pattern(glob))


def in_ranges(route_type: Column, ranges: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for a, b in ranges:
        out = out | route_type.between(a, b)
    return F.coalesce(out, F.lit(False))


def display_name(short: Column, long: Column) -> Column:
    return F.coalesce(F.when(short != "", short), long)
