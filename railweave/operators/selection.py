"""Targets: which stations a plan must visit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SelectionError
from ..functions.names import in_ranges, matches_glob
from ..rules import Include, Selection
from .network import is_pass_through


def matching_routes(routes: DataFrame, rule: Include) -> DataFrame:
    """Routes of a rule: its types and agencies and any of its globs."""
    if rule.route_types:
        routes = routes.filter(F.col("route_type").isin(list(rule.route_types)))
    if rule.agencies:
        routes = routes.filter(F.col("agency_id").isin(list(rule.agencies)))
    if rule.routes:
        hit = F.lit(False)
        for g in rule.routes:
            hit = hit | matches_glob(F.col("route_short_name"), g)
        routes = routes.filter(hit)
    return routes


def select_targets(served: DataFrame, routes: DataFrame, stations: DataFrame, selection: Selection) -> DataFrame:
    """(station) of a selection.

    served(station, route_id, pickup_type, drop_off_type) are the calls of trips that
    run; a call that is passed through selects nothing.  A rule's trip filters, box
    and explicit stations must all hold; rules add up; exclusions come last.
    """
    if not selection.include:
        raise SelectionError("the selection includes nothing")
    named = {x for r in selection.include for x in r.stations} | set(selection.exclude_stations)
    if named:
        known = {r.station_id for r in stations.filter(F.col("station_id").isin(sorted(named))).select("station_id").collect()}
        if unknown := sorted(named - known):
            raise SelectionError(f"unknown station {unknown[0]!r}")
    out = None
    for rule in selection.include:
        part = stations
        if rule.stations:
            part = part.filter(F.col("station_id").isin(list(rule.stations)))
        if rule.bbox:
            south, west, north, east = rule.bbox
            part = part.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))
        if rule.by_trip:
            hit = served.filter(~is_pass_through()).join(matching_routes(routes, rule), "route_id", "left_semi").select("station").distinct()
            part = part.join(hit, "station", "left_semi")
        part = part.select("station")
        out = part if out is None else out.union(part)
    out = out.distinct()
    if selection.exclude_stations:
        gone = stations.filter(F.col("station_id").isin(list(selection.exclude_stations)))
        out = out.join(gone, "station", "left_anti")
    if not out.limit(1).count():
        raise SelectionError("no station matches the selection")
    return out


def visit_route_types(routes: DataFrame, selection: Selection) -> list[tuple[int, int]]:
    """Route types whose rides visit: those of matching routes and explicit ones."""
    types = set(selection.visit_route_types) | {t for r in selection.include for t in r.route_types}
    for rule in selection.include:
        if rule.by_trip and not rule.route_types:
            types |= {r.route_type for r in matching_routes(routes, rule).select("route_type").distinct().collect()}
    if not types:
        raise SelectionError("the selection names no route type that visits")
    return [(t, t) for t in sorted(types)]


def visiting(routes: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    return routes.filter(in_ranges(F.col("route_type"), ranges))
