"""Plans as itinerary documents."""

from __future__ import annotations

import json
import math
from dataclasses import asdict

from ..rules import Rules
from .kernel import Bundle, Leg, duration, visits


def clock(seconds: int) -> str:
    s = abs(seconds)
    return f"{'-' if seconds < 0 else ''}{s // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d}"


def _half_up(x: float, digits: int) -> float:
    """Rounds half away from zero."""
    k = 10**digits
    return math.copysign(math.floor(abs(x) * k + 0.5) / k, x)


def to_itinerary(net: Bundle, legs: list[Leg], rules: Rules, stations: dict[int, str], trips: dict, calls: dict, feed: dict, zone: str, schema: str, bound: int | None = None) -> str:
    """JSON of legs.

    trips[trip id] gives (gtfs id, service date, offset, route, headsign); calls[trip id]
    the stop id of each call.  Waits fill the time between legs; transfers are rides
    less one.
    """
    out, now, here, metres, rides = [], None, None, 0.0, 0
    for leg in legs:
        if leg[0] == "ride":
            own = net.of_trip[leg[1]]
            first, last = own[leg[2]], own[leg[3]]
            start, end, begin, to = net.dep[first], net.arr[last], net.dep_station[first], net.arr_station[last]
            gtfs, day, offset, route, headsign = trips[net.trip_ids[leg[1]]]
            stops, seen = calls[net.trip_ids[leg[1]]], []
            for i in own[leg[2] : leg[3] + 1]:
                for s, ok in ((net.dep_station[i], net.visit_dep[i] and i == first), (net.arr_station[i], net.visit_arr[i])):
                    if ok and (not seen or seen[-1] != stations[s]):
                        seen.append(stations[s])
            row = {"type": "ride", "trip_id": gtfs, "service_date": day, "route": route, "headsign": headsign, "board_stop_id": stops[leg[2]], "board_time": clock(start - offset), "alight_stop_id": stops[leg[3] + 1], "alight_time": clock(end - offset), "stations": seen}
            rides += 1
        else:
            _, begin, to, start, end, m = leg
            metres += m
            row = {"type": "walk", "from_station": stations[begin], "to_station": stations[to], "start": clock(start), "end": clock(end), "metres": _half_up(m, 1), "walking_speed_kmh": rules.walking_speed_kmh}
        if now is not None and start > now:
            out.append({"type": "wait", "station": stations[here], "start": clock(now), "end": clock(start)})
        out.append(row)
        now, here = end, to
    first, last = duration(net, legs) or (0, 0)
    total = last - first
    return json.dumps({
        "schema": schema,
        "feed": feed,
        "timezone": zone,
        "date": rules.date,
        "rules": asdict(rules),
        "targets": [stations[t] for t in net.targets],
        "legs": out,
        "summary": {"first_visit": clock(first), "last_visit": clock(last), "duration_s": total, "stations_visited": len(visits(net, legs)), "transfers": max(0, rides - 1), "walk_m": _half_up(metres, 1)},
        "lower_bound_s": bound,
        "gap": _half_up((total - bound) / bound, 4) if bound else None,
    })
