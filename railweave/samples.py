"""A small harbour-tram network, an itinerary over it, and changes that each break it.

Used by the registered verifier queries and by tests.
"""

from __future__ import annotations

import copy
import io
import zipfile

from .verify.verifier import SCHEMA

ZONE, DAY, OTHER_DAY = "Europe/Lisbon", "2027-03-17", "2027-03-20"
TARGETS = ["castle", "market", "quay", "ridge", "tower"]

#: station, name, lat, lon; platforms are station/1 and so on.
PLACES = [("quay", "Quay", 38.7000, -9.1500), ("market", "Market", 38.7062, -9.1500), ("castle", "Castle", 38.7131, -9.1480), ("ridge", "Ridge", 38.7155, -9.1480), ("tower", "Tower", 38.7240, -9.1440), ("isle", "Isle", None, None)]
PLATFORMS = [("quay/1", "quay"), ("market/1", "market"), ("castle/1", "castle"), ("castle/2", "castle"), ("ridge/1", "ridge"), ("tower/1", "tower"), ("isle/1", "isle")]
ROUTES = [("12E", 0), ("28E", 0), ("737", 3), ("boat", 4)]
#: trip, service, route, is_template.
TRIPS = [("up", "week", "12E", False), ("hop", "week", "12E", False), ("dash", "week", "12E", False), ("over", "week", "28E", False), ("closed", "week", "28E", False), ("sail", "week", "boat", False), ("fair", "sat", "28E", False), ("model", "week", "28E", True), ("on", "week", "28E", False)]
#: trip, seq, platform, arrival, departure, pickup_type, drop_off_type.
CALLS = [
    ("up", 10, "quay/1", 32400, 32400, 0, 1), ("up", 20, "market/1", 32820, 32850, 0, 0), ("up", 30, "castle/1", 33300, 33300, 1, 0),
    ("hop", 1, "castle/2", 34200, 34200, 0, 1), ("hop", 2, "ridge/1", 34500, 34500, 1, 0),
    ("dash", 1, "castle/1", 33340, 33340, 0, 1), ("dash", 2, "ridge/1", 33700, 33700, 1, 0),
    ("over", 5, "ridge/1", 34800, 34800, 0, 1), ("over", 6, "tower/1", 35280, 35280, 1, 0),
    ("closed", 5, "ridge/1", 34800, 34800, 1, 1), ("closed", 6, "tower/1", 35280, 35280, 1, 0),
    ("sail", 5, "ridge/1", 34800, 34800, 0, 0), ("sail", 6, "tower/1", 35280, 35280, 0, 0),
    ("fair", 5, "ridge/1", 34800, 34800, 0, 0), ("fair", 6, "tower/1", 35280, 35280, 0, 1),
    ("model", 5, "ridge/1", 34800, 34800, 0, 0), ("model", 6, "tower/1", 35280, 35280, 0, 0),
    ("on", 1, "ridge/1", 34500, 34800, 0, 0), ("on", 2, "tower/1", 35280, 35280, 1, 0),
]
RUNS = [("week", DAY), ("sat", OTHER_DAY)]
#: from, to, transfer_type, min_transfer_time.
TRANSFERS = [("castle/1", "castle/2", 3, None), ("ridge/1", "ridge/1", 2, 90)]
#: trip, next_trip on DAY.
SEATS = [("hop", "on")]
#: entry, from, to, seconds, forbid, both.
WALKS = [(1, "castle", "ridge", 300, False, True), (2, "castle", "market", None, True, True)]


def _ride(trip: str, board: str, at: str, alight: str, end: str, stations: list[str], **more) -> dict:
    return {"type": "ride", "trip_id": trip, "service_date": DAY, "route": "", "headsign": "", "board_stop_id": board, "board_time": at, "alight_stop_id": alight, "alight_time": end, "stations": stations, **more}


UP = _ride("up", "quay/1", "09:00:00", "castle/1", "09:15:00", ["quay", "market", "castle"])
WALK = {"type": "walk", "from_station": "castle", "to_station": "ridge", "start": "09:17:00", "end": "09:25:00", "metres": 266.9, "walking_speed_kmh": 4.0}
WAIT = {"type": "wait", "station": "ridge", "start": "09:25:00", "end": "09:40:00"}
OVER = _ride("over", "ridge/1", "09:40:00", "tower/1", "09:48:00", ["ridge", "tower"])
HOP = _ride("hop", "castle/2", "09:30:00", "ridge/1", "09:35:00", ["castle", "ridge"])
RULES = {"mode": "stops", "selection": "harbour.toml", "date": DAY, "earliest_start": "05:00", "latest_end": "25:00", "start": "any", "end": "any", "allow_walking": True, "walking_speed_kmh": 4.0, "walk_detour_factor": 1.4, "max_walk_m": 900.0, "connector_modes": ["bus"], "min_transfer_s": {"same_station": 75, "walk_link": 150}, "tight_transfer_s": 150, "count_pass_through": False, "stay_aboard_through_terminus": False}
GOOD = {
    "schema": SCHEMA, "feed": {"id": "harbour", "sha256": "f00d", "feed_version": "", "attribution": "sample"}, "timezone": ZONE, "date": DAY, "rules": RULES, "targets": TARGETS,
    "legs": [UP, WALK, WAIT, OVER],
    "summary": {"first_visit": "09:00:00", "last_visit": "09:48:00", "duration_s": 2880, "stations_visited": 5, "transfers": 1, "walk_m": 266.9}, "lower_bound_s": None, "gap": None,
}


def _with(path: str, value) -> dict:
    """GOOD with one value changed; path in dots, legs by number."""
    it = copy.deepcopy(GOOD)
    x, keys = it, [int(k) if k.isdigit() else k for k in path.split(".")]
    for k in keys[:-1]:
        x = x[k]
    x[keys[-1]] = value
    return it


#: name, itinerary, codes.
CASES = [
    ("good", GOOD, set()),
    ("other schema", _with("schema", "else/1"), {"SCHEMA"}),
    ("other zone", _with("timezone", "UTC"), {"TIMEZONE_MISMATCH"}),
    ("no such day", _with("date", "2027-02-30"), {"BAD_DATE"}),
    ("other feed", _with("feed.sha256", "beef"), {"FEED_MISMATCH"}),
    ("standing still", _with("rules.walking_speed_kmh", 0.0), {"BAD_RULES"}),
    ("short cut", _with("rules.walk_detour_factor", 0.5), {"BAD_RULES"}),
    ("below nothing", _with("rules.max_walk_m", -1.0), {"BAD_RULES", "WALK_TOO_LONG"}),
    ("by camel", _with("rules.connector_modes", ["camel"]), {"BAD_RULES"}),
    ("ghost trip", _with("legs.3.trip_id", "ghost"), {"TRIP_UNKNOWN", "MISSING_TARGET"}),
    ("template", _with("legs.3.trip_id", "model"), {"TRIP_NOT_RUN", "MISSING_TARGET"}),
    ("leg without day", _with("legs.3.service_date", "soon"), {"BAD_DATE", "MISSING_TARGET"}),
    ("saturday", _with("legs.3.service_date", OTHER_DAY), {"SERVICE_NOT_RUNNING", "SUMMARY_MISMATCH", "OUTSIDE_WINDOW"}),
    ("weekend trip", _with("legs.3.trip_id", "fair"), {"SERVICE_NOT_RUNNING", "DROP_OFF_NOT_ALLOWED"}),
    ("by boat", _with("legs.3", {**OVER, "trip_id": "sail", "stations": []}), {"MODE_NOT_ALLOWED", "MISSING_TARGET"}),
    ("late boarding", _with("legs.3.board_time", "09:41:00"), {"BOARD_STOP_NOT_ON_TRIP", "MISSING_TARGET"}),
    ("late alighting", _with("legs.3.alight_time", "09:49:00"), {"ALIGHT_STOP_NOT_ON_TRIP", "MISSING_TARGET"}),
    ("no time", _with("legs.3.board_time", "noonish"), {"BAD_TIME", "MISSING_TARGET"}),
    ("no pickup", _with("legs.3", {**OVER, "trip_id": "closed", "stations": []}), {"PICKUP_NOT_ALLOWED", "MISSING_TARGET"}),  # a call without pickup and drop-off is passed through
    ("jump", _with("legs.1.from_station", "market"), {"NOT_CONTIGUOUS", "WALK_TOO_LONG", "WALK_TOO_FAST"}),
    ("early walk", _with("legs.1.start", "09:14:00"), {"TIME_TRAVEL"}),
    ("wait back", _with("legs.2.end", "09:24:00"), {"TIME_TRAVEL"}),
    ("barred change", _with("legs", [UP, HOP, OVER]), {"FORBIDDEN_TRANSFER"}),
    ("rush", _with("legs", [UP, {**_ride("dash", "castle/1", "09:15:40", "ridge/1", "09:21:40", ["castle", "ridge"])}, OVER]), {"TRANSFER_TOO_SHORT"}),
    ("other stations", _with("legs.3.stations", ["tower", "ridge"]), {"STATIONS_MISMATCH"}),
    ("on foot", _with("rules.allow_walking", False), {"WALK_NOT_ALLOWED"}),
    ("to nowhere", _with("legs.1.to_station", "moon"), {"UNKNOWN_STATION"}),
    ("two walks", _with("legs", [UP, {**WALK, "end": "09:25:00"}, {**WALK, "from_station": "ridge", "start": "09:25:00", "end": "09:30:00"}, OVER]), {"WALK_CHAINED", "WALK_SAME_STATION"}),
    ("to the isle", _with("legs.1.to_station", "isle"), {"WALK_UNMEASURABLE", "NOT_CONTIGUOUS"}),
    ("short legs", _with("rules.max_walk_m", 100.0), {"WALK_TOO_LONG"}),
    ("sprint", _with("legs.1.end", "09:19:00"), {"WALK_TOO_FAST"}),
    ("barred walk", _with("legs", [UP, {**WALK, "to_station": "market", "end": "09:36:00"}]), {"WALK_FORBIDDEN", "MISSING_TARGET"}),
    ("half way", _with("legs", [UP]), {"MISSING_TARGET"}),
    ("other targets", _with("targets", ["quay", "tower"]), {"TARGETS_MISMATCH"}),
    ("too early", _with("rules.earliest_start", "09:01"), {"OUTSIDE_WINDOW"}),
    ("from market", _with("rules.start", "market"), {"START_MISMATCH"}),
    ("to market", _with("rules.end", "market"), {"END_MISMATCH"}),
    ("wrong sum", _with("summary.duration_s", 7), {"SUMMARY_MISMATCH"}),
    ("kept seat", _with("legs.3.stay_aboard", True), {"STAY_ABOARD_NOT_ALLOWED", "NOT_A_CONTINUATION"}),
]


def sample_feed() -> dict[str, str]:
    """The network as GTFS texts."""
    hms = lambda s: f"{s // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d}"
    csv = lambda head, rows: "\n".join([head, *(",".join("" if v is None else str(v) for v in r) for r in rows)]) + "\n"
    names = {p[0]: p for p in PLACES}
    return {
        "agency.txt": csv("agency_id,agency_name,agency_url,agency_timezone", [("HT", "Harbour Trams", "https://trams.example", ZONE)]),
        "stops.txt": csv("stop_id,stop_name,stop_lat,stop_lon,location_type,parent_station", [(*p, 1, None) for p in PLACES] + [(k, names[s][1], *names[s][2:], 0, s) for k, s in PLATFORMS]),
        "routes.txt": csv("route_id,agency_id,route_short_name,route_type", [(r, "HT", r, k) for r, k in ROUTES]),
        "trips.txt": csv("route_id,service_id,trip_id", [(r, s, t) for t, s, r, _ in TRIPS]),
        "stop_times.txt": csv("trip_id,arrival_time,departure_time,stop_id,stop_sequence,pickup_type,drop_off_type", [(t, hms(a), hms(d), p, q, u, o) for t, q, p, a, d, u, o in CALLS]),
        "calendar_dates.txt": csv("service_id,date,exception_type", [(s, d.replace("-", ""), 1) for s, d in RUNS]),
        "transfers.txt": csv("from_stop_id,to_stop_id,transfer_type,min_transfer_time", TRANSFERS),
    }


def feed_zip(files: dict[str, str | None], folder: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            if text is not None:
                z.writestr(folder + name, text)
    return out.getvalue()
