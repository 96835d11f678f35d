"""Seeded networks and feeds for tests and benchmarks."""

from __future__ import annotations

import io
import random
import zipfile

from pyspark.sql import SparkSession

from .operators.network import Network
from .plans.kernel import Bundle


def random_bundle(seed: int, stations: int = 6, lines: int = 3, trips: int = 4, window: tuple[int, int] = (0, 7200)) -> Bundle:
    """A small network: metro and connector lines, walks, flags, some instant hops."""
    rng = random.Random(seed)
    n = rng.randint(3, stations)
    hops = []
    trip = 0
    for _ in range(rng.randint(1, lines)):
        visits, route = rng.random() < 0.7, [rng.randrange(n) for _ in range(rng.randint(2, 5))]
        for _ in range(rng.randint(1, trips)):
            t = rng.randint(0, 5400)
            seen = [visits and rng.random() < 0.95 for _ in route]
            for p in range(len(route) - 1):
                dep = t + (rng.randint(0, 30) if p else 0)
                arr = dep + (0 if rng.random() < 0.1 else rng.randint(30, 400))
                hops.append((dep, arr, trip, p, route[p], route[p + 1], rng.random() < 0.95, rng.random() < 0.95, seen[p], seen[p + 1]))
                t = arr
            trip += 1
    hops.sort(key=lambda h: h[:4])
    links: dict[int, list[tuple[int, int, float]]] = {}
    for _ in range(rng.randint(0, 4)):
        a, b = rng.sample(range(n), 2)
        w = rng.randint(60, 600)
        for x, y in ((a, b), (b, a)):
            if all(to != y for to, *_ in links.get(x, [])):
                links.setdefault(x, []).append((y, w, w * 1.2))
    cols = list(zip(*hops, strict=True))
    dep, arr, trips_, pos, a, b, pick, drop, vd, va = (list(c) for c in cols)
    return Bundle(a, b, dep, arr, trips_, pos, pick, drop, vd, va, links, {s: rng.randint(1, 150) for s in range(n)}, sorted(rng.sample(range(n), rng.randint(1, min(4, n)))), window, list(range(trip)))


def as_network(spark: SparkSession, net: Bundle, prefix: int = 0) -> Network:
    """The DataFrames of a bundle; stations and trips are shifted by prefix * 1000."""
    k = prefix * 1000
    hops = [(net.trip[i] + k, net.pos[i], net.dep_station[i] + k, net.arr_station[i] + k, net.dep[i], net.arr[i], net.pickup[i], net.drop_off[i], net.visit_dep[i], net.visit_arr[i]) for i in range(len(net.dep))]
    rows = spark.createDataFrame(hops, "trip_id int, pos int, dep_station int, arr_station int, dep int, arr int, pickup boolean, drop_off boolean, visit_dep boolean, visit_arr boolean")
    links = spark.createDataFrame([(s + k, to + k, w, m) for s, out in net.links.items() for to, w, m in out], "from int, to int, duration int, metres double")
    change = spark.createDataFrame([(s + k, c) for s, c in net.change.items()], "station int, seconds int")
    targets = spark.createDataFrame([(t + k,) for t in net.targets], "station int")
    return Network(rows, links, change, targets, net.window, spark.createDataFrame([(0, 0)], "trips_backwards int, trips_too_long int"))


def feed_zip(seed: int, targets: int = 6) -> bytes:
    """A feed: a metro trunk with a branch and a bus between its ends, at seeded headways."""
    rng = random.Random(seed)
    names = [f"Station {i}" for i in range(targets)]
    lat, lon = 48.1, 11.5
    stops = ["stop_id,stop_name,stop_lat,stop_lon,location_type,parent_station"]
    for i, n in enumerate(names):
        lat, lon = lat + rng.uniform(0.004, 0.01), lon + rng.uniform(-0.004, 0.008)
        stops += [f"S{i},{n},{lat:.5f},{lon:.5f},1,", f"P{i},{n},{lat:.5f},{lon:.5f},0,S{i}"]
    routes = ["route_id,agency_id,route_short_name,route_type", "U1,A,U1,1", "U2,A,U2,1", "B,A,B,3"]
    half = max(2, targets // 2)
    lines = {"U1": list(range(targets)), "U2": [*range(half), targets - 1], "B": [0, targets - 1]}
    trips, times = ["route_id,service_id,trip_id"], ["trip_id,arrival_time,departure_time,stop_id,stop_sequence"]
    clock = lambda s: f"{s // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d}"
    for route, line in lines.items():
        for way in (line, line[::-1]):
            t = 5 * 3600 + rng.randint(0, 600)
            while t < 20 * 3600:
                name = f"{route}-{len(trips)}"
                trips.append(f"{route},WD,{name}")
                at = t
                for k, s in enumerate(way):
                    times.append(f"{name},{clock(at)},{clock(at + (30 if 0 < k < len(way) - 1 else 0))},P{s},{k + 1}")
                    at += rng.randint(90, 240)
                t += 60 * rng.randint(5, 20)
    files = {
        "agency.txt": ["agency_id,agency_name,agency_url,agency_timezone", "A,Agency,https://example.org,Europe/Berlin"],
        "stops.txt": stops,
        "routes.txt": routes,
        "trips.txt": trips,
        "stop_times.txt": times,
        "calendar.txt": ["service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date", "WD,1,1,1,1,1,0,0,20261001,20261213"],
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, rows in files.items():
            z.writestr(zipfile.ZipInfo(name), "\n".join(rows) + "\n")
    return out.getvalue()
