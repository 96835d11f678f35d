"""Stops into stations."""

from __future__ import annotations

import tomllib
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import OverrideError
from ..frames import components, written
from ..functions.geo import METRES_PER_DEGREE, cell, haversine, lon_cell, neighbours
from ..functions.names import dhid_prefix, normalise_name

LEVELS = 8
SAME_NAME_M = 300.0
FAR_NAMESAKE_M = 1000.0
NEAR_STRANGER_M = 50.0
SAMPLES = 1000


def parent_roots(stops: DataFrame) -> DataFrame:
    """(stop_id, root, depth): the topmost parent within `LEVELS` levels.

    A stop that is its own parent, or whose parent is unknown, is a root.
    """
    known = stops.select(F.col("stop_id").alias("known"))
    up = stops.filter("parent_station is not null and parent_station <> '' and parent_station <> stop_id").join(known, F.col("parent_station") == F.col("known"), "left_semi").select(F.col("stop_id").alias("child"), F.col("parent_station").alias("parent"))
    rows = stops.select("stop_id", F.col("stop_id").alias("root"), F.lit(0).alias("depth"))
    for _ in range(LEVELS):
        step = rows.join(up, (F.col("root") == F.col("child")) & (F.col("parent") != F.col("stop_id")), "left")
        rows = step.select("stop_id", F.coalesce("parent", "root").alias("root"), (F.col("depth") + F.when(F.col("parent").isNotNull(), 1).otherwise(0)).alias("depth"))
    return rows


def same_name_pairs(places: DataFrame, metres: float = SAME_NAME_M) -> DataFrame:
    """(a, b), a < b: places(idx, key, lat, lon) of one key within `metres`.

    Cells as wide as the reach keep a name that many places share from meeting
    itself everywhere.
    """
    size = metres / METRES_PER_DEGREE * 1.01
    rows = places.filter("lat is not null and lon is not null and key <> ''")
    a = rows.select(F.col("idx").alias("a"), "key", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), neighbours(cell(F.col("lat"), size)).alias("row"))
    b = rows.select(F.col("idx").alias("b"), "key", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), cell(F.col("lat"), size).alias("row"))
    a = a.withColumn("column", neighbours(lon_cell(F.col("lon1"), F.col("row"), size)))
    b = b.withColumn("column", lon_cell(F.col("lon2"), F.col("row"), size))
    near = a.join(b, ["key", "row", "column"]).filter("a < b").filter(haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")) <= metres)
    return near.select("a", "b")


def cluster(stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stations, stop_station) of stops(stop_idx, stop_id, stop_name, stop_lat, stop_lon, location_type, parent_station).

    Merged are: stops under one root, roots of one DHID station, and roots without
    DHID that share a name within reach.  Stations are numbered by their lowest stop;
    the anchor is the first station row, else platform, else member; reason says why
    a member belongs (parent, dhid, name; null for the anchor's own root).
    """
    roots = parent_roots(stops)
    of_root = stops.select(F.col("stop_id").alias("root"), F.col("stop_idx").alias("root_idx"), F.col("stop_name").alias("root_name"), F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"))
    full = written(stops.join(roots, "stop_id").join(of_root, "root"))
    tops = full.filter("stop_id = root").select("root", "root_idx", "root_name", "lat", "lon", dhid_prefix(F.col("root")).alias("dhid"))
    by_dhid = tops.filter("dhid is not null").select(F.col("root_idx").alias("a"), F.min("root_idx").over(Window.partitionBy("dhid")).alias("b"))
    by_name = same_name_pairs(tops.filter("dhid is null").select(F.col("root_idx").alias("idx"), normalise_name(F.col("root_name")).alias("key"), "lat", "lon"))
    joined = components(by_dhid.filter("a <> b").union(by_name))
    joined = joined.select("node", F.col("root").alias("lowest"))
    label = full.join(joined, F.col("root_idx") == F.col("node"), "left")
    label = label.select("stop_id", "stop_idx", "stop_name", "stop_lat", "stop_lon", "location_type", F.col("root").alias("root_id"), "root_idx", F.coalesce("lowest", "root_idx").alias("top"))
    label = label.withColumn("low", F.min("stop_idx").over(Window.partitionBy("top")))
    kind = F.when(F.col("location_type") == 1, 0).when(F.col("location_type") == 0, 1).otherwise(2)
    anchors = label.groupBy("low").agg(F.min_by(F.struct("stop_id", "stop_name", "stop_lat", "stop_lon"), F.struct(kind, "stop_idx")).alias("anchor"), F.avg("stop_lat").alias("mean_lat"), F.avg("stop_lon").alias("mean_lon"), F.count("*").alias("members"))
    number = F.row_number().over(Window.orderBy("low")) - 1
    has = F.col("anchor.stop_lat").isNotNull()
    stations = anchors.select(number.cast("int").alias("station"), F.coalesce(dhid_prefix(F.col("anchor.stop_id")), F.col("anchor.stop_id")).alias("station_id"), F.col("anchor.stop_name").alias("name"), F.when(has, F.col("anchor.stop_lat")).otherwise(F.col("mean_lat")).alias("lat"), F.when(has, F.col("anchor.stop_lon")).otherwise(F.col("mean_lon")).alias("lon"), "members", "low")
    reason = F.when(F.col("stop_id") != F.col("root_id"), "parent").when(F.col("root_idx") == F.col("top"), F.lit(None)).when(dhid_prefix(F.col("root_id")).isNotNull(), "dhid").otherwise("name")
    return stations.drop("low"), label.join(stations.select("low", "station"), "low").select("stop_id", "station", reason.alias("reason"))


def ambiguous_pairs(stations: DataFrame, samples: int = SAMPLES) -> tuple[DataFrame, DataFrame]:
    """(counts, samples) of namesakes far apart and of strangers close by."""
    rows = stations.filter("lat is not null and lon is not null").select("station", "station_id", normalise_name(F.col("name")).alias("key"), "lat", "lon")
    a = rows.select(F.col("station").alias("a"), F.col("station_id").alias("a_id"), F.col("key").alias("a_key"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = rows.select(F.col("station").alias("b"), F.col("station_id").alias("b_id"), F.col("key").alias("b_key"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    d = haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    far = a.join(b, F.col("a_key") == F.col("b_key")).filter("a < b").withColumn("metres", d).filter(F.col("metres") > FAR_NAMESAKE_M).withColumn("kind", F.lit("same name far apart"))
    size = NEAR_STRANGER_M / METRES_PER_DEGREE * 1.01
    west = a.withColumn("row", neighbours(cell(F.col("lat1"), size))).withColumn("column", neighbours(lon_cell(F.col("lon1"), F.col("row"), size)))
    east = b.withColumn("row", cell(F.col("lat2"), size)).withColumn("column", lon_cell(F.col("lon2"), F.col("row"), size))
    near = west.join(east, ["row", "column"]).filter("a < b and a_key <> b_key").withColumn("metres", d).filter(F.col("metres") < NEAR_STRANGER_M).withColumn("kind", F.lit("different names close"))
    cols = ["kind", "a_id", "b_id", "metres"]
    found = far.select(*cols).unionByName(near.select(*cols))
    return found.groupBy("kind").count(), found.orderBy("kind", "a_id", "b_id").limit(samples)


def read_overrides(text: str) -> dict:
    data = tomllib.loads(text)
    keys = {"split": {"stops", "id", "name", "reason"}, "merge": {"stations", "reason"}, "rename": {"station", "name", "reason"}}
    bad = [k for k in data if k not in keys] + [f"{k}.{x}" for k, rows in data.items() if k in keys for r in rows for x in r if x not in keys[k]]
    if bad:
        raise OverrideError("\n".join(f"{k}: unknown key" for k in sorted(bad)))
    return data


def apply_overrides(stations: list[dict], overrides: dict) -> list[dict]:
    """Station rows (id, name, members, in order) after all splits, merges and renames.

    The station table of one feed is small; this runs on the driver.
    """
    out = [dict(s, members=list(s["members"])) for s in stations]

    def find(station_id: str) -> int:
        for i, s in enumerate(out):
            if s["id"] == station_id:
                return i
        raise OverrideError(f"unknown station {station_id!r}")

    for r in overrides.get("split", []):
        stops = list(r["stops"])
        if not stops:
            raise OverrideError("a split names no stops")
        home = {i for i, s in enumerate(out) for m in s["members"] if m in stops}
        missing = set(stops) - {m for s in out for m in s["members"]}
        if missing:
            raise OverrideError(f"unknown stop {sorted(missing)[0]!r}")
        if len(home) > 1:
            raise OverrideError("a split names stops of several stations")
        i = home.pop()
        if set(out[i]["members"]) <= set(stops):
            raise OverrideError("a split would leave no stops behind")
        if any(s["id"] == r.get("id", stops[0]) for s in out):
            raise OverrideError(f"station {r.get('id', stops[0])!r} exists")
        moved = [m for m in out[i]["members"] if m in stops]
        out[i]["members"] = [m for m in out[i]["members"] if m not in stops]
        out.insert(i + 1, {"id": r.get("id", stops[0]), "name": r.get("name", out[i]["name"]), "members": moved})
    for r in overrides.get("merge", []):
        ids: Iterable[str] = r["stations"]
        at = sorted({find(x) for x in ids})
        if len(at) < 2:
            raise OverrideError("a merge needs two stations")
        first = find(r["stations"][0])
        for i in at:
            if i != first:
                out[first]["members"] += out[i]["members"]
        out = [s for i, s in enumerate(out) if i == first or i not in at]
    for r in overrides.get("rename", []):
        out[find(r["station"])]["name"] = r["name"]
    return out
