"""Registered queries and the SQL that must give the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lens
from .frames import written
from .functions import clock, geo, names
from .operators import calendar as cal
from .operators import chains as ch
from .operators import network as nw
from .operators import selection as sel
from .operators import stations as st
from .plans import legs as lg
from .plans import rounds
from .rules import MODES, Include, Rules, Selection

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


class Fixture:
    """A small table for both engines."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows

    def frame(self, spark: SparkSession) -> DataFrame:
        text = ", ".join(c.replace(" date", " string") for c in self.schema.split(", "))
        df = spark.createDataFrame(self.rows, text)
        for c in self.schema.split(", "):
            if c.endswith(" date"):
                df = df.withColumn(c.split()[0], F.to_date(c.split()[0]))
        return df

    def sql(self, name: str) -> str:
        kinds = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}
        cols = [c.split() for c in self.schema.split(", ")]
        lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
        body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in self.rows)
        casts = ", ".join(f'CAST("{n}" AS {kinds[k]}) AS "{n}"' for n, k in cols)
        return f"{name} AS (SELECT {casts} FROM (VALUES {body}) v({', '.join(f'"{n}"' for n, _ in cols)}))"


RULES = Rules(date=lens.PLAN_DATE)
START, END = RULES.window
VISITS = [(1, 1)]
ORIGIN_TIME = 6 * 3600
HAVERSINE_SQL = "2 * 6371008.8::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


# ---- scalar functions -------------------------------------------------------

TIMES = Fixture("raw string", [("08:00:00",), (" 8:00:00 ",), ("24:05:30",), ("168:00:00",), ("168:00:01",), ("7:60:00",), ("07:5:00",), ("",), (None,), ("-1:00:00",), ("123:45:59",), ("1234:00:00",), ("ab:cd:ef",)])
_PARSE_SQL = "CASE WHEN regexp_full_match(trim({c}), '[0-9]{{1,3}}:[0-5][0-9]:[0-5][0-9]') AND split_part(trim({c}), ':', 1)::INTEGER * 3600 + split_part(trim({c}), ':', 2)::INTEGER * 60 + split_part(trim({c}), ':', 3)::INTEGER <= 604800 THEN split_part(trim({c}), ':', 1)::INTEGER * 3600 + split_part(trim({c}), ':', 2)::INTEGER * 60 + split_part(trim({c}), ':', 3)::INTEGER END"


@query(f"WITH {TIMES.sql('t')} SELECT raw, CAST({_PARSE_SQL.format(c='raw')} AS INTEGER) AS seconds FROM t")
def clock_parse(spark, sf_dir):
    return TIMES.frame(spark).select("raw", clock.parse_time(F.col("raw")).alias("seconds"))


@query(f"WITH {lens.CALLS_SQL} SELECT trip_id, seq, (CASE WHEN departure - 43200 < 0 THEN '-' ELSE '' END) || printf('%02d:%02d:%02d', abs(departure - 43200) // 3600, (abs(departure - 43200) % 3600) // 60, abs(departure - 43200) % 60) AS shown FROM lens_calls")
def clock_format(spark, sf_dir):
    """Times relative to noon, so that some are negative."""
    return lens.calls(spark, sf_dir, None).select("trip_id", "seq", clock.format_time(F.col("departure") - 43200).alias("shown"))


DATES = Fixture("raw string", [("20261112",), ("20260230",), ("2026111",), ("2026-11-12",), ("00010101",), ("abcdefgh",), (None,), ("20240229",)])


@query(f"WITH {DATES.sql('t')} SELECT raw, CASE WHEN regexp_full_match(raw, '[0-9]{{8}}') THEN CAST(try_strptime(raw, '%Y%m%d') AS DATE) END AS day FROM t")
def gtfs_date_parse(spark, sf_dir):
    return DATES.frame(spark).select("raw", clock.parse_date(F.col("raw")).alias("day"))


_MODE_ROWS = [(m, a, b) for m, rs in MODES.items() for a, b in rs]
MODE_TABLE = Fixture("mode string, low int, high int", _MODE_ROWS)
_TYPES = Fixture("route_type int", [(t,) for t in (0, 1, 2, 3, 4, 5, 6, 7, 11, 100, 199, 200, 299, 300, 400, 499, 500, 700, 799, 900, 999, 1000, 1300, 1400)])


@query(f"WITH {MODE_TABLE.sql('m')}, {_TYPES.sql('t')} SELECT route_type, mode FROM t JOIN m ON route_type BETWEEN low AND high")
def mode_ranges(spark, sf_dir):
    parts = [_TYPES.frame(spark).filter(names.in_ranges(F.col("route_type"), list(r))).select("route_type", F.lit(m).alias("mode")) for m, r in MODES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


GLOBS = Fixture("name string", [("U1",), ("U10",), ("u1",), ("S1",), ("U",), ("X.U1",), ("",), ("U1\n2",)])


@query(f"WITH {GLOBS.sql('t')} SELECT name, regexp_full_match(name, 'U.', 's') AS one, regexp_full_match(name, 'U.*', 's') AS many, regexp_full_match(name, 'X\\.U1') AS dotted FROM t".replace("'U1\n2'", "'U1' || chr(10) || '2'"))
def glob_filter(spark, sf_dir):
    return GLOBS.frame(spark).select("name", names.matches_glob(F.col("name"), "U?").alias("one"), names.matches_glob(F.col("name"), "U*").alias("many"), names.matches_glob(F.col("name"), "X.U1").alias("dotted"))


IDS = Fixture("stop_id string", [("de:09162:6:1:1",), ("de:09162:6",), ("de:09162:",), ("de:9162:6",), ("DE:09162:6",), ("at:12345:ab:c",), ("x",), ("",)])


@query(f"WITH {IDS.sql('t')} SELECT stop_id, CASE WHEN regexp_matches(stop_id, '^[a-z]{{2}}:[0-9]{{5}}:[^:]+') THEN regexp_extract(stop_id, '^[a-z]{{2}}:[0-9]{{5}}:[^:]+') END AS station, regexp_matches(stop_id, '^[a-z]{{2}}:[0-9]{{5}}:') AS dhid FROM t")
def dhid_prefix(spark, sf_dir):
    return IDS.frame(spark).select("stop_id", names.dhid_prefix(F.col("stop_id")).alias("station"), names.is_dhid(F.col("stop_id")).alias("dhid"))


NAMES = Fixture("name string", [("Münchner Freiheit",), ("Muenchner-Freiheit",), ("Straße 9 (Süd)",), ("",), ("Ärzte/Öl",), ("Île d'Été",)])


@query(f"WITH {NAMES.sql('t')} SELECT name, regexp_replace(replace(replace(replace(replace(lower(name), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS key FROM t")
def name_normalise(spark, sf_dir):
    return NAMES.frame(spark).select("name", names.normalise_name(F.col("name")).alias("key"))


@query(f"WITH {lens.STATIONS_SQL} SELECT a.station AS a, b.station AS b, round({HAVERSINE_SQL.format(a='a', b='b')}, 6) AS metres FROM lens_stations a JOIN lens_stations b ON b.station = (a.station * 7 + 3) % 20")
def haversine_pairs(spark, sf_dir):
    s = lens.stations(spark)
    a = s.select(F.col("station").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.pmod(F.col("station") * 7 + 3, F.lit(20)).alias("b"))
    b = s.select(F.col("station").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.join(b, "b").select("a", "b", F.round(geo.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), 6).alias("metres"))


METRES = Fixture("metres double", [(0.0,), (1.0,), (99.5,), (600.0,), (1112.0,), (1200.0,)])


@query(f"WITH {METRES.sql('t')} SELECT metres, greatest(120, CAST(ceil(metres * 1.3::DOUBLE / {4.5 / 3.6!r}::DOUBLE) AS INTEGER)) AS seconds FROM t")
def walk_duration(spark, sf_dir):
    return METRES.frame(spark).select("metres", geo.walk_duration(F.col("metres"), 1.3, 4.5, 120).alias("seconds"))


# ---- calls and hops ----------------------------------------------------------


@query(f"WITH {lens.CALLS_SQL} SELECT trip_id, service_date, route_id, route_type, block_id, stop_id, station, arrival, departure, pickup_type, drop_off_type, seq FROM lens_calls")
def lens_stop_times(spark, sf_dir):
    return lens.calls(spark, sf_dir, None)


@query(f"WITH {lens.CALLS_SQL} SELECT trip_id, min(service_date) AS service_date, min(route_id) AS route_id, min(route_type) AS route_type, min(block_id) AS block_id, count(*) AS calls, arg_min(departure, seq) AS first_dep, arg_max(arrival, seq) AS last_arr FROM lens_calls GROUP BY trip_id")
def lens_trips(spark, sf_dir):
    c = lens.calls(spark, sf_dir, None)
    return c.groupBy("trip_id").agg(*(F.min(x).alias(x) for x in ("service_date", "route_id", "route_type", "block_id")), F.count("*").alias("calls"), F.min_by("departure", "seq").alias("first_dep"), F.max_by("arrival", "seq").alias("last_arr"))


HOPS_SQL = """
{out} AS (
    SELECT * FROM (
        SELECT trip_id, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, station AS dep_station, lead(station) OVER w AS arr_station,
               departure AS dep, greatest(lead(arrival) OVER w, departure) AS arr, pickup_type <> 1 AS pickup, lead(drop_off_type) OVER w <> 1 AS drop_off,
               {seen} AS visit_dep, lead({seen}) OVER w AS visit_arr, route_type
        FROM {calls} WINDOW w AS (PARTITION BY trip_id ORDER BY seq)
    ) WHERE arr_station IS NOT NULL
)"""
_SEEN = "(NOT (pickup_type = 1 AND drop_off_type = 1) AND route_type = 1)"


@query(f"WITH {lens.CALLS_SQL}, {HOPS_SQL.format(out='h', calls='lens_calls', seen='(NOT (pickup_type = 1 AND drop_off_type = 1))')} SELECT * FROM h")
def lens_hops(spark, sf_dir):
    return nw.hops(lens.calls(spark, sf_dir, None), ["route_type"])


@query(f"WITH {lens.FREIGHT_SQL} SELECT trip_id, pos, dep_station, arr_station, dep, arr FROM (SELECT trip_id, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, station AS dep_station, lead(station) OVER w AS arr_station, departure AS dep, greatest(lead(arrival) OVER w, departure) AS arr FROM freight_calls WINDOW w AS (PARTITION BY trip_id ORDER BY seq)) WHERE arr_station IS NOT NULL")
def freight_hops(spark, sf_dir):
    return nw.hops(lens.freight_calls(spark, sf_dir))


@query(f"WITH {lens.FREIGHT_SQL}, h AS (SELECT station AS a, lead(station) OVER w AS b, lead(arrival) OVER w - departure AS d FROM freight_calls WINDOW w AS (PARTITION BY trip_id ORDER BY seq)) SELECT a AS \"from\", b AS \"to\", min(d) AS seconds FROM h WHERE b IS NOT NULL AND a <> b GROUP BY a, b")
def freight_static_graph(spark, sf_dir):
    h = nw.hops(lens.freight_calls(spark, sf_dir))
    none = h.select(F.col("dep_station").alias("from"), F.col("arr_station").alias("to"), F.lit(1).alias("duration")).limit(0)
    return rounds.static_graph(h, none)


# ---- feed loading, on fixtures ----------------------------------------------

GAPS = Fixture("trip_id string, seq int, arrival int, departure int, dist double", [("A", 1, 28800, 28800, None), ("A", 2, None, None, None), ("A", 3, None, None, None), ("A", 4, 29340, 29400, None), ("B", 1, 100, 110, 0.0), ("B", 2, None, None, 1.0), ("B", 3, 510, 520, 4.0), ("C", 1, None, None, None), ("C", 2, 60, None, None), ("D", 1, 0, 0, 5.0), ("D", 2, None, None, 7.0), ("D", 3, 101, 101, 5.0)])
_GAPS_SQL = f"""WITH {GAPS.sql('t')}, one AS (SELECT trip_id, seq, coalesce(arrival, departure) AS arrival, coalesce(departure, arrival) AS departure, dist FROM t),
w AS (SELECT *, last_value(departure IGNORE NULLS) OVER b AS d0, first_value(arrival IGNORE NULLS) OVER a AS a1,
    last_value(CASE WHEN departure IS NOT NULL THEN seq END IGNORE NULLS) OVER b AS s0, first_value(CASE WHEN departure IS NOT NULL THEN seq END IGNORE NULLS) OVER a AS s1
    FROM one WINDOW b AS (PARTITION BY trip_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY trip_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
p AS (SELECT w.*, x.dist AS x0, y.dist AS x1 FROM w LEFT JOIN one x ON x.trip_id = w.trip_id AND x.seq = w.s0 LEFT JOIN one y ON y.trip_id = w.trip_id AND y.seq = w.s1),
f AS (SELECT *, CASE WHEN dist IS NOT NULL AND x0 IS NOT NULL AND x1 IS NOT NULL AND x1 > x0 THEN (dist - x0) / (x1 - x0) ELSE (seq - s0)::DOUBLE / (s1 - s0) END AS frac FROM p)
SELECT trip_id, seq, CAST(CASE WHEN arrival IS NOT NULL THEN arrival WHEN s0 IS NULL OR s1 IS NULL THEN 0 ELSE round(d0 + (a1 - d0) * least(1.0, greatest(0.0, frac))) END AS INTEGER) AS arrival,
       CAST(CASE WHEN departure IS NOT NULL THEN departure WHEN s0 IS NULL OR s1 IS NULL THEN 0 ELSE round(d0 + (a1 - d0) * least(1.0, greatest(0.0, frac))) END AS INTEGER) AS departure FROM f"""


@query(_GAPS_SQL)
def fill_missing_times(spark, sf_dir):
    from .sources.tables import complete_times

    return complete_times(GAPS.frame(spark)).select("trip_id", "seq", "arrival", "departure")


FREQ_CALLS = Fixture("trip_id string, seq int, stop_id string, arrival int, departure int", [("T1", 1, "S1a", 28740, 28800), ("T1", 2, "S2a", 29100, 29100), ("T2", 1, "S2a", 100, 200), ("T2", 2, "S1a", 400, 400)])
FREQ = Fixture("trip_id string, start int, end int, headway int", [("T1", 21600, 25200, 1200), ("T1", 25200, 26000, 400), ("T2", 50, 60, 30)])


@query(f"""WITH {FREQ_CALLS.sql('c')}, {FREQ.sql('f')}, runs AS (SELECT trip_id, unnest(range(start, "end", headway)) AS go FROM f),
s AS (SELECT r.trip_id, go, go - arg_min(departure, seq) AS shift FROM runs r JOIN c USING (trip_id) GROUP BY r.trip_id, go)
SELECT c.trip_id || '@' || printf('%02d:%02d:%02d', go // 3600, (go % 3600) // 60, go % 60) AS trip_id, seq, stop_id,
CAST(CASE WHEN arrival + shift < 0 AND seq = 1 THEN departure + shift ELSE arrival + shift END AS INTEGER) AS arrival, CAST(departure + shift AS INTEGER) AS departure FROM c JOIN s USING (trip_id)""")
def frequency_runs(spark, sf_dir):
    from .sources.tables import expand_frequencies

    return expand_frequencies(FREQ_CALLS.frame(spark), FREQ.frame(spark)).select("trip_id", "seq", "stop_id", "arrival", "departure")


FREQ_BAD = Fixture("trip_id string, start int, end int, headway int", [("A", 0, 100, 10), ("A", 90, 200, 10), ("B", 0, 100, 10), ("B", 100, 200, 10)])


@query(f"WITH {FREQ_BAD.sql('f')} SELECT trip_id, start FROM (SELECT trip_id, start, lag(\"end\") OVER (PARTITION BY trip_id ORDER BY start) AS before FROM f) WHERE before > start")
def frequency_overlaps(spark, sf_dir):
    from .sources.tables import overlapping_frequencies

    return overlapping_frequencies(FREQ_BAD.frame(spark))


@query("""SELECT 'unknown order' AS what, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'unknown part', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)""")
def orphan_refs(spark, sf_dir):
    """Counts of references that resolve to nothing."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"))
    a = line.join(orders, "l_orderkey", "left_anti").agg(F.count("*").alias("n")).select(F.lit("unknown order").alias("what"), "n")
    return a.union(line.join(part, "l_partkey", "left_anti").agg(F.count("*").alias("n")).select(F.lit("unknown part"), "n"))


# ---- a feed with flaws, loaded from its zip ------------------------------------

FLAWED = {
    "agency": Fixture("agency_id string, agency_name string, agency_url string, agency_timezone string", [("f", "Ferry", "https://ferry.example", "Europe/Lisbon")]),
    "stops": Fixture("stop_id string, stop_name string, stop_lat string, stop_lon string, location_type string, parent_station string", [("dock", "Dock", "38.70", "-9.15", "1", ""), ("dock/1", "Dock 1", "38.70", "-9.15", "0", "dock"), ("pier/1", "Pier 1", "38.71", "-9.16", "0", "gone"), ("cove", "Cove", "", "", "", "")]),
    "routes": Fixture("route_id string, route_short_name string, route_type string", [("F", "F1", "4"), ("B", "B1", "3")]),
    "trips": Fixture("route_id string, service_id string, trip_id string", [("F", "all", "a"), ("F", "all", "b"), ("B", "all", "c"), ("B", "all", "bare"), ("X", "all", "lost")]),
    "stop_times": Fixture("trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence string", [("a", "08:00:00", "08:00:00", "dock/1", "1"), ("a", "", "", "pier/1", "2"), ("a", "08:40:00", "", "cove", "3"), ("a", "", "", "dock/1", "4"), ("a", "09:00:00", "09:00:00", "nowhere", "9"), ("b", "", "", "dock/1", "1"), ("b", "", "25:10:00", "pier/1", "2"), ("c", "", "", "dock/1", "1"), ("c", "", "", "cove", "2"), ("lost", "08:00:00", "08:00:00", "cove", "1"), ("ghost", "08:00:00", "08:00:00", "cove", "1")]),
    "calendar": Fixture("service_id string, monday string, tuesday string, wednesday string, thursday string, friday string, saturday string, sunday string, start_date string, end_date string", [("all", "1", "1", "1", "1", "1", "1", "1", "20270301", "20270331")]),
    "calendar_dates": Fixture("service_id string, date string, exception_type string", [("all", "20270402", "1"), ("all", "20270302", "2"), ("all", "20270303", "7")]),
    "frequencies": Fixture("trip_id string, start_time string, end_time string, headway_secs string", [("b", "06:00:00", "07:00:00", "1200"), ("nobody", "06:00:00", "07:00:00", "600")]),
    "transfers": Fixture("from_stop_id string, to_stop_id string, transfer_type string, min_transfer_time string", [("dock/1", "pier/1", "2", "90"), ("dock/1", "gone", "0", ""), ("dock/1", "cove", "9", ""), ("cove", "dock/1", "2", ""), ("cove", "pier/1", "", "")]),
}


def flawed_zip() -> bytes:
    from .samples import feed_zip

    return feed_zip({f"{name}.txt": "\n".join(",".join(r) for r in [tuple(c.split()[0] for c in f.schema.split(", ")), *f.rows]) + "\n" for name, f in FLAWED.items()})


_FLAWED_SQL = ", ".join(f.sql(name) for name, f in FLAWED.items()) + """,
good_trips AS (SELECT * FROM trips WHERE route_id IN (SELECT route_id FROM routes)),
good_calls AS (SELECT *, CAST(stop_sequence AS INTEGER) AS seq, arrival_time <> '' OR departure_time <> '' AS timed FROM stop_times WHERE trip_id IN (SELECT trip_id FROM good_trips) AND stop_id IN (SELECT stop_id FROM stops)),
untimed AS (SELECT EXISTS (SELECT 1 FROM good_calls x WHERE x.trip_id = c.trip_id AND x.timed AND x.seq < c.seq) AND EXISTS (SELECT 1 FROM good_calls x WHERE x.trip_id = c.trip_id AND x.timed AND x.seq > c.seq) AS inner_ FROM good_calls c WHERE NOT timed)"""


@query(f"""WITH {_FLAWED_SQL}
SELECT 'unknown_parent' AS warning, count(*) AS n FROM stops WHERE parent_station <> '' AND parent_station NOT IN (SELECT stop_id FROM stops)
UNION ALL SELECT 'trips_unknown_route', count(*) FROM trips WHERE route_id NOT IN (SELECT route_id FROM routes)
UNION ALL SELECT 'trips_without_stop_times', count(*) FROM good_trips WHERE trip_id NOT IN (SELECT trip_id FROM good_calls)
UNION ALL SELECT 'bad_exception_type', count(*) FROM calendar_dates WHERE exception_type NOT IN ('1', '2')
UNION ALL SELECT 'stop_times_unknown_trip', count(*) FROM stop_times WHERE trip_id NOT IN (SELECT trip_id FROM good_trips)
UNION ALL SELECT 'stop_times_unknown_stop', count(*) FROM stop_times WHERE trip_id IN (SELECT trip_id FROM good_trips) AND stop_id NOT IN (SELECT stop_id FROM stops)
UNION ALL SELECT 'filled_time', count(*) FROM good_calls WHERE (arrival_time = '') <> (departure_time = '')
UNION ALL SELECT 'interpolated', count(*) FROM untimed WHERE inner_
UNION ALL SELECT 'missing_time', count(*) FROM untimed WHERE NOT inner_
UNION ALL SELECT 'frequencies_unknown_trip', count(*) FROM frequencies WHERE trip_id NOT IN (SELECT trip_id FROM good_trips)
UNION ALL SELECT 'transfers_skipped', count(*) FROM transfers WHERE from_stop_id NOT IN (SELECT stop_id FROM stops) OR to_stop_id NOT IN (SELECT stop_id FROM stops) OR (transfer_type <> '' AND CAST(transfer_type AS INTEGER) NOT BETWEEN 0 AND 5) OR (transfer_type = '2' AND min_transfer_time = '')""")
def load_warning_counts(spark, sf_dir):
    """What loading the flawed feed counts."""
    from .sources.tables import load_feed

    found = load_feed(spark, flawed_zip()).warnings
    return spark.createDataFrame(sorted(found.items()), "warning string, n long")


@query(f"WITH {lens.CALLS_SQL} SELECT DISTINCT route_type AS low, route_type AS high FROM lens_calls WHERE route_id IN (4, 7) UNION SELECT 1, 1")
def visit_types(spark, sf_dir):
    """Route types that visit: those of two routes chosen by name, and one named itself."""
    routes = lens.calls(spark, sf_dir, None).select("route_id", "route_type").distinct().withColumn("agency_id", F.lit("A")).withColumn("route_short_name", F.concat(F.lit("R"), F.col("route_id").cast("string")))
    ranges = sel.visit_route_types(routes, Selection("some", (Include(routes=("R4", "R7")),), visit_route_types=(1,)))
    return spark.createDataFrame(ranges, "low int, high int")


# ---- calendars ---------------------------------------------------------------

CAL = Fixture("service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date date, end_date date, file_order int", [("WD", 1, 1, 1, 1, 1, 0, 0, "2026-10-01", "2026-12-13", 1), ("WE", 0, 0, 0, 0, 0, 1, 1, "2026-10-01", "2026-12-13", 2), ("DUP", 1, 1, 1, 1, 1, 1, 1, "2026-10-01", "2026-10-10", 3), ("DUP", 0, 0, 0, 0, 0, 0, 1, "2026-11-01", "2026-11-30", 4), ("BIG", 1, 0, 0, 0, 0, 0, 0, "0001-01-01", "9999-12-31", 5)])
EXC = Fixture("service_id string, date date, exception_type int", [("WD", "2026-10-12", 2), ("WD", "2026-10-17", 1), ("EXTRA", "2026-10-18", 1), ("WE", "2026-10-17", 1), ("WE", "2026-10-17", 2), ("WD", "2026-10-01", 2)])
DAYS = Fixture("date date", [(f"2026-10-{d:02d}",) for d in (1, 2, 10, 12, 13, 17, 18)] + [("2026-11-01",), ("2026-11-08",), ("2026-12-14",)])
_LAST = "SELECT * FROM cal QUALIFY row_number() OVER (PARTITION BY service_id ORDER BY file_order DESC) = 1"
_FLAG = "list_value(monday, tuesday, wednesday, thursday, friday, saturday, sunday)[isodow({d})] = 1"


@query(f"""WITH {CAL.sql('cal')}, {EXC.sql('exc')}, {DAYS.sql('days')}, lastp AS ({_LAST}),
r AS (SELECT service_id, date FROM lastp JOIN days ON date BETWEEN start_date AND end_date WHERE {_FLAG.format(d='date')} UNION SELECT service_id, exc.date FROM exc JOIN days ON days.date = exc.date WHERE exception_type = 1)
SELECT service_id, date FROM r WHERE (service_id, date) NOT IN (SELECT (service_id, date) FROM exc WHERE exception_type = 2)""")
def active_services(spark, sf_dir):
    return cal.active_on(CAL.frame(spark), EXC.frame(spark), DAYS.frame(spark))


@query(f"""WITH {CAL.sql('cal')}, {EXC.sql('exc')}, lastp AS ({_LAST} ),
r AS (SELECT service_id, CAST(d AS DATE) AS date FROM (SELECT *, unnest(generate_series(start_date::TIMESTAMP, least(end_date, start_date + 60)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM lastp UNION ALL SELECT *, unnest(generate_series(greatest(start_date, end_date - 60)::TIMESTAMP, end_date::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM lastp) WHERE {_FLAG.format(d='CAST(d AS DATE)')}
UNION SELECT service_id, date FROM exc WHERE exception_type = 1)
SELECT service_id, min(date) AS first, max(date) AS last FROM r WHERE (service_id, date) NOT IN (SELECT (service_id, date) FROM exc WHERE exception_type = 2) GROUP BY service_id""")
def service_range(spark, sf_dir):
    return cal.service_range(CAL.frame(spark), EXC.frame(spark))


INFO = Fixture("feed_start_date date, feed_end_date date", [("2026-10-05", None)])


@query("SELECT DATE '2026-10-05' AS start, DATE '9999-12-27' AS \"end\"")
def validity_check(spark, sf_dir):
    return cal.validity(CAL.frame(spark), EXC.frame(spark), INFO.frame(spark))


@query("SELECT * FROM (VALUES ('2026-10-25', '2026-10-24', -90000), ('2026-10-25', '2026-10-26', 86400), ('2026-03-29', '2026-03-28', -82800), ('2026-03-29', '2026-03-30', 86400)) t(plan, day, seconds)")
def day_offsets_dst(spark, sf_dir):
    from datetime import date

    rows = [(a, b, cal.day_offset(date.fromisoformat(b), date.fromisoformat(a), "Europe/Berlin")) for a, b in (("2026-10-25", "2026-10-24"), ("2026-10-25", "2026-10-26"), ("2026-03-29", "2026-03-28"), ("2026-03-29", "2026-03-30"))]
    return spark.createDataFrame(rows, "plan string, day string, seconds int")


# ---- stations ----------------------------------------------------------------

STOPS = Fixture("stop_idx int, stop_id string, stop_name string, stop_lat double, stop_lon double, location_type int, parent_station string", [
    (0, "P1a", "One platform", 48.1, 11.5, 0, "P1"), (1, "P1", "One", 48.1, 11.5, 1, ""), (2, "de:09162:6:1", "Dhid a", 48.2, 11.6, 0, ""), (3, "de:09162:6:2", "Dhid b", 48.2001, 11.6, 0, ""),
    (4, "X1", "Münchner Freiheit", 48.3, 11.7, 0, ""), (5, "X2", "Muenchner Freiheit", 48.301, 11.7, 0, ""), (6, "X3", "Münchner Freiheit", 48.4, 11.7, 0, ""), (7, "L1", "Loop", None, None, 0, "L2"), (8, "L2", "Loop two", 48.5, 11.5, 0, "L1"), (9, "X4", "muenchnerfreiheit", 48.3035, 11.7, 0, ""), (10, "N1", "Near", 48.30001, 11.7, 0, "")])


@query(f"""WITH RECURSIVE {STOPS.sql('s')}, up AS (SELECT stop_id AS child, parent_station AS parent FROM s WHERE parent_station <> '' AND parent_station <> stop_id AND parent_station IN (SELECT stop_id FROM s)),
r AS (SELECT stop_id, stop_id AS root, 0 AS depth FROM s UNION ALL SELECT stop_id, parent, depth + 1 FROM r JOIN up ON root = child AND parent <> stop_id WHERE depth < 8)
SELECT stop_id, arg_max(root, depth) AS root, CAST(max(depth) AS INTEGER) AS depth FROM r GROUP BY stop_id""")
def parent_roots(spark, sf_dir):
    return st.parent_roots(STOPS.frame(spark))


@query("SELECT * FROM (VALUES (0, 'P1', 2), (1, 'de:09162:6', 2), (2, 'X1', 3), (3, 'X3', 1), (4, 'L1', 1), (5, 'L2', 1), (6, 'N1', 1)) t(station, station_id, members)".replace("(0,", "(0::INTEGER,").replace(", 2),", ", 2::BIGINT),", 1))
def station_clusters(spark, sf_dir):
    return st.cluster(STOPS.frame(spark))[0].select("station", "station_id", "members")


@query(f"WITH {STOPS.sql('s')}, k AS (SELECT stop_idx, regexp_replace(replace(lower(stop_name), 'ü', 'ue'), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS key, stop_lat AS lat, stop_lon AS lon FROM s WHERE stop_lat IS NOT NULL) SELECT a.stop_idx AS a, b.stop_idx AS b FROM k a JOIN k b ON a.key = b.key AND a.stop_idx < b.stop_idx WHERE {HAVERSINE_SQL.format(a='a', b='b')} <= 300")
def same_name_merges(spark, sf_dir):
    s = STOPS.frame(spark)
    return st.same_name_pairs(s.select(F.col("stop_idx").alias("idx"), names.normalise_name(F.col("stop_name")).alias("key"), F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon")))


@query("SELECT * FROM (VALUES ('different names close', 'X1', 'N1'), ('same name far apart', 'X1', 'X3')) t(kind, a_id, b_id)")
def ambiguous_pairs(spark, sf_dir):
    return st.ambiguous_pairs(st.cluster(STOPS.frame(spark))[0])[1].select("kind", "a_id", "b_id")


# ---- selection and network of the lens -----------------------------------------

NET_SQL = f"""{lens.DAY_SQL}, {lens.STATIONS_SQL},
of_mode AS (SELECT * FROM day_calls WHERE route_type IN (0, 1, 3)),
inside AS (SELECT trip_id FROM of_mode GROUP BY trip_id HAVING count(*) BETWEEN 2 AND 65537 AND arg_min(departure, seq) <= {END} AND arg_max(arrival, seq) >= {START}),
kept AS (SELECT * FROM of_mode WHERE trip_id IN (SELECT trip_id FROM inside)), {HOPS_SQL.format(out='net', calls='kept', seen=_SEEN)},
targets AS (SELECT DISTINCT station FROM day_calls WHERE route_type = 1 AND NOT (pickup_type = 1 AND drop_off_type = 1)),
here AS (SELECT * FROM lens_stations WHERE station IN (SELECT dep_station FROM net UNION SELECT arr_station FROM net UNION SELECT station FROM targets)),
walk AS (SELECT * FROM (SELECT a.station AS "from", b.station AS "to", {HAVERSINE_SQL.format(a='a', b='b')} AS metres FROM here a JOIN here b ON a.station <> b.station) WHERE metres <= {RULES.max_walk_m}),
links AS (SELECT "from", "to", metres, greatest({RULES.min_transfer_s.walk_link}, CAST(ceil(metres * 1.3::DOUBLE / {4.5 / 3.6!r}::DOUBLE) AS INTEGER)) AS duration FROM walk)"""
METRO = Selection("metro", (Include(route_types=(1,)),))


def lens_targets(spark: SparkSession, sf_dir: str, selection: Selection = METRO, calls: DataFrame | None = None) -> DataFrame:
    calls = lens.calls(spark, sf_dir) if calls is None else calls
    routes = calls.select("route_id", "route_type").distinct().withColumn("agency_id", F.lit("A")).withColumn("route_short_name", F.concat(F.lit("R"), F.col("route_id").cast("string")))
    return sel.select_targets(calls.select("station", "route_id", "pickup_type", "drop_off_type"), routes, lens.stations(spark), selection)


def lens_network(spark: SparkSession, sf_dir: str) -> nw.Network:
    # One day's calls are read by most steps of the build, so they are computed once.
    calls = written(lens.calls(spark, sf_dir))
    return nw.build(calls, lens.stations(spark), lens_targets(spark, sf_dir, calls=calls), RULES, VISITS)


@query(f"WITH {NET_SQL} SELECT station FROM targets")
def select_targets(spark, sf_dir):
    return lens_targets(spark, sf_dir)


@query(f"WITH {lens.DAY_SQL}, {lens.STATIONS_SQL} SELECT DISTINCT station FROM day_calls JOIN lens_stations USING (station) WHERE route_id IN (5, 6) AND NOT (pickup_type = 1 AND drop_off_type = 1) AND lat BETWEEN 48.10 AND 48.109 AND lon BETWEEN 11.5 AND 11.52 AND station_id NOT IN ('S0', 'S6') UNION SELECT station FROM lens_stations WHERE station_id = 'S19'")
def bbox_targets(spark, sf_dir):
    rule = Include(route_types=(3,), routes=("R5", "R?"), bbox=(48.10, 11.5, 48.109, 11.52))
    return lens_targets(spark, sf_dir, Selection("box", (rule, Include(stations=("S19", "S0"))), exclude_stations=("S0", "S6")))


@query(f"WITH {NET_SQL} SELECT * FROM net")
def network_connections(spark, sf_dir):
    return lens_network(spark, sf_dir).connections


@query(f"WITH {NET_SQL} SELECT count(*) AS connections, count(DISTINCT trip_id) AS trips, count(DISTINCT dep_station) AS stations, sum(CAST(visit_arr AS INTEGER))::BIGINT AS visiting FROM net")
def network_report(spark, sf_dir):
    return lens_network(spark, sf_dir).connections.agg(F.count("*").alias("connections"), F.countDistinct("trip_id").alias("trips"), F.countDistinct("dep_station").alias("stations"), F.sum(F.col("visit_arr").cast("int")).alias("visiting"))


@query(f"WITH {NET_SQL} SELECT station FROM targets WHERE station NOT IN (SELECT dep_station FROM net WHERE visit_dep AND pickup AND dep BETWEEN 30000 AND 40000 UNION SELECT arr_station FROM net WHERE visit_arr AND arr BETWEEN 30000 AND 40000)")
def unserved_targets(spark, sf_dir):
    n = lens_network(spark, sf_dir)
    return nw.unserved(n.targets, n.connections, 30000, 40000)


BACK = Fixture("trip_id string, seq int, arrival int, departure int", [("A", 1, 0, 10), ("A", 2, 5, 20), ("B", 1, 10, 5), ("B", 2, 20, 20), ("C", 1, 0, 0), ("C", 2, 0, 0)])


@query(f"WITH {BACK.sql('c')} SELECT trip_id FROM c WHERE departure < arrival UNION SELECT x.trip_id FROM c x JOIN c y ON y.trip_id = x.trip_id AND y.seq = (SELECT min(z.seq) FROM c z WHERE z.trip_id = x.trip_id AND z.seq > x.seq) WHERE y.arrival < x.departure")
def backwards_trips(spark, sf_dir):
    return nw.backwards_trips(BACK.frame(spark))


@query(f"WITH {lens.DAY_SQL} SELECT trip_id, arg_min(departure, seq) AS first_dep, arg_max(arrival, seq) AS last_arr, CAST(count(*) AS INTEGER) AS calls FROM day_calls GROUP BY trip_id HAVING arg_min(departure, seq) <= 50000 AND arg_max(arrival, seq) >= 40000")
def window_trips(spark, sf_dir):
    return nw.window_trips(lens.calls(spark, sf_dir), 40000, 50000)


@query(f"WITH {NET_SQL} SELECT \"from\", \"to\", round(metres, 6) AS metres, duration FROM links")
def walk_links(spark, sf_dir):
    n = lens_network(spark, sf_dir)
    return n.footpaths.withColumn("metres", F.round("metres", 6))


WALKS = Fixture("entry int, from int, to int, seconds int, forbid boolean, both boolean", [(1, 0, 1, 400, False, True), (2, 1, 0, 30, False, False), (3, 5, 6, None, True, True), (4, 6, 5, 999, False, False), (5, 0, 19, 50, False, True)])


@query(f"""WITH {NET_SQL}, {WALKS.sql('w')}, each AS (SELECT entry, "from", "to", seconds, forbid FROM w UNION ALL SELECT entry, "to", "from", seconds, forbid FROM w WHERE "both"),
last AS (SELECT * FROM each QUALIFY row_number() OVER (PARTITION BY "from", "to" ORDER BY entry DESC) = 1)
SELECT l."from", l."to", CAST(coalesce(greatest(last.seconds, CASE WHEN last.seconds IS NOT NULL THEN 120 END), duration) AS INTEGER) AS duration FROM links l LEFT JOIN last ON l."from" = last."from" AND l."to" = last."to" WHERE NOT coalesce(forbid, false)""")
def walk_overrides(spark, sf_dir):
    return nw.apply_walks(lens_network(spark, sf_dir).footpaths, WALKS.frame(spark), 120).select("from", "to", "duration")


TRANSFERS = Fixture("from_station int, to_station int, transfer_type int, min_transfer_time int", [(0, 0, 2, 400), (0, 0, 2, 300), (1, 1, 2, 10), (0, 1, 2, 2000), (3, 3, 0, None), (2, 17, 2, 900)])


@query(f"WITH {NET_SQL}, {TRANSFERS.sql('t')}, least AS (SELECT from_station, to_station, max(min_transfer_time) AS m FROM t WHERE transfer_type = 2 GROUP BY 1, 2) SELECT 'change' AS kind, station AS a, station AS b, CAST(greatest(60, coalesce(m, 0)) AS INTEGER) AS seconds FROM here LEFT JOIN least ON station = from_station AND station = to_station UNION ALL SELECT 'walk', \"from\", \"to\", CAST(greatest(duration, coalesce(m, 0)) AS INTEGER) FROM links LEFT JOIN least ON \"from\" = from_station AND \"to\" = to_station")
def transfer_minimums(spark, sf_dir):
    n = lens_network(spark, sf_dir)
    change, links = nw.transfer_minimums(n.change_time, n.footpaths, TRANSFERS.frame(spark), 60)
    return change.select(F.lit("change").alias("kind"), F.col("station").alias("a"), F.col("station").alias("b"), "seconds").union(links.select(F.lit("walk"), "from", "to", "duration"))


CHANGES = Fixture("change int, from_stop string, from_parent string, to_stop string, to_parent string, from_route string, to_route string, from_trip string, to_trip string", [(1, "a1", "A", "b1", "B", "R1", "R2", "T1", "T2"), (2, "a1", "A", "b1", "B", "R3", "R2", "T3", "T2"), (3, "a2", "A", "b1", "B", "R3", "R4", "T3", "T4"), (4, "c", None, "c", None, "R", "R", "T", "T")])
MOVES = Fixture("file_order int, from_stop_id string, to_stop_id string, from_route_id string, to_route_id string, from_trip_id string, to_trip_id string, transfer_type int, min_transfer_time int", [(1, "A", "B", None, None, None, None, 2, 300), (2, "a1", "b1", None, None, None, None, 2, 200), (3, "A", "B", "R1", None, None, None, 2, 100), (4, "a1", "b1", None, None, "T1", "T2", 3, None), (5, "A", "B", "R3", "R2", None, None, 0, None), (6, "x", "y", None, None, None, None, 1, None)])


@query(f"""WITH {CHANGES.sql('c')}, {MOVES.sql('m')},
fits AS (SELECT change, file_order, transfer_type, min_transfer_time, CAST(from_stop_id <> from_stop AS INTEGER) + CAST(to_stop_id <> to_stop AS INTEGER) AS wide,
    CAST(from_trip_id IS NOT NULL AS INTEGER) + CAST(to_trip_id IS NOT NULL AS INTEGER) AS trips, CAST(from_route_id IS NOT NULL AS INTEGER) + CAST(to_route_id IS NOT NULL AS INTEGER) AS routes
    FROM c JOIN m ON (from_stop_id = from_stop OR from_stop_id = from_parent) AND (to_stop_id = to_stop OR to_stop_id = to_parent)
    WHERE coalesce(from_route_id = from_route, true) AND coalesce(to_route_id = to_route, true) AND coalesce(from_trip_id = from_trip, true) AND coalesce(to_trip_id = to_trip, true)),
ranked AS (SELECT *, CAST(CASE WHEN trips = 2 THEN 1 WHEN trips = 1 AND routes > 0 THEN 2 WHEN trips = 1 THEN 3 WHEN routes = 2 THEN 4 WHEN routes = 1 THEN 5 ELSE 6 END AS INTEGER) AS rank FROM fits)
SELECT change, file_order, rank, transfer_type, min_transfer_time FROM ranked QUALIFY row_number() OVER (PARTITION BY change ORDER BY rank, wide, file_order) = 1""")
def transfer_specificity(spark, sf_dir):
    return ch.decisive_transfers(CHANGES.frame(spark), MOVES.frame(spark))


_BLOCKS = f"{lens.CALLS_SQL}, trips AS (SELECT trip_id, min(service_date) AS service_date, min(block_id) AS block_id, arg_min(departure, seq) AS first_dep FROM lens_calls GROUP BY trip_id), nx AS (SELECT trip_id, first_dep, lead(trip_id) OVER w AS next_trip, lead(first_dep) OVER w AS next_dep FROM trips WINDOW w AS (PARTITION BY service_date, block_id ORDER BY first_dep, trip_id))"


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lens.calls(spark, sf_dir, None)
    return c.groupBy("trip_id").agg(F.min("service_date").alias("service_date"), F.min("block_id").alias("block_id"), F.min_by("departure", "seq").alias("first_dep"), F.max_by("arrival", "seq").alias("last_arr"), F.min_by("station", "seq").alias("first_station"), F.max_by("station", "seq").alias("last_station"), (F.min("route_type") == 1).alias("visits"), F.count("*").alias("calls"))


@query(f"WITH {_BLOCKS} SELECT trip_id, next_trip FROM nx WHERE next_trip IS NOT NULL AND next_dep > first_dep")
def block_successors(spark, sf_dir):
    return ch.block_successors(_trips(spark, sf_dir))


@query(f"WITH RECURSIVE {_BLOCKS}, p AS (SELECT trip_id, next_trip FROM nx WHERE next_trip IS NOT NULL AND next_dep > first_dep), c AS (SELECT trip_id, trip_id AS chain, 0 AS part FROM trips WHERE trip_id NOT IN (SELECT next_trip FROM p) UNION ALL SELECT p.next_trip, chain, part + 1 FROM c JOIN p ON p.trip_id = c.trip_id) SELECT trip_id, chain, CAST(part AS INTEGER) AS part FROM c")
def stay_aboard_chains(spark, sf_dir):
    t = _trips(spark, sf_dir)
    return ch.chains(ch.block_successors(t), t)


# ---- routing -------------------------------------------------------------------

_REC = f"""WITH RECURSIVE {NET_SQL}, origins AS ({{origins}}),
st AS (
    SELECT q, 'r' AS kind, station AS s, NULL::VARCHAR AS trip, 0 AS pos, t FROM origins
    UNION SELECT q, 'r', "to", NULL, 0, t + duration FROM origins JOIN links ON "from" = station
    UNION
    SELECT x.q, x.kind, x.s, x.trip, x.pos, x.t FROM (
        SELECT st.q, 'o' AS kind, n.arr_station AS s, n.trip_id AS trip, n.pos AS pos, n.arr AS t FROM st JOIN net n ON st.kind = 'r' AND n.dep_station = st.s AND n.pickup AND n.dep >= st.t AND n.dep <= {END}
        UNION ALL SELECT st.q, 'o', n.arr_station, n.trip_id, n.pos, n.arr FROM st JOIN net n ON st.kind = 'o' AND n.trip_id = st.trip AND n.pos = st.pos + 1 AND n.dep <= {END}
        UNION ALL SELECT st.q, 'r', st.s, NULL, 0, st.t + 60 FROM st JOIN net n ON st.kind = 'o' AND n.trip_id = st.trip AND n.pos = st.pos AND n.drop_off
        UNION ALL SELECT st.q, 'r', l."to", NULL, 0, st.t + l.duration FROM st JOIN net n ON st.kind = 'o' AND n.trip_id = st.trip AND n.pos = st.pos AND n.drop_off JOIN links l ON l."from" = st.s
    ) x
), boards AS (SELECT q, s, min(t) AS board FROM st WHERE kind = 'r' GROUP BY q, s),
seen AS (
    SELECT st.q, st.s, st.t AS v FROM st JOIN net n ON st.kind = 'o' AND n.trip_id = st.trip AND n.pos = st.pos WHERE n.visit_arr AND st.t <= {END}
    UNION ALL SELECT b.q, n.dep_station, n.dep FROM boards b JOIN net n ON n.dep_station = b.s AND n.pickup AND n.visit_dep AND n.dep >= b.board AND n.dep <= {END}
)"""
_ONE = f"SELECT 0 AS q, 0 AS station, {ORIGIN_TIME} AS t"
_MANY = "SELECT CAST(i AS INTEGER) AS q, CAST(i % 20 AS INTEGER) AS station, CAST(18000 + 3600 * (i // 20) AS INTEGER) AS t FROM range(60) r(i)"


def _origins(spark: SparkSession, rows: list[tuple[int, int, int]]) -> DataFrame:
    return spark.createDataFrame([(q, "at", s, None, None, t) for q, s, t in rows], "query int, kind string, station int, trip_id string, pos int, time int")


def _labels(spark: SparkSession, sf_dir: str, rows: list[tuple[int, int, int]]) -> tuple[DataFrame, DataFrame]:
    n = lens_network(spark, sf_dir)
    return rounds.earliest(n.connections, n.footpaths, n.change_time, _origins(spark, rows), END)


@query(_REC.format(origins=_ONE) + " SELECT q AS query, s AS station, CAST(board AS INTEGER) AS board FROM boards")
def earliest_board(spark, sf_dir):
    return _labels(spark, sf_dir, [(0, 0, ORIGIN_TIME)])[0]


@query(_REC.format(origins=_ONE) + " SELECT q AS query, s AS station, CAST(min(v) AS INTEGER) AS visit FROM seen GROUP BY q, s")
def earliest_visit(spark, sf_dir):
    return _labels(spark, sf_dir, [(0, 0, ORIGIN_TIME)])[1]


_MANY_ROWS = [(i, i % 20, 18000 + 3600 * (i // 20)) for i in range(60)]


@query(_REC.format(origins=_MANY) + " SELECT q AS query, s AS station, CAST(min(v) AS INTEGER) AS visit FROM seen GROUP BY q, s")
def earliest_visit_many(spark, sf_dir):
    return _labels(spark, sf_dir, _MANY_ROWS)[1]


@query(_REC.format(origins=_MANY) + " SELECT q AS query, count(*) AS stations, CAST(max(board) AS INTEGER) AS latest FROM boards WHERE board <= 50000 GROUP BY q")
def reach_isochrone_counts(spark, sf_dir):
    return _labels(spark, sf_dir, _MANY_ROWS)[0].filter("board <= 50000").groupBy("query").agg(F.count("*").alias("stations"), F.max("board").alias("latest"))


@query(f"WITH {NET_SQL}, g AS (SELECT dep_station AS a, arr_station AS b, arr - dep AS w FROM net WHERE dep_station <> arr_station UNION ALL SELECT \"from\", \"to\", duration FROM links) SELECT a AS \"from\", b AS \"to\", min(w) AS seconds FROM g GROUP BY a, b")
def static_graph(spark, sf_dir):
    n = lens_network(spark, sf_dir)
    return rounds.static_graph(n.connections, n.footpaths)


@query(f"WITH RECURSIVE {NET_SQL}, g0 AS (SELECT dep_station AS a, arr_station AS b, arr - dep AS w FROM net WHERE dep_station <> arr_station UNION ALL SELECT \"from\", \"to\", duration FROM links), g AS (SELECT a, b, min(w) AS w FROM g0 GROUP BY a, b), d USING KEY (source, station) AS (SELECT station AS source, station, 0::BIGINT AS seconds FROM here UNION SELECT d.source, g.b, min(d.seconds + g.w) FROM d JOIN g ON d.station = g.a LEFT JOIN recurring.d AS o ON o.source = d.source AND o.station = g.b WHERE o.seconds IS NULL OR d.seconds + g.w < o.seconds GROUP BY d.source, g.b) SELECT source, station, seconds FROM d")
def static_distances(spark, sf_dir):
    n = lens_network(spark, sf_dir)
    return rounds.static_distances(rounds.static_graph(n.connections, n.footpaths), n.change_time.select("station"))


@query(f"WITH {NET_SQL}, asks AS (SELECT CAST(i AS BIGINT) AS ask, CAST(i % 20 AS INTEGER) AS station, CAST(i * 400 AS INTEGER) AS time FROM range(200) r(i)) SELECT ask, station, time, (SELECT min(dep) FROM net WHERE dep_station = station AND pickup AND dep >= time) AS next FROM asks")
def next_departures(spark, sf_dir):
    i = F.col("id")
    asks = spark.range(200).select(i.alias("ask"), F.pmod(i, F.lit(20)).cast("int").alias("station"), (i * 400).cast("int").alias("time"))
    return rounds.next_departures(lens_network(spark, sf_dir).connections, asks)


# ---- plans as rows ------------------------------------------------------------------

P_HOPS = Fixture("trip_id string, pos int, dep_station int, arr_station int, dep int, arr int, visit_dep boolean, visit_arr boolean", [("A", 0, 0, 1, 100, 200, True, True), ("A", 1, 1, 2, 210, 300, True, False), ("B", 0, 2, 3, 400, 500, True, True), ("C", 0, 4, 0, 590, 700, False, True), ("D", 0, 0, 1, 730, 800, True, True)])
P_LEGS = Fixture("plan int, leg int, kind string, trip_id string, from_pos int, to_pos int, start int, end int, metres double", [(1, 0, "ride", "A", 0, 1, None, None, None), (1, 1, "ride", "B", 0, 0, None, None, None), (1, 2, "walk", None, None, None, 500, 560, 50.25), (1, 3, "ride", "C", 0, 0, None, None, None), (1, 4, "ride", "D", 0, 0, None, None, None), (2, 0, "ride", "B", 0, 0, None, None, None)])
P_CHANGE = Fixture("station int, seconds int", [(s, 60) for s in range(5)])
P_TARGETS = Fixture("station int", [(0,), (1,), (3,)])
_PLAN_SQL = f"WITH {P_HOPS.sql('h')}, {P_LEGS.sql('l')}, {P_CHANGE.sql('c')}, {P_TARGETS.sql('g')}, hop AS (SELECT l.plan, l.leg, h.*, l.from_pos FROM l JOIN h ON l.trip_id = h.trip_id AND h.pos BETWEEN l.from_pos AND l.to_pos), v AS (SELECT plan, station, min(moment) AS visit FROM (SELECT plan, dep_station AS station, dep AS moment FROM hop WHERE visit_dep AND pos = from_pos UNION ALL SELECT plan, arr_station, arr FROM hop WHERE visit_arr) GROUP BY plan, station)"


@query(_PLAN_SQL + " SELECT * FROM v")
def plan_visits(spark, sf_dir):
    return lg.plan_visits(P_LEGS.frame(spark), P_HOPS.frame(spark))


@query(_PLAN_SQL + " SELECT plan, min(visit) AS first, max(visit) AS last, max(visit) - min(visit) AS seconds FROM v JOIN g USING (station) GROUP BY plan HAVING count(*) = 3")
def plan_duration(spark, sf_dir):
    return lg.plan_duration(plan_visits(spark, sf_dir), P_TARGETS.frame(spark))


_SLACK_SQL = "SELECT * FROM (VALUES (1, 1, 2, false, 40), (1, 3, 4, true, 30), (1, 4, 0, false, -30)) t(plan, leg, station, walked, slack)"


@query(_SLACK_SQL)
def transfer_slacks(spark, sf_dir):
    return lg.transfer_slacks(P_LEGS.frame(spark), P_HOPS.frame(spark), P_CHANGE.frame(spark))


@query(_SLACK_SQL + " WHERE slack < 35")
def tight_changes(spark, sf_dir):
    return transfer_slacks(spark, sf_dir).filter("slack < 35")


@query(_PLAN_SQL + " SELECT plan, greatest(0, count(*) FILTER (kind = 'ride') - 1)::BIGINT AS transfers, round(coalesce(sum(metres), 0), 1) AS walk_m, (SELECT count(*) FROM v WHERE v.plan = l.plan) AS stations_visited FROM l GROUP BY plan")
def itinerary_summary(spark, sf_dir):
    return lg.summary(P_LEGS.frame(spark), plan_visits(spark, sf_dir))


@query("SELECT * FROM (VALUES ('P', 'P', 'a'), ('PB', 'New', 'b'), ('Q', 'Q', 'c,d')) t(id, name, members)")
def cluster_overrides(spark, sf_dir):
    base = [{"id": "P", "name": "P", "members": ["a", "b"]}, {"id": "Q", "name": "Q", "members": ["c"]}, {"id": "R", "name": "R", "members": ["d"]}]
    out = st.apply_overrides(base, {"split": [{"stops": ["b"], "id": "PB"}], "merge": [{"stations": ["Q", "R"]}], "rename": [{"station": "PB", "name": "New"}]})
    return spark.createDataFrame([(s["id"], s["name"], ",".join(s["members"])) for s in out], "id string, name string, members string")


@query(f"WITH {lens.CALLS_SQL} SELECT DISTINCT trip_id FROM lens_calls WHERE arrival >= 79200")
def late_trips(spark, sf_dir):
    """Trips that still run at 22:00."""
    return lens.calls(spark, sf_dir, None).groupBy("trip_id").agg(F.max("arrival").alias("m")).filter("m >= 79200").select("trip_id")


@query(f"WITH RECURSIVE {_BLOCKS}, k AS (SELECT DISTINCT trip_id FROM lens_calls WHERE arrival >= 79200 UNION SELECT b.trip_id FROM k JOIN trips a ON a.trip_id = k.trip_id JOIN trips b ON b.block_id = a.block_id AND b.service_date = a.service_date) SELECT trip_id FROM k")
def pack_closure(spark, sf_dir):
    """Trips that still run at 22:00, with all trips of their vehicles that day."""
    from .pack import closure

    # Every round of the closure reads the trips, so they are computed once.
    t = written(_trips(spark, sf_dir).select("trip_id", F.concat_ws("/", "service_date", "block_id").alias("block_id"), "last_arr"))
    none = spark.createDataFrame([], "trip_id string, next_trip string")
    return closure(t.drop("last_arr"), t.filter("last_arr >= 79200"), none)


# ---- searches, without SQL ---------------------------------------------------------


def _bundle(spark: SparkSession, sf_dir: str):
    from .plans.kernel import Bundle

    return Bundle.of(lens_network(spark, sf_dir))


@query()
def profile_pairs(spark, sf_dir):
    from .plans.kernel import Bundle
    from .plans.tours import profiles

    n = lens_network(spark, sf_dir)
    b = Bundle.of(n)
    return rounds.profile_pairs(profiles(spark, b, b.targets), n.footpaths)


@query()
def min_visit_gaps(spark, sf_dir):
    from .plans.tours import min_visit_gaps as gaps

    return gaps(spark, _bundle(spark, sf_dir))


TOUR_RULES = Rules(date=lens.TOUR_DATE, earliest_start="00:00", latest_end="48:00")
TOUR = Selection("tour", (Include(stations=("S0", "S6", "S12", "S18")),), visit_route_types=(1,))


def tour_network(spark: SparkSession, sf_dir: str) -> nw.Network:
    """Four stations to visit within two days, where each user is one long trip."""
    calls = lens.tour_calls(spark, sf_dir)
    routes = calls.select("route_id", "route_type").distinct().withColumn("agency_id", F.lit("A")).withColumn("route_short_name", F.lit("R"))
    targets = sel.select_targets(calls.select("station", "route_id", "pickup_type", "drop_off_type"), routes, lens.stations(spark), TOUR)
    return nw.build(calls, lens.stations(spark), targets, TOUR_RULES, VISITS)


@query()
def greedy_best(spark, sf_dir):
    from .plans.kernel import Bundle
    from .plans.tours import best_run, greedy_jobs, greedy_runs

    b = Bundle.of(tour_network(spark, sf_dir))
    return best_run(greedy_runs(greedy_jobs(spark, b.targets, list(range(0, 24 * 3600, 3600))), b))


@query()
def heldkarp_bound(spark, sf_dir):
    from .plans.kernel import Bundle
    from .plans.tours import profile_bound, static_bound

    n = tour_network(spark, sf_dir)
    b = Bundle.of(n)
    upper = n.window[1] - n.window[0]
    return spark.createDataFrame([("static", static_bound(n, b.targets, upper)), ("profile", profile_bound(spark, b, upper))], "bound string, seconds long")


@query()
def optimum_tiny(spark, sf_dir):
    from .plans.kernel import Bundle
    from .plans.tours import optimum

    return optimum(spark, Bundle.of(tour_network(spark, sf_dir)))


@query("SELECT true AS static_holds, true AS profile_holds, true AS greedy_holds")
def bracket_check(spark, sf_dir):
    """Bounds stay under the optimum, and the greedy tour over it."""
    from .plans.kernel import Bundle
    from .plans.tours import best_run, greedy_jobs, greedy_runs, optimum, profile_bound, static_bound

    n = tour_network(spark, sf_dir)
    b = Bundle.of(n)
    best = optimum(spark, b).first()
    exact = best.seconds if best else n.window[1] - n.window[0]
    tour = best_run(greedy_runs(greedy_jobs(spark, b.targets, list(range(0, 24 * 3600, 7200))), b)).first()
    static, profile = static_bound(n, b.targets, exact), profile_bound(spark, b, exact)
    return spark.createDataFrame([(best is not None and static is not None and static <= exact, profile is not None and profile <= exact, tour is not None and tour.seconds >= exact)], "static_holds boolean, profile_holds boolean, greedy_holds boolean")


# ---- feed profile on the lens ---------------------------------------------------------


@query(f"WITH {lens.CALLS_SQL} SELECT route_type, count(DISTINCT route_id) AS routes, count(DISTINCT trip_id) AS trips FROM lens_calls GROUP BY route_type")
def route_type_counts(spark, sf_dir):
    return lens.calls(spark, sf_dir, None).groupBy("route_type").agg(F.countDistinct("route_id").alias("routes"), F.countDistinct("trip_id").alias("trips"))


@query(f"WITH {lens.CALLS_SQL} SELECT pickup_type, drop_off_type, count(*) AS calls FROM lens_calls GROUP BY pickup_type, drop_off_type")
def pickup_drop_histogram(spark, sf_dir):
    return lens.calls(spark, sf_dir, None).groupBy("pickup_type", "drop_off_type").agg(F.count("*").alias("calls"))


_PATTERN = f"{lens.CALLS_SQL}, p AS (SELECT trip_id, min(route_id) AS route_id, min(block_id) AS block_id, min(service_date) AS service_date, string_agg(station::VARCHAR, ',' ORDER BY seq) AS stops, string_agg((departure - first_dep)::VARCHAR, ',' ORDER BY seq) AS timing FROM (SELECT *, min(departure) OVER (PARTITION BY trip_id) AS first_dep FROM lens_calls) GROUP BY trip_id)"


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pack import trip_patterns

    return trip_patterns(lens.calls(spark, sf_dir, None).withColumn("stop_id", F.col("station").cast("string")))


@query(f"WITH {_PATTERN} SELECT stops, count(*) AS trips FROM p GROUP BY stops")
def pack_stop_patterns(spark, sf_dir):
    return _patterns(spark, sf_dir).groupBy("stops").agg(F.count("*").alias("trips"))


@query(f"WITH {_PATTERN} SELECT timing, count(*) AS trips FROM p GROUP BY timing")
def pack_timing_patterns(spark, sf_dir):
    return _patterns(spark, sf_dir).groupBy("timing").agg(F.count("*").alias("trips"))


@query(f"WITH {_PATTERN} SELECT route_id, stops, count(*) - 1 AS duplicates FROM p GROUP BY route_id, stops HAVING count(*) > 1")
def duplicate_trips(spark, sf_dir):
    """Trips of a route that call at the same stations (the lens has no equal times)."""
    c = lens.calls(spark, sf_dir, None)
    route = c.groupBy("trip_id").agg(F.min("route_id").alias("route_id"))
    return _patterns(spark, sf_dir).join(route, "trip_id").groupBy("route_id", "stops").agg((F.count("*") - 1).alias("duplicates")).filter("duplicates > 0")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return earliest_visit(spark, sf_dir)


from . import checks  # noqa: E402, F401  (registers its queries; needs the names above)
