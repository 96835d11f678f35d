"""Registered queries of the verifier, one a code, over the sample network's itineraries.

Every query verifies all cases as one batch and reports where its code was found; the
SQL looks for the same breach in the same tables.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import samples as sa
from .catalog import HAVERSINE_SQL, Fixture, query
from .frames import written
from .verify.verifier import SCHEMA, Context, verify

_STOPS = Fixture("stop_id string, parent_station string, station_id string", [(k, s, s) for k, s in sa.PLATFORMS])
_PLACES = Fixture("station_id string, lat double, lon double", [(k, lat, lon) for k, _, lat, lon in sa.PLACES])
_TRIPS = Fixture("trip_id string, service_id string, route_id string, route_type int, is_template boolean", [(t, s, r, dict(sa.ROUTES)[r], m) for t, s, r, m in sa.TRIPS])
_CALLS = Fixture("trip_id string, seq int, stop_id string, arrival int, departure int, pickup_type int, drop_off_type int", sa.CALLS)
_RUNS = Fixture("service_id string, date date", sa.RUNS)
_MOVES = Fixture("file_order int, from_stop_id string, to_stop_id string, from_route_id string, to_route_id string, from_trip_id string, to_trip_id string, transfer_type int, min_transfer_time int", [(i, a, b, None, None, None, None, k, m) for i, (a, b, k, m) in enumerate(sa.TRANSFERS)])
_SEATS = Fixture("date date, trip_id string, next_trip string", [(sa.DAY, a, b) for a, b in sa.SEATS])
_WALKS = Fixture("entry int, from string, to string, seconds int, forbid boolean, both boolean", sa.WALKS)
_TARGETS = Fixture("station_id string", [(t,) for t in sa.TARGETS])


def _head(name: str, it: dict) -> tuple:
    r = it["rules"]
    return (name, it["schema"], it["timezone"], it["feed"]["sha256"], it["date"], r["walking_speed_kmh"], r["walk_detour_factor"], r["max_walk_m"], ",".join(r["connector_modes"]), r["min_transfer_s"]["same_station"], r["min_transfer_s"]["walk_link"], r["allow_walking"], r["stay_aboard_through_terminus"], r["earliest_start"], r["latest_end"], r["start"], r["end"], ",".join(sorted(it["targets"])), it["summary"]["duration_s"])


def _leg(name: str, k: int, x: dict) -> tuple:
    ride = x["type"] == "ride"
    return (name, k, x["type"], x.get("trip_id"), x.get("service_date"), x.get("board_stop_id"), x.get("alight_stop_id"), x["board_time" if ride else "start"], x["alight_time" if ride else "end"], ",".join(x.get("stations", ())), x.get("stay_aboard", False), x.get("from_station"), x.get("to_station"), x.get("station"))


_HEADS = Fixture("id string, schema string, zone string, sha string, day string, speed double, factor double, farthest double, modes string, same int, link int, walking boolean, stays boolean, earliest string, latest string, first string, last string, targets string, seconds long", [_head(n, it) for n, it, _ in sa.CASES])
_LEGS = Fixture("id string, leg int, kind string, trip_id string, sd_text string, board string, alight string, begins string, ends string, stations string, stay boolean, a string, b string, place string", [_leg(n, k, x) for n, it, _ in sa.CASES for k, x in enumerate(it["legs"])])


def sample_context(spark: SparkSession) -> Context:
    none = F.lit(None).cast("string").alias("template")
    return Context(_TRIPS.frame(spark).select("*", none), _CALLS.frame(spark), _STOPS.frame(spark), _PLACES.frame(spark), _RUNS.frame(spark), _MOVES.frame(spark), _SEATS.frame(spark), _WALKS.frame(spark), sa.TARGETS, [(0, 0)], sa.ZONE, "f00d")


def _batch(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, json.dumps(it)) for n, it, _ in sa.CASES], "itinerary_id string, json string")


_VERIFIED: dict[str, DataFrame] = {}


def _verified(spark: SparkSession) -> DataFrame:
    """Breaches of all cases, verified once a session."""
    key = spark.sparkContext.applicationId
    if key not in _VERIFIED:
        _VERIFIED.clear()
        _VERIFIED[key] = written(verify(_batch(spark), sample_context(spark))[0])
    return _VERIFIED[key]


def _secs(c: str) -> str:
    part = lambda k: f"CAST(split_part({c}, ':', {k}) AS INTEGER)"
    return f"CASE WHEN regexp_full_match({c}, '[0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?') THEN {part(1)} * 3600 + {part(2)} * 60 + CASE WHEN split_part({c}, ':', 3) <> '' THEN {part(3)} ELSE 0 END END"


_DATE = "TRY_CAST(CASE WHEN regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN {0} END AS DATE)"
_PAST = "OVER (PARTITION BY id{0} ORDER BY leg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_SINCE = _PAST.format(", resets")
_TABLES = ", ".join(f.sql(n) for n, f in (("stops", _STOPS), ("places", _PLACES), ("trips", _TRIPS), ("calls", _CALLS), ("runs", _RUNS), ("moves", _MOVES), ("seats", _SEATS), ("walks", _WALKS), ("wanted", _TARGETS), ("heads", _HEADS), ("legs", _LEGS)))
_RESOLVED = f"""{_TABLES},
plan AS (SELECT *, {_DATE.format('day')} AS d FROM heads),
l0 AS (
    SELECT l.*, p.* EXCLUDE (id, schema, zone, sha, targets, seconds), {_DATE.format('l.sd_text')} AS sd, {_secs('l.begins')} AS t0, {_secs('l.ends')} AS t1,
           t.service_id, t.route_type, t.is_template, t.trip_id IS NOT NULL AS known, bs.station_id AS board_at, als.station_id AS alight_at
    FROM legs l JOIN plan p USING (id) LEFT JOIN trips t USING (trip_id) LEFT JOIN stops bs ON bs.stop_id = l.board LEFT JOIN stops als ON als.stop_id = l.alight WHERE p.d IS NOT NULL
), l1 AS (
    SELECT l0.*, (SELECT min(seq) FROM calls c WHERE c.trip_id = l0.trip_id AND c.stop_id = board AND c.departure = t0) AS on_seq,
           EXISTS (SELECT 1 FROM runs r WHERE r.service_id = l0.service_id AND r.date = sd) AS runs
    FROM l0
), l2 AS (
    SELECT l1.*, (SELECT min(seq) FROM calls c WHERE c.trip_id = l1.trip_id AND c.stop_id = alight AND c.arrival = t1 AND c.seq > on_seq) AS off_seq,
           (SELECT min(seq) FROM calls c WHERE c.trip_id = l1.trip_id) AS first_seq, (SELECT arg_max(stop_id, seq) FROM calls c WHERE c.trip_id = l1.trip_id) AS end_stop, (SELECT arg_max(arrival, seq) FROM calls c WHERE c.trip_id = l1.trip_id) AS end_arrival
    FROM l1
), l3 AS (
    SELECT *, CASE WHEN kind = 'ride' AND NOT known THEN 'TRIP_UNKNOWN' WHEN kind = 'ride' AND is_template THEN 'TRIP_NOT_RUN' WHEN kind = 'ride' AND sd IS NULL THEN 'BAD_DATE'
        WHEN t0 IS NULL OR t1 IS NULL THEN 'BAD_TIME' WHEN kind = 'ride' AND on_seq IS NULL THEN 'BOARD_STOP_NOT_ON_TRIP' WHEN kind = 'ride' AND off_seq IS NULL THEN 'ALIGHT_STOP_NOT_ON_TRIP'
        WHEN kind = 'walk' AND (a NOT IN (SELECT station_id FROM places) OR b NOT IN (SELECT station_id FROM places)) THEN 'UNKNOWN_STATION' END AS trouble,
        CASE WHEN kind = 'ride' THEN date_diff('day', d, sd) * 86400 ELSE 0 END AS base
    FROM l2
), l4 AS (
    SELECT *, base + t0 AS begin, base + t1 AS finish, coalesce(sum(CAST(trouble IS NOT NULL AND kind <> 'wait' AS INTEGER)) {_PAST.format('')}, 0) AS resets,
        coalesce(sum(CAST(kind <> 'wait' AS INTEGER)) {_PAST.format('')}, 0) AS moves, coalesce(lead(stay) OVER (PARTITION BY id ORDER BY leg), false) AS next_stays
    FROM l3
), l5 AS (
    SELECT *, last_value(CASE WHEN kind <> 'wait' THEN kind END IGNORE NULLS) {_SINCE} AS p_kind,
        last_value(CASE WHEN kind <> 'wait' THEN coalesce(CASE WHEN kind = 'ride' THEN alight_at ELSE b END, '?') END IGNORE NULLS) {_SINCE} AS p_station,
        last_value(CASE WHEN kind <> 'wait' THEN coalesce(finish, -1) END IGNORE NULLS) {_SINCE} AS p_clock,
        last_value(CASE WHEN kind = 'ride' THEN trip_id END IGNORE NULLS) {_SINCE} AS q_trip, last_value(CASE WHEN kind = 'ride' THEN sd_text END IGNORE NULLS) {_SINCE} AS q_day,
        last_value(CASE WHEN kind = 'ride' THEN alight END IGNORE NULLS) {_SINCE} AS q_stop, last_value(CASE WHEN kind = 'ride' THEN finish END IGNORE NULLS) {_SINCE} AS q_at,
        last_value(CASE WHEN kind = 'ride' THEN end_stop END IGNORE NULLS) {_SINCE} AS q_end_stop, last_value(CASE WHEN kind = 'ride' THEN end_arrival END IGNORE NULLS) {_SINCE} AS q_end_arrival,
        max(CASE WHEN kind = 'wait' AND trouble IS NULL THEN finish END) OVER (PARTITION BY id, resets, moves ORDER BY leg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS waited
    FROM l4
), each_walk AS (SELECT entry, "from" AS a, "to" AS b, seconds, forbid FROM walks UNION ALL SELECT entry, "to", "from", seconds, forbid FROM walks WHERE "both"),
said AS (SELECT a, b, arg_max(coalesce(seconds, -1), entry) AS seconds, arg_max(forbid, entry) AS forbid FROM each_walk GROUP BY a, b),
res AS (
    SELECT l5.*, trouble IS NULL AS ok, greatest(p_clock, waited) AS clock, m.transfer_type AS move, m.min_transfer_time AS least, CASE WHEN pa.lat IS NOT NULL AND pb.lat IS NOT NULL THEN {HAVERSINE_SQL.format(a='pa', b='pb')} END AS metres, nullif(s.seconds, -1) AS measured, coalesce(s.forbid, false) AS forbid,
        kind = 'ride' AND trouble IS NULL AND p_kind IS NOT NULL AND q_trip IS NOT NULL AND NOT stay AND NOT (p_kind = 'ride' AND q_trip = l5.trip_id AND q_day = sd_text) AS changing,
        CASE WHEN p_kind = 'ride' THEN same ELSE 0 END AS own
    FROM l5 LEFT JOIN moves m ON m.from_stop_id = q_stop AND m.to_stop_id = board LEFT JOIN places pa ON pa.station_id = l5.a LEFT JOIN places pb ON pb.station_id = l5.b LEFT JOIN said s ON s.a = l5.a AND s.b = l5.b
), seen AS (
    SELECT r.id, r.leg, c.seq, st.station_id, r.base + CASE WHEN c.seq = on_seq THEN c.departure ELSE c.arrival END AS moment
    FROM res r JOIN calls c ON c.trip_id = r.trip_id AND c.seq BETWEEN on_seq AND off_seq JOIN stops st ON st.stop_id = c.stop_id
    WHERE r.kind = 'ride' AND r.ok AND r.route_type = 0 AND NOT (c.pickup_type = 1 AND c.drop_off_type = 1)
), told AS (SELECT id, leg, string_agg(station_id, ',' ORDER BY seq) AS actual FROM seen GROUP BY id, leg),
want AS (SELECT p.id, w.station_id, min(moment) AS moment FROM plan p CROSS JOIN wanted w LEFT JOIN seen s ON s.id = p.id AND s.station_id = w.station_id WHERE p.d IS NOT NULL GROUP BY p.id, w.station_id),
done AS (SELECT p.*, lo, hi FROM plan p JOIN (SELECT id, min(moment) AS lo, max(moment) AS hi FROM want GROUP BY id HAVING count(moment) = count(*)) USING (id))"""

_LEG_SQL = "SELECT id, leg FROM res WHERE "
_PLAN_SQL = "SELECT id, CAST(NULL AS INTEGER) AS leg FROM plan WHERE d IS NOT NULL AND "
_DONE_SQL = "SELECT id, CAST(NULL AS INTEGER) AS leg FROM done WHERE "
_TROUBLE = lambda code: _LEG_SQL + f"trouble = '{code}'"
_NAMED = "kind = 'ride' AND known AND NOT is_template AND sd IS NOT NULL AND "
_BREACHES = {
    "SCHEMA": f"SELECT id, CAST(NULL AS INTEGER) AS leg FROM plan WHERE schema <> '{SCHEMA}'",
    "TIMEZONE_MISMATCH": f"SELECT id, CAST(NULL AS INTEGER) AS leg FROM plan WHERE zone <> '{sa.ZONE}'",
    "BAD_DATE": "SELECT id, CAST(NULL AS INTEGER) AS leg FROM plan WHERE d IS NULL UNION ALL " + _TROUBLE("BAD_DATE"),
    "FEED_MISMATCH": "SELECT id, CAST(NULL AS INTEGER) AS leg FROM plan WHERE sha <> 'f00d'",
    "BAD_RULES": " UNION ALL ".join(_PLAN_SQL + c for c in ("NOT speed > 0", "NOT factor >= 1", "NOT farthest >= 0", "least(same, link) < 1", "modes NOT IN ('bus', 'tram', 'metro', 'rail', 'ferry')")),
    **{c: _TROUBLE(c) for c in ("TRIP_UNKNOWN", "TRIP_NOT_RUN", "BAD_TIME", "BOARD_STOP_NOT_ON_TRIP", "ALIGHT_STOP_NOT_ON_TRIP", "UNKNOWN_STATION")},
    "SERVICE_NOT_RUNNING": _LEG_SQL + _NAMED + "NOT runs",
    "MODE_NOT_ALLOWED": _LEG_SQL + _NAMED + "NOT (route_type = 0 OR modes = 'bus' AND route_type = 3)",
    "PICKUP_NOT_ALLOWED": _LEG_SQL + "kind = 'ride' AND ok AND NOT stay AND (SELECT pickup_type FROM calls c WHERE c.trip_id = res.trip_id AND c.seq = on_seq) = 1",
    "DROP_OFF_NOT_ALLOWED": _LEG_SQL + "kind = 'ride' AND ok AND NOT next_stays AND (SELECT drop_off_type FROM calls c WHERE c.trip_id = res.trip_id AND c.seq = off_seq) = 1",
    "NOT_CONTIGUOUS": _LEG_SQL + "ok AND p_kind IS NOT NULL AND p_station <> CASE kind WHEN 'ride' THEN board_at WHEN 'walk' THEN a ELSE place END",
    "TIME_TRAVEL": _LEG_SQL + "ok AND p_kind IS NOT NULL AND begin < clock UNION ALL " + _LEG_SQL + "kind = 'wait' AND ok AND finish < begin",
    "FORBIDDEN_TRANSFER": _LEG_SQL + "changing AND move = 3",
    "TRANSFER_TOO_SHORT": _LEG_SQL + "changing AND begin < q_at + CASE WHEN move = 2 THEN greatest(own, least) ELSE own END",
    "STAY_ABOARD_NOT_ALLOWED": _LEG_SQL + "ok AND stay AND NOT stays",
    "NOT_A_CONTINUATION": _LEG_SQL + "ok AND stay AND NOT coalesce(on_seq = first_seq AND p_kind = 'ride' AND q_stop = q_end_stop AND q_day = sd_text AND clock = base + q_end_arrival AND EXISTS (SELECT 1 FROM seats s WHERE s.trip_id = q_trip AND s.next_trip = res.trip_id AND s.date = sd), false)",
    "STATIONS_MISMATCH": "SELECT id, leg FROM res LEFT JOIN told USING (id, leg) WHERE kind = 'ride' AND ok AND stations <> '' AND stations <> coalesce(actual, '')",
    "WALK_NOT_ALLOWED": _LEG_SQL + "kind = 'walk' AND NOT walking",
    "WALK_SAME_STATION": _LEG_SQL + "kind = 'walk' AND ok AND a = b",
    "WALK_CHAINED": _LEG_SQL + "kind = 'walk' AND ok AND p_kind = 'walk'",
    "WALK_UNMEASURABLE": _LEG_SQL + "kind = 'walk' AND ok AND metres IS NULL",
    "WALK_TOO_LONG": _LEG_SQL + "kind = 'walk' AND ok AND metres > farthest + 0.5",
    "WALK_FORBIDDEN": _LEG_SQL + "kind = 'walk' AND ok AND forbid",
    "WALK_TOO_FAST": _LEG_SQL + "kind = 'walk' AND ok AND metres IS NOT NULL AND finish - begin < greatest(link, coalesce(measured, CASE WHEN speed <> 0 THEN ceil(metres * factor / (speed / 3.6)) END))",
    "MISSING_TARGET": "SELECT id, CAST(NULL AS INTEGER) AS leg FROM want WHERE moment IS NULL",
    "TARGETS_MISMATCH": _PLAN_SQL + f"targets <> '{','.join(sorted(sa.TARGETS))}'",
    "OUTSIDE_WINDOW": _DONE_SQL + f"lo < {_secs('earliest')} UNION ALL " + _DONE_SQL + f"hi > {_secs('latest')}",
    "START_MISMATCH": _DONE_SQL + "first <> 'any' AND NOT EXISTS (SELECT 1 FROM want w WHERE w.id = done.id AND w.moment = lo AND w.station_id = first)",
    "END_MISMATCH": _DONE_SQL + "last <> 'any' AND NOT EXISTS (SELECT 1 FROM want w WHERE w.id = done.id AND w.moment = hi AND w.station_id = last)",
    "SUMMARY_MISMATCH": _DONE_SQL + "hi - lo IS DISTINCT FROM seconds",
}


def _counted(found: DataFrame) -> DataFrame:
    return found.groupBy("itinerary_id", "leg").agg(F.count("*").alias("breaches"))


def _register(code: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _counted(_verified(spark).filter(F.col("code") == code))

    run.__name__ = f"verify_{code.lower()}"
    query(f"WITH {_RESOLVED} SELECT id AS itinerary_id, leg, count(*) AS breaches FROM ({_BREACHES[code]}) GROUP BY id, leg")(run)


for _code in _BREACHES:
    _register(_code)

_GOOD = _head("good", sa.GOOD)


@query(f"WITH {_HEADS.sql('heads')} SELECT id AS itinerary_id, CAST(NULL AS INTEGER) AS leg, 1::BIGINT AS breaches FROM heads WHERE {_DATE.format('day')} IS NOT NULL AND (speed, factor, farthest, modes, same, link, walking, stays, earliest, latest, first, last) IS DISTINCT FROM (SELECT (speed, factor, farthest, modes, same, link, walking, stays, earliest, latest, first, last) FROM heads WHERE id = 'good')")
def verify_rules_mismatch(spark, sf_dir):
    """Itineraries planned under other rules than those that are expected."""
    ctx = sample_context(spark)
    ctx.expected_rules = json.dumps(sa.RULES)
    return _counted(verify(_batch(spark), ctx)[0].filter("code = 'RULES_MISMATCH'"))


@query(f"WITH {_HEADS.sql('heads')} SELECT id AS itinerary_id, 'FEED_TIMEZONE' AS code FROM heads WHERE NOT EXISTS (SELECT 1 FROM pg_timezone_names() WHERE name = 'Sea/Deep')")
def verify_feed_timezone(spark, sf_dir):
    """A feed whose zone nobody knows: every itinerary gets this one code."""
    ctx = sample_context(spark)
    ctx.zone = "Sea/Deep"
    return verify(_batch(spark), ctx)[0].select("itinerary_id", "code")


@query(f"WITH {_RESOLVED} SELECT id AS itinerary_id, code, count(*) AS breaches FROM (" + " UNION ALL ".join(f"SELECT id, '{c}' AS code FROM ({sql})" for c, sql in _BREACHES.items()) + ") GROUP BY id, code")
def verify_report(spark, sf_dir):
    return _verified(spark).groupBy("itinerary_id", "code").agg(F.count("*").alias("breaches"))


@query(f"WITH {_RESOLVED} SELECT p.id AS itinerary_id, hi - lo AS duration_s, coalesce(n, 0) AS stations_visited FROM plan p LEFT JOIN done ON done.id = p.id LEFT JOIN (SELECT id, count(DISTINCT station_id) AS n FROM seen GROUP BY id) v ON v.id = p.id WHERE p.d IS NOT NULL")
def verify_outcome(spark, sf_dir):
    return verify(_batch(spark), sample_context(spark))[1]
