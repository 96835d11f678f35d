"""A valid itinerary passes; each single change gives its codes."""

import ast
import json
import pathlib

from railweave import samples
from railweave.checks import sample_context
from railweave.operators.calendar import active_on
from railweave.sources.tables import load_feed
from railweave.verify.verifier import verify


def codes(found):
    got = {}
    for v in found.collect():
        got.setdefault(v.itinerary_id, set()).add(v.code)
    return got


def batch(spark, cases):
    return spark.createDataFrame([(name, json.dumps(it)) for name, it, _ in cases], "itinerary_id string, json string")


def test_each_change_gives_its_codes(spark):
    found, outcome = verify(batch(spark, samples.CASES), sample_context(spark))
    got = codes(found)
    for name, _, want in samples.CASES:
        assert got.get(name, set()) == want, name
    done = {r.itinerary_id: r for r in outcome.collect()}
    assert done["good"].duration_s == 2880 and done["good"].stations_visited == 5
    assert done["half way"].duration_s is None


def test_expected_rules_and_zone_of_the_feed(spark):
    two = [c for c in samples.CASES if c[0] in ("good", "short legs")]
    ctx = sample_context(spark)
    ctx.expected_rules = json.dumps(samples.RULES)
    assert codes(verify(batch(spark, two), ctx)[0]) == {"short legs": {"RULES_MISMATCH"}}
    ctx.zone = "Sea/Deep"
    found, outcome = verify(batch(spark, two), ctx)
    assert codes(found) == {"good": {"FEED_TIMEZONE"}, "short legs": {"FEED_TIMEZONE"}}
    assert {r.duration_s for r in outcome.collect()} == {None}


def test_sample_feed_loads(spark):
    feed = load_feed(spark, samples.feed_zip(samples.sample_feed()))
    assert feed.tables["stop_times"].count() == len(samples.CALLS)
    days = spark.createDataFrame([(samples.DAY,), (samples.OTHER_DAY,)], "d string").selectExpr("to_date(d) as date")
    active = active_on(feed.tables["calendar"], feed.tables["calendar_dates"], days)
    assert sorted((r.service_id, str(r.date)) for r in active.collect()) == sorted(samples.RUNS)


def test_verifier_does_not_import_the_planner():
    root = pathlib.Path(__file__).parent.parent / "railweave"
    seen, todo = set(), ["verify.verifier"]
    while todo:
        name = todo.pop()
        path = root.joinpath(*name.split("."))
        path = path / "__init__.py" if path.is_dir() else path.with_suffix(".py")
        if name in seen or not path.exists():
            continue
        seen.add(name)
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.ImportFrom) and node.level:
                base = name.split(".")[: -node.level] if node.level <= name.count(".") + 1 else []
                todo.append(".".join([*base, *(node.module or "").split(".")]).strip("."))
    assert not any(m.startswith("plans") for m in seen) and "rules" in seen
