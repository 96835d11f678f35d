"""Commands: inspect, stations, pack, solve and verify.  Exit codes: 0 good, 1 no (invalid, infeasible), 2 trouble."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .rules import read_rules, read_selection


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="railweave")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("inspect", "stations", "pack", "solve", "verify"):
        c = sub.add_parser(name)
        c.add_argument("feed", help="GTFS zip")
        if name in ("solve", "verify"):
            c.add_argument("--rules", required=True)
            c.add_argument("--selection", help="else the file that the rules name")
        if name in ("solve", "pack"):
            c.add_argument("--out", required=name == "pack")
        if name == "verify":
            c.add_argument("itinerary")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("railweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        data = Path(a.feed).read_bytes()
        if a.command == "inspect":
            from .operators.profile import profile
            from .sources.tables import load_feed

            for r in profile(load_feed(spark, data)).orderBy("metric", "key").collect():
                print(f"{r.metric}\t{r.key}\t{r.value}")
            return 0
        if a.command == "stations":
            from .operators.stations import cluster
            from .sources.tables import load_feed

            for line in cluster(load_feed(spark, data).tables["stops"])[0].orderBy("station").toJSON().collect():
                print(line)
            return 0
        if a.command == "pack":
            from .pack import write
            from .sources.tables import load_feed

            print(json.dumps(write(load_feed(spark, data).tables, a.out)))
            return 0
        from .planner import context, prepare, solve

        rules = read_rules(Path(a.rules).read_text())
        chosen = Path(a.selection) if a.selection else Path(a.rules).parent / rules.selection
        selection = read_selection(chosen.read_text())
        if a.command == "solve":
            found = solve(spark, data, rules, selection)
            text = found.pop("itinerary", None)
            print(json.dumps(found))
            if text and a.out:
                Path(a.out).write_text(text)
            return 0 if text else 1
        from .verify.verifier import verify

        rows = spark.createDataFrame([("itinerary", Path(a.itinerary).read_text())], "itinerary_id string, json string")
        wrong, _ = verify(rows, context(spark, prepare(spark, data, rules, selection), rules))
        found = wrong.orderBy("leg", "code").collect()
        for v in found:
            print(f"{v.code}\t{'' if v.leg is None else v.leg}\t{v.message}")
        return 1 if found else 0
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
