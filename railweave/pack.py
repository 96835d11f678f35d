"""Packs: a feed's tables as Parquet, trips deduplicated into patterns."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import PackError

FORMAT = 1


def trip_patterns(calls: DataFrame) -> DataFrame:
    """(trip_id, base, stops, timing): where a trip calls and its departures from its first."""
    rows = calls.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("seq", "stop_id", "departure"))).alias("c"), F.min("departure").alias("base"))
    timing = F.transform("c", lambda x: (x["departure"] - F.col("base")).cast("string"))
    return rows.select("trip_id", "base", F.array_join(F.col("c.stop_id"), ",").alias("stops"), F.array_join(timing, ",").alias("timing"))


def closure(trips: DataFrame, seed: DataFrame, linked: DataFrame) -> DataFrame:
    """(trip_id): seed trips with all trips of their blocks and linked trips, until stable.

    trips(trip_id, block_id), linked(trip_id, next_trip).
    """
    from .frames import written

    kept = written(seed.select("trip_id").distinct())
    while True:
        n = kept.count()
        blocks = trips.join(kept, "trip_id", "left_semi").filter("block_id is not null").select("block_id").distinct()
        more = trips.join(blocks, "block_id", "left_semi").select("trip_id")
        ahead = linked.join(kept, "trip_id", "left_semi").select(F.col("next_trip").alias("trip_id"))
        back = linked.join(kept.select(F.col("trip_id").alias("next_trip")), "next_trip", "left_semi").select("trip_id")
        kept = written(kept.union(more).union(ahead).union(back).distinct().join(trips, "trip_id", "left_semi"))
        if kept.count() == n:
            return kept


def digest(df: DataFrame) -> str:
    """A hash of a table's rows that no writer, order or partitioning changes."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"s{k}") for k in range(4)]
    found = df.agg(F.count("*").alias("n"), *parts).first()
    return hashlib.sha256("|".join(str(x) for x in found).encode()).hexdigest()


def write(tables: dict[str, DataFrame], path: str) -> dict:
    """Writes tables and a header with the digest of each; reads them back to compare."""
    spark = next(iter(tables.values())).sparkSession
    header: dict = {"format": FORMAT, "tables": {}}
    for name, df in sorted(tables.items()):
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        header["tables"][name] = {"sha256": digest(df), "columns": df.columns}
        if digest(spark.read.parquet(f"{path}/{name}")) != header["tables"][name]["sha256"]:
            raise PackError(f"{name}: what was written differs")
    spark.createDataFrame([(json.dumps(header, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    return header


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a pack, each checked against its digest."""
    try:
        header = json.loads(spark.read.text(f"{path}/header").first().value)
    except Exception as e:
        raise PackError(f"not a pack: {path}") from e
    if header.get("format") != FORMAT:
        raise PackError(f"format {header.get('format')} is not {FORMAT}")
    out = {}
    for name, meta in header["tables"].items():
        df = spark.read.parquet(f"{path}/{name}")
        if digest(df) != meta["sha256"]:
            raise PackError(f"{name}: damaged")
        out[name] = df
    return out
