"""Shared DataFrame helpers: written intermediates and components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; set here only for a local session without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file:///tmp/railweave-checkpoints-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", folder) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return folder


def fresh(base: str, taken: list[str]) -> str:
    """base, with underscores before it until no column has that name."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base = f"_{base}"
    return base


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/railweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes a table of written() that nothing will read again."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of edges(a, b) reaches.

    Alternating large-star and small-star rounds.  Each round is written to the
    shared folder; rounds grow with the logarithm of the longest chain.
    """

    def stamp(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = stamp(e)
    if not before[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "m").filter("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = written(small)
        after = stamp(new)
        forget(e)
        e = new
        if after == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
