"""Mixing sources to target weights by Poisson replication.

A source of weight w that holds n of N documents should supply w*N of the mix,
so each of its documents is repeated with mean w*N/n.  The count of a document
inverts the Poisson distribution at a uniform number taken from an MD5 of
(seed, doc_id, part); means over PART are drawn as sums of independent parts, so
no exponential underflows.  Counts depend on the row alone: no task needs
another's rows, and a lost one is redone alike.  Documents are exploded by their
counts and dealt out by range over a second hash, a global shuffle in the
statistical sense: the order of `mix_key` is that of a uniform permutation.  A document without doc_id is
drawn as "null".

Defined results: a null source is a source of its own; a source without weight
is left out (mean 0); with no weights given every source has the same.  Weights
are divided by their sum.  Rows that share a doc_id have the same count.  Texts
are never read.  Added columns are mix_copy (from 1) and mix_key; a column of
the input with such a name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import written

#: Largest mean drawn at once, and terms of its inverse (mass beyond: < 1e-20).
PART = 8.0
TERMS = 48
#: Sources up to which their means are broadcast.
SOURCES = 100_000


def _uniform(key: Column) -> Column:
    """52 bits of an MD5 as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_count(mean: Column, key: Column) -> Column:
    """Poisson number of the given mean at the hash of key."""
    parts = F.greatest(F.lit(1), F.ceil(mean / PART)).cast("int")
    each = mean / parts

    def draw(i: Column) -> Column:
        u = _uniform(F.concat_ws(":", key, i.cast("string")))
        # u stands in the start value, so that it is hashed once a part.
        start = F.struct(F.exp(-each).alias("p"), F.exp(-each).alias("c"), F.lit(0).alias("k"), u.alias("u"))
        step = lambda s, j: F.struct((s["p"] * each / j).alias("p"), (s["c"] + s["p"] * each / j).alias("c"), (s["k"] + F.when(s["u"] >= s["c"], 1).otherwise(0)).alias("k"), s["u"].alias("u"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["k"])

    return F.aggregate(F.transform(F.sequence(F.lit(1), parts), draw), F.lit(0), lambda a, x: a + x)


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: str = "mix") -> DataFrame:
    """docs repeated by source, with mix_copy and mix_key, in global hash order."""
    spark = docs.sparkSession
    docs = docs.drop("mix_copy", "mix_key")
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    source, doc_id = F.col("row.source"), F.col("row.doc_id").cast("string")
    n = rows.groupBy(source.alias("of")).agg(F.count("*").alias("n"))
    if weights is not None:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items() if v > 0], "given string, weight double")
        n = n.join(given, F.col("of").eqNullSafe(F.col("given")))
    else:
        n = n.withColumn("weight", F.lit(1.0))
    n = written(n.select("of", "n", "weight"))
    totals = n.agg(F.sum("weight").alias("weights"), F.count("*").alias("sources")).first()
    every = rows.count() if weights is not None else n.agg(F.sum("n")).first()[0]
    means = n.select("of", (F.col("weight") * F.lit(every or 0) / (F.lit(totals.weights or 1.0) * F.col("n"))).alias("mean"))
    # One row a source: joined on the spot if they are few, else by source.
    means = F.broadcast(means) if totals.sources <= SOURCES else means
    key = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id, F.lit("null")))
    counts = rows.join(means, source.eqNullSafe(F.col("of"))).select("row", poisson_count(F.col("mean"), key).alias("copies")).filter("copies > 0")
    copies = counts.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("mix_copy"))
    copies = copies.withColumn("mix_key", F.md5(F.concat_ws(":", key, F.lit("order"), F.col("mix_copy").cast("string"))))
    # Keys are uniform, so ranges of equal width hold equal shares; nothing is sampled for their bounds.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = (F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long") * parts / F.lit(1 << 32)).cast("int")
    return copies.select("row.*", "mix_copy", "mix_key").repartitionById(parts, part).sortWithinPartitions("mix_key")


def mix_sql(seed: str = "mix") -> str:
    """DuckDB SQL for mix_sources() with equal weights over the table documents."""
    draw = f"""
    SELECT doc_id, source, i, mean / parts AS each,
           CAST('0x' || substr(md5('{seed}:' || doc_id || ':' || i), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
    FROM means, unnest(range(1, parts + 1)) AS t(i)"""
    return f"""
WITH RECURSIVE sizes AS (
    SELECT source, count(*) AS n, sum(count(*)) OVER () AS total, count(*) OVER () AS sources FROM documents GROUP BY source
), means AS (
    SELECT d.doc_id, d.source, 1.0::DOUBLE * total / (sources::DOUBLE * n) AS mean,
           greatest(1, ceil((1.0::DOUBLE * total / (sources::DOUBLE * n)) / {PART}))::BIGINT AS parts
    FROM documents d JOIN sizes s ON d.source IS NOT DISTINCT FROM s.source
), draws AS ({draw}
), steps AS (
    SELECT doc_id, source, i, each, u, 0 AS j, exp(-each) AS p, exp(-each) AS c, 0 AS k FROM draws
    UNION ALL
    SELECT doc_id, source, i, each, u, j + 1, p * each / (j + 1), c + p * each / (j + 1), k + CASE WHEN u >= c THEN 1 ELSE 0 END
    FROM steps WHERE j < {TERMS}
), counts AS (
    SELECT doc_id, source, sum(k)::BIGINT AS n FROM steps WHERE j = {TERMS} GROUP BY doc_id, source
)
SELECT d.*, c.copy::INTEGER AS mix_copy, md5('{seed}:' || d.doc_id || ':order:' || c.copy) AS mix_key
FROM documents d JOIN (SELECT doc_id, source, unnest(range(1, n + 1)) AS copy FROM counts WHERE n > 0) c
  ON d.doc_id = c.doc_id AND d.source IS NOT DISTINCT FROM c.source"""
