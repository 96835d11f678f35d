"""Exact nearest neighbours by a block matrix join of int8 tiles.

Vectors are quantised to int8 with one scale each.  Query blocks meet candidate
blocks; a tile's inner products are products of int8 matrices (whole numbers
that float32 holds exactly up to `_EXACT` dimensions, float64 beyond) times the
scales, with the bound

    |x.y - sx sy (qx.qy)| <= |x|_1 sy/2 + |y|_1 sx/2 + d sx sy/4.

A pair survives if its upper bound reaches the query's k-th best lower bound so
far; survivors are recomputed in double precision and merged in a heap per query.
Every block of queries meets every block of candidates, so recall is 1 but for
double rounding.  Queries are a stated share of the rows; a tile's size bounds a
task's memory, and each task sends at most k rows per query on.

Tiles are held as int8 beside the originals in their own type, and cast for the product
alone.  A stripe of candidates is sized by bytes; each of its queries' blocks is copied
to it, so what is shuffled grows with queries times bytes over `STRIPE`.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, neither as query nor as candidate.  Vectors of different
lengths have no inner product: a query meets candidates of its own length.  Ties go to the smaller vec_id.  Repeated vec_ids stay
separate candidates, but no row with the query's own vec_id is one; repeated
queries are answered once.  Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import in_groups, written

#: Least stripes of the candidates of one length.
LEAST = 8
#: Distinct lengths of vectors up to which their counts are broadcast.
LENGTHS = 10_000
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
#: Bytes of candidates that a task holds, about: originals and their int8 codes.
STRIPE = 1 << 26
_EXACT = 1040  # 127**2 * d < 2**24


def usable(vector: str = "embedding") -> Column:
    """True for non-empty, non-zero vectors of finite components."""
    c = F.col(vector)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))


def _quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    scale = np.abs(x).max(axis=1) / 127
    scale = np.where(scale > 0, scale, 1.0)
    return np.rint(x / scale[:, None]).astype(np.int8), scale, np.abs(x).sum(axis=1)


def _blocks(df: DataFrame, size: int, dtype: type) -> DataFrame:
    """(block, d, ids, rows): packed blocks of at most `size` vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(d: int) -> pa.RecordBatch:
            ids, x = (np.concatenate(c) for c in zip(*held.pop(d), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["d", "ids", "rows"])

        held: dict[int, list] = {}
        for batch in batches:
            ids, lists = batch.column(0).to_numpy().astype(np.int64), batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)
            lens = np.diff(lists.offsets.to_numpy())
            first = np.cumsum(lens) - lens
            for d in np.unique(lens).tolist():
                at = np.flatnonzero(lens == d)
                for a in range(0, len(at), size):
                    part = at[a : a + size]
                    held.setdefault(d, []).append((ids[part], flat[(first[part][:, None] + np.arange(d)).ravel()]))
                    if sum(len(i) for i, _ in held[d]) >= size:
                        yield out(d)
        for d in list(held):
            yield out(d)

    return df.mapInArrow(run, "d int, ids binary, rows binary").withColumn("block", F.monotonically_increasing_id())


def nearest(vectors: DataFrame, asks: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query row."""
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    dtype = np.float32 if single else np.float64
    rows = vectors.filter(usable()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"), asks.alias("asks")).filter("vec_id is not null")
    # Queries once, packed and written; their blocks go to each stripe of candidates of their length.
    queries = written(_blocks(rows.filter("asks").dropDuplicates(["vec_id"]).select("vec_id", "v"), QUERY_BLOCK, dtype))
    candidates = _blocks(rows.select("vec_id", "v"), CANDIDATE_BLOCK, dtype)
    held = F.col("n") * F.col("of") * (np.dtype(dtype).itemsize + 1)
    sizes = rows.groupBy(F.size("v").alias("of")).agg(F.count("*").alias("n")).select("of", F.greatest(F.lit(LEAST), F.ceil(held / STRIPE)).cast("int").alias("stripes"))
    sizes = written(sizes)
    sizes = F.broadcast(sizes) if sizes.count() <= LENGTHS else sizes
    dealt = queries.join(sizes, F.col("d") == F.col("of")).select("d", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)).alias("stripe"), F.lit(1).alias("side"), "ids", "rows")
    striped = candidates.join(sizes, F.col("d") == F.col("of")).select("d", F.pmod(F.xxhash64("block"), F.col("stripes")).cast("int").alias("stripe"), F.lit(0).alias("side"), "ids", "rows")

    def answer(ask: tuple, hold: list[tuple]) -> pa.RecordBatch:
        ids, x, q, s, l1 = ask
        d = x.shape[1]
        exact = np.float32 if d <= _EXACT else np.float64
        best: list[list] = [[] for _ in ids]
        floor = np.full(len(ids), -np.inf)
        q8 = q.astype(exact)
        for c_ids, y, p, t, m1 in hold:
            near = (q8 @ p.astype(exact).T).astype(np.float64) * s[:, None] * t[None, :]
            slack = (l1[:, None] * t[None, :] + m1[None, :] * s[:, None]) / 2 + d * s[:, None] * t[None, :] / 4
            slack += 1e-9 * (np.abs(near) + slack)
            other = ids[:, None] != c_ids[None, :]
            if len(c_ids) >= k:
                low = np.where(other, near - slack, -np.inf)
                floor = np.maximum(floor, np.partition(low, len(c_ids) - k, axis=1)[:, len(c_ids) - k])
            a, b = np.nonzero(other & (near + slack >= floor[:, None]))
            score = np.zeros(len(a))
            for j in range(d):  # one fixed order of summation, so that equal vectors tie
                score += x[a, j].astype(np.float64) * y[b, j]
            for i, v, w in zip(a.tolist(), score.tolist(), c_ids[b].tolist(), strict=True):
                h = best[i]
                if len(h) < k:
                    heapq.heappush(h, (v, -w))
                elif (v, -w) > h[0]:
                    heapq.heapreplace(h, (v, -w))
            full = [i for i in range(len(ids)) if len(best[i]) == k]
            if full:
                floor[full] = np.maximum(floor[full], [best[i][0][0] for i in full])
        out = [(int(a), v, -w) for a, h in zip(ids, best, strict=True) for v, w in h]
        a, v, w = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(v, pa.float64()), pa.array(w, pa.int64())], names=["query_id", "score", "vec_id"])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A stripe's candidates come first and are held; its queries stream past them."""
        last, hold = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(batch.schema.get_field_index(n))[i].as_py() for n in ("d", "stripe", "side", "ids", "rows")}
                if (r["d"], r["stripe"]) != last:
                    last, hold = (r["d"], r["stripe"]), []
                x = np.frombuffer(r["rows"], dtype=dtype).reshape(-1, r["d"])
                block = (np.frombuffer(r["ids"], dtype=np.int64), x, *_quantise(x.astype(np.float64)))
                if not r["side"]:
                    hold.append(block)
                elif hold:
                    yield answer(block, hold)

    def merge(table: pa.Table) -> Iterator[pa.RecordBatch]:
        pairs = heapq.nsmallest(k, ((-s, v) for s, v in zip(table.column("score").to_pylist(), table.column("vec_id").to_pylist(), strict=True)))
        n = len(pairs)
        yield pa.RecordBatch.from_arrays([pa.array([table.column("query_id")[0].as_py()] * n, pa.int64()), pa.array(range(1, n + 1), pa.int32()), pa.array([v for _, v in pairs], pa.int64()), pa.array([-s for s, _ in pairs], pa.float64())], names=["query_id", "rank", "vec_id", "score"])

    both = dealt.unionByName(striped).repartition("d", "stripe").sortWithinPartitions("d", "stripe", "side")
    found = both.mapInArrow(tiles, "query_id long, score double, vec_id long")
    return in_groups(found, ["query_id"], merge, "query_id long, rank int, vec_id long, score double")


def nearest_sql(k: int = 20, every: int = 20) -> str:
    """DuckDB SQL for nearest() over the table embeddings, queries being vec_id % every = 0."""
    return f"""
WITH rows AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
    FROM rows q JOIN rows c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= {k}"""
