"""Exact top-k by inner product (operator 8).

Candidates are dealt to shards of about ``shard_rows`` rows and queries to tiles
of about ``tile_rows``, row by row, so that a repeated id is spread like any other.
A group is one tile and one shard: its memory doesn't grow with the table or with the
queries.  A task multiplies the two and keeps each query's k best; per-query
lists are then merged in a tree of ``fan_in`` lists a step, so no task sees more
than ``fan_in * k`` rows of a query at once.

Scores are integer: products run in single or double precision where every
partial sum is exactly representable, and in 64-bit integers otherwise.

Defined results: vectors that are NULL, empty or hold NULL or non-finite
components, and rows with a NULL id, take no part; a query meets the candidates
of its own length only; rows with the query's id are its own row; repeated rows
are candidates (and queries) each; ties go to the smaller id; empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

QUERY_TILE = 2048


def finite(v: Column) -> Column:
    """Whether an array has components and none is NULL, NaN or infinite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))


def quantised(v: Column, scale: int = 256) -> Column:
    return F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def exact_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer matrix q @ c.T without rounding."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < 2 ** 24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 2 ** 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a tile: columns of the k highest scores, ties to the
    smaller id, rows with the query's own id left out.  ``ids`` ascend."""
    low = np.iinfo(np.int64).min
    lo, hi = np.searchsorted(ids, own, side="left"), np.searchsorted(ids, own, side="right")
    for r in range(len(scores)):
        s = scores[r]
        n = len(s) - (hi[r] - lo[r])
        if n <= 0:
            continue
        s[lo[r]:hi[r]] = low
        m = min(k, n)
        floor = np.partition(s, len(s) - m)[len(s) - m]  # the m-th best
        at = np.flatnonzero(s >= floor) if n > m else np.r_[0:lo[r], hi[r]:len(s)]
        yield r, at[np.lexsort((ids[at], -s[at]))[:m]]


def _shard(k: int):
    def run(t: pa.Table) -> pa.Table:
        from pulsewatch.llm import topk as T
        from pulsewatch.llm.common import matrix
        q, c = t.filter(t["is_query"]), t.filter(pc.invert(t["is_query"])).sort_by("id")
        out = [np.zeros((0, 4), dtype=np.int64)]
        if len(q) and len(c):
            cand, ids = matrix(c["v"], np.int64), c["id"].to_numpy()
            for at in range(0, len(q), T.QUERY_TILE):
                part = q.slice(at, T.QUERY_TILE)
                own, row = part["id"].to_numpy(), part["row"].to_numpy()
                scores = T.exact_products(matrix(part["v"], np.int64), cand)
                for r, top in T.best(scores, ids, own, k):
                    n = np.ones(len(top), dtype=np.int64)
                    out.append(np.stack([row[r] * n, own[r] * n, ids[top], scores[r, top]], axis=1))
        got = np.concatenate(out)
        dim = pa.array(np.full(len(got), t["dim"][0].as_py()), pa.int32())
        return pa.table([dim, *(pa.array(got[:, i]) for i in range(4))], names=["dim", "row", "query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding",
          scale: int = 256, shard_rows: int = 8192, fan_in: int = 32, tile_rows: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest of each query row.

    ``is_query``: condition on the columns of ``vectors``.  Larger ``shard_rows`` and
    ``tile_rows`` send a row to fewer groups and hold more of them at once.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(vectors[vec_id].cast("bigint").alias("id"), vectors[embedding].alias("e"),
                          F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & finite(F.col("e"))).select(
        "id", quantised(F.col("e"), scale).alias("v"), F.size("e").alias("dim"), "asks")
    # Rows are numbered: repeated ones stay apart as queries, and none makes a shard hot.
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    sizes = rows.groupBy("dim").agg(
        F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"),
        F.greatest(F.ceil(F.count_if("asks") / tile_rows), F.lit(1)).cast("int").alias("tiles"))
    dealt = rows.join(sizes, "dim")
    place = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    candidates = dealt.select("dim", place("shards").alias("shard"), every("tiles").alias("tile"),
                              F.lit(False).alias("is_query"), "row", "id", "v")
    queries = dealt.where("asks").select("dim", every("shards").alias("shard"), place("tiles").alias("tile"),
                                         F.lit(True).alias("is_query"), "row", "id", "v")
    lists = candidates.unionByName(queries).groupBy("dim", "shard", "tile").applyInArrow(
        _shard(k), "dim int, row bigint, query_id bigint, vec_id bigint, score bigint")
    best_first = [F.desc("score"), F.asc("vec_id")]
    most = sizes.agg(F.max("shards")).first()[0] or 1
    lists = lists.withColumn("part", F.pmod(F.xxhash64("vec_id", "score"), F.lit(most)))
    while most > fan_in:  # tree merge
        most = -(-most // fan_in)
        lists = lists.withColumn("part", F.pmod("part", F.lit(most)))
        w = Window.partitionBy("query_id", "dim", "row", "part").orderBy(*best_first)
        lists = lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
    w = Window.partitionBy("query_id", "dim", "row").orderBy(*best_first)
    return lists.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
