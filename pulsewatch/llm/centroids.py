"""Centroid clustering over subvector dictionaries (operator 12).

Integer vectors are clustered by Lloyd's rounds.  Before the first round every
chunk of ``chunk`` vectors is dictionary-encoded without loss: its dimensions are
cut into blocks of ``width``, and each block keeps its distinct subvectors and one
code per vector.  The encoded chunks are written once.  A round computes, per
chunk and block, the exact distances of the distinct subvectors to the centroids
and adds them up by code; what subvectors share is computed once.  The new sums
come from the same dictionaries, by the number of vectors per code and cluster.

A round moves no vectors: a task returns a count, a sum per dimension and the
summed distances of each cluster, which a partial aggregate adds up, and ``k`` rows
reach the driver.  Centroids go out with the next round: ``k * dim`` numbers, both
parameters.  All numbers are integers, so neither the order of the rows nor the
number of tasks changes a result.

Defined results: vectors that are NULL, of another length than ``dim``, or with
NULL or non-finite components aren't kept and give no row; neither do those with a
component beyond ``LARGEST``, whose squared distances don't fit a long.  A NULL id
is clustered but is no first centroid; repeated rows count each; with fewer
than ``k`` ids there are fewer centroids, and with none no rows; an inertia beyond
a long is NULL; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import matrix, saved, ship, written
from .topk import finite, quantised

#: Of a quantised component: 64 squared differences of twice this fit a long.
LARGEST = 1 << 27

CHUNK = "ids binary, nulls binary, n int, dictionaries array<binary>, codes array<binary>"


def encode(v: np.ndarray, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per block of ``width`` dimensions: the distinct subvectors, and each
    vector's code."""
    books, codes = [], []
    for at in range(0, v.shape[1], width):
        book, code = np.unique(v[:, at:at + width], axis=0, return_inverse=True)
        books.append(book)
        codes.append(code.reshape(-1).astype("<u2"))
    return books, codes


def distances(books: list[np.ndarray], codes: list[np.ndarray], centroids: np.ndarray) -> np.ndarray:
    """Squared distances, vectors by centroids: those of the subvectors, summed by code."""
    out, at = np.zeros((len(codes[0]), len(centroids)), dtype=np.int64), 0
    for book, code in zip(books, codes):
        width = book.shape[1]
        part = np.zeros((len(book), len(centroids)), dtype=np.int64)
        for d in range(width):
            part += np.square(book[:, d:d + 1] - centroids[:, at + d])
        out += part[code]
        at += width
    return out


def nearest(dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and its distance."""
    best = dist.argmin(axis=1)
    return best, dist[np.arange(len(dist)), best]


def sums(books: list[np.ndarray], codes: list[np.ndarray], cluster: np.ndarray, k: int) -> np.ndarray:
    """Sum of each dimension by cluster."""
    parts = []
    for book, code in zip(books, codes):
        both, times = np.unique(cluster * len(book) + code, return_counts=True)
        part = np.zeros((k, book.shape[1]), dtype=np.int64)
        np.add.at(part, both // len(book), book[both % len(book)] * times[:, None])
        parts.append(part)
    return np.concatenate(parts, axis=1)


def _chunks(rows: DataFrame, width: int, chunk: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pulsewatch.llm import centroids as C
        from pulsewatch.llm.common import matrix
        held, n = [], 0

        def out(held):
            t = pa.Table.from_batches(held)
            ids = t["id"].to_numpy() if not t["id"].null_count else t["id"].fill_null(0).to_numpy()
            nulls = np.asarray(t["id"].is_null())
            books, codes = C.encode(matrix(t["v"], np.int64), width)
            cells = [[ids.astype("<i8").tobytes()], [np.packbits(nulls).tobytes()], [len(ids)],
                     [[b.astype("<i4").tobytes() for b in books]], [[c.tobytes() for c in codes]]]
            types = [pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)],
                                              names=["ids", "nulls", "n", "dictionaries", "codes"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, chunk - n)
                held.append(part)
                n, at = n + part.num_rows, at + part.num_rows
                if n == chunk:
                    yield out(held)
                    held, n = [], 0
        if n:
            yield out(held)

    return rows.mapInArrow(run, CHUNK)


def _read(row: dict, width: int, dim: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """ids, which of them are NULL, dictionaries and codes of an encoded chunk."""
    widths = [min(width, dim - at) for at in range(0, dim, width)]
    books = [np.frombuffer(b, "<i4").reshape(-1, w).astype(np.int64) for b, w in zip(row["dictionaries"], widths)]
    codes = [np.frombuffer(c, "<u2") for c in row["codes"]]
    nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=row["n"]).astype(bool)
    return np.frombuffer(row["ids"], "<i8"), nulls, books, codes


def _each(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, width: int):
    """(ids, nulls, books, codes, cluster, distance) of each chunk of a task."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            ids, nulls, books, codes = _read(row, width, centroids.shape[1])
            yield ids, nulls, books, codes, *nearest(distances(books, codes, centroids))


def lloyd_round(chunks: DataFrame, centroids: np.ndarray, width: int) -> np.ndarray:
    """Centroids after one assignment: floors of the means, empty ones as they were."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pulsewatch.llm import centroids as C
        for _, _, books, codes, cluster, _ in C._each(batches, centroids, width):
            n = np.bincount(cluster, minlength=k)
            total = C.sums(books, codes, cluster, k)
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(n[used], pa.int64()), pa.array(list(total[used]), pa.list_(pa.int64()))],
                names=["cluster", "n", "total"])

    found = chunks.mapInArrow(run, "cluster int, n bigint, total array<bigint>").groupBy("cluster").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[d].cast("decimal(38,0)")) for d in range(dim)]).alias("total"))
    out = centroids.copy()
    for r in found.collect():  # a row per centroid at most
        out[r["cluster"]] = [int(x) // r["n"] for x in r["total"]]
    return out


def _assigned(chunks: DataFrame, centroids: np.ndarray, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pulsewatch.llm import centroids as C
        for ids, nulls, _, _, cluster, distance in C._each(batches, centroids, width):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64(), mask=nulls), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                names=["vec_id", "cluster", "distance"])

    return chunks.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, vec_id: str = "vec_id", embedding: str = "embedding",
            scale: int = 256, seed: str = "2:", width: int = 2, chunk: int = 1 << 14) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of
    every kept vector.  The first centroids are the vectors whose seeded ids have
    the smallest SHA-256."""
    if not 0 < chunk <= 1 << 16:
        raise ValueError("a chunk holds at most 65536 vectors: codes are 16 bits")
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(vectors[vec_id].cast("bigint").alias("id"), vectors[embedding].alias("e"))
    fits = F.forall("e", lambda x: F.abs(x.cast("double")) * F.lit(float(scale)) < F.lit(float(LARGEST)))
    rows = rows.where((F.size("e") == dim) & finite(F.col("e")) & fits).select("id", quantised(F.col("e"), scale).alias("v"))
    digest = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    first = rows.where("id is not null").select("v", digest.alias("h")).orderBy("h", "v").limit(k).select("v").toArrow()
    centroids = matrix(first["v"], np.int64).reshape(-1, dim)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, "
                                         "inertia bigint, centroid_sha256 string")
    chunks = written(spark, _chunks(rows, width, chunk), "chunks")
    for _ in range(rounds):
        centroids = lloyd_round(chunks, centroids, width)
    assigned = saved(_assigned(chunks, centroids, width))
    spent = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole = sum(spent.values())
    long = lambda x: x if x < 1 << 63 else None
    facts = [(c, long(d), long(whole), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
             for c, d in sorted(spent.items())]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
