"""Embedding near-dedup (operator 1): subspace pigeonhole join.

Unit vectors have cosine >= t exactly when their squared distance is at most
2 (1 - t).  The vectors are rotated and cut into blocks of few dimensions, and
every block gets a share of that squared distance in proportion to its share of
the variance; a pair within the whole distance is within the share of at least
one block.  Each block is range-joined on a grid over its two leading axes with
cells as wide as the block's radius, so partners lie in the same or a
neighbouring cell.  Cells are cut into tiles of about ``tile`` vectors and every
pair of tiles is one group: block distances by a matrix product give the
candidates, those that an earlier block also finds are left to it, and the rest
is verified on the original vectors in double precision.

Equal vectors are one class from the start, so a group of copies is one vector
with a count.  A task returns, per vector, the number of links it found and one
edge of a spanning forest, never the links themselves.

The rotation (principal axes of ``sample`` classes, the first by hash) only
steers how evenly the blocks share distance; any rotation gives the same links.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite
components, and vectors whose length isn't the most frequent one (the longer of
equals), link with nothing; rows with a NULL id link with nothing and have no component;
repeated rows count as vectors each; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash128, matrix, saved, ship
from .graph import components
from .simhash import forest
from .topk import finite

SLACK = 1e-9
MARGIN = 1e-5  # well above single-precision error of a block distance


class Subspaces:
    """The rotation, its blocks, and the squared-distance budget of each."""

    def __init__(self, sample: np.ndarray, dim: int, cosine: float, blocks: int):
        self.distance = 2 * (1 - cosine)
        cov = np.eye(dim) * 1e-12
        if len(sample):
            unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
            cov = cov + unit.T @ unit / len(unit) - np.outer(unit.mean(0), unit.mean(0))
        variance, axes = np.linalg.eigh(cov)
        down = np.argsort(-variance)
        blocks = max(1, min(blocks, dim // 2))
        order = [down[b::blocks] for b in range(blocks)]  # axes are dealt, strongest first
        self.rotation = np.concatenate([axes[:, o] for o in order], axis=1)
        ends = np.cumsum([len(o) for o in order]).tolist()
        self.parts = [slice(s, e) for s, e in zip([0, *ends], ends)]
        share = np.array([max(variance[o].sum(), 1e-12) for o in order])
        self.budget = (self.distance * share / share.sum() * (1 + SLACK) + 1e-12).tolist()
        self.side = [float(np.sqrt(b) * (1 + SLACK)) for b in self.budget]

    def unit(self, v: np.ndarray) -> np.ndarray:
        v = v / np.abs(v).max(axis=1, keepdims=True)  # no over- or underflow in the norm
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def rotate(self, u: np.ndarray) -> np.ndarray:
        """Row by row the same, whatever rows stand beside it."""
        out = np.zeros((len(u), self.rotation.shape[1]))
        for k in range(u.shape[1]):
            out += u[:, k:k + 1] * self.rotation[k]
        return out

    def lead(self, rotated: np.ndarray, b: int) -> np.ndarray:
        at = self.parts[b].start
        two = rotated[:, at:at + 2]
        return two if two.shape[1] == 2 else np.pad(two, ((0, 0), (0, 1)))

    def cells(self, rotated: np.ndarray, b: int) -> np.ndarray:
        return np.floor(self.lead(rotated, b) / self.side[b]).astype(np.int64)

    def block_distances(self, z: np.ndarray) -> np.ndarray:
        """Squared length of each block of rotated differences; the same for a
        pair wherever it is computed, so that one block alone owns the pair."""
        r = self.rotate(z)
        return np.stack([np.square(r[:, p]).cumsum(axis=1)[:, -1] for p in self.parts], axis=1)


def _deal(space: Subspaces, v: np.ndarray, ids: np.ndarray, tiles: dict[tuple, int]):
    """(vector indices, pair key, side): the pairs of tiles that vectors are in."""
    rotated = space.rotate(space.unit(v))
    spread = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
    for b in range(len(space.parts)):
        cell, lead, side = space.cells(rotated, b), space.lead(rotated, b), space.side[b]
        homes, home = np.unique(cell, axis=0, return_inverse=True)
        home = home.reshape(-1)
        many = np.array([tiles[b, *h] for h in homes.tolist()], dtype=np.int64)
        own = spread % many[home]
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                other = cell + (dx, dy)
                gap = np.maximum(0, np.maximum(other * side - lead, lead - (other + 1) * side))
                near = np.flatnonzero(np.square(gap).sum(axis=1) <= space.budget[b] * (1 + SLACK))
                near = near[np.lexsort((own[near], home[near]))]
                cut = np.flatnonzero((np.diff(home[near]) != 0) | (np.diff(own[near]) != 0)) + 1
                for rows in np.split(near, cut) if len(near) else ():
                    h = homes[home[rows[0]]].tolist()
                    mine, there = (b, *h, int(own[rows[0]])), (b, h[0] + dx, h[1] + dy)
                    for t in range(tiles.get(there, 0)):
                        o = (*there, t)
                        yield rows, (mine, o) if mine <= o else (o, mine), 0 if mine <= o else 1


def join_tiles(space: Subspaces, b: int, left: np.ndarray, right: np.ndarray | None, cosine: float):
    """Index pairs that link between two tiles (or within one) and that block b owns."""
    same = right is None
    none = np.zeros(0, dtype=np.int64)
    if not len(left) or not (same or len(right)):
        return none, none
    turn = space.rotation.astype(np.float32)
    ly = space.unit(left.astype(np.float32)) @ turn
    ry = ly if same else space.unit(right.astype(np.float32)) @ turn
    columns = {}

    def distances(rows: slice, block: int) -> np.ndarray:
        """|x|^2 + |y|^2 - 2xy in one product of widened rows."""
        if block not in columns:
            y = ry[:, space.parts[block]]
            columns[block] = np.concatenate([-2 * y, np.square(y).sum(1, keepdims=True), np.ones((len(y), 1), np.float32)], axis=1).T
        x = ly[rows, space.parts[block]]
        one = np.ones((len(x), 1), np.float32)
        return np.concatenate([x, one, np.square(x).sum(1, keepdims=True)], axis=1) @ columns[block]

    found = [], []
    step = max(1, (1 << 21) // max(1, len(ry)))
    budget = np.array(space.budget)
    for at in range(0, len(ly), step):
        rows = slice(at, at + step)
        near = distances(rows, b) <= np.float32(budget[b] + MARGIN)
        if not near.any():
            continue
        if same:
            near &= np.arange(at, at + len(near))[:, None] < np.arange(len(ry))[None, :]
        for e in range(b):
            if not near.any():
                break
            near &= distances(rows, e) >= np.float32(budget[e] - MARGIN)
        i, j = np.nonzero(near)
        for s in range(0, len(i), 1 << 16):
            p, q = i[s:s + (1 << 16)] + at, j[s:s + (1 << 16)]
            lu, ru = space.unit(left[p]), space.unit((left if same else right)[q])
            linked = np.einsum("pd,pd->p", lu, ru) >= cosine
            p, q = p[linked], q[linked]
            within = space.block_distances(lu[linked] - ru[linked]) <= budget
            owned = within[:, b] & ~within[:, :b].any(axis=1)
            found[0].append(p[owned])
            found[1].append(q[owned])
    return np.concatenate([*found[0], none]), np.concatenate([*found[1], none])


def class_links(classes: DataFrame, space: Subspaces, cosine: float, tile: int) -> DataFrame:
    """(a, b, links) per class and pair of tiles in which it links: the number
    of vectors linked and the smallest class of its part of the forest."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rotated = space.rotate(space.unit(matrix(batch.column("e"), np.float64))) if batch.num_rows else None
            for b in range(len(space.parts) if batch.num_rows else 0):
                at, n = np.unique(space.cells(rotated, b), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), b)), pa.array(at[:, 0].copy()), pa.array(at[:, 1].copy()), pa.array(n)],
                    names=["b", "x", "y", "n"])

    # At most blocks * (2 / side + 2)^2 rows whatever the input: coordinates lie in [-1, 1].
    counted = (classes.select("e").mapInArrow(cells, "b bigint, x bigint, y bigint, n bigint")
               .groupBy("b", "x", "y").agg(F.sum("n").alias("n")).collect())
    tiles = {(r.b, r.x, r.y): -(-r.n // tile) for r in counted}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pulsewatch.llm import vectors as V
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                v, ids = matrix(part.column("e"), np.float64), part.column("rep").to_numpy()
                dealt = list(V._deal(space, v, ids, tiles))
                if dealt:
                    take = pa.array(np.concatenate([d[0] for d in dealt]))
                    n = [len(d[0]) for d in dealt]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([repr(d[1]) for d in dealt]).take(pa.array(np.repeat(np.arange(len(n)), n))),
                         pa.array(np.repeat([d[2] for d in dealt], n), pa.int32()), part.column("rep").take(take), part.column("m").take(take), part.column("e").take(take)],
                        names=["pair", "side", "rep", "m", "e"])

    def join(t: pa.Table) -> pa.Table:
        import ast

        from pulsewatch.llm import vectors as V
        left, right = ast.literal_eval(t["pair"][0].as_py())
        t = t.sort_by([("side", "ascending"), ("rep", "ascending")])
        n_left = int((t["side"].to_numpy() == 0).sum())
        v, rep, m = matrix(t["e"], np.float64), t["rep"].to_numpy(), t["m"].to_numpy()
        i, j = V.join_tiles(space, left[0], v[:n_left], None if left == right else v[n_left:], cosine)
        j = j if left == right else j + n_left
        low = V.forest(len(v), i, j)
        links = np.bincount(i, weights=m[j], minlength=len(v)) + np.bincount(j, weights=m[i], minlength=len(v))
        has = np.flatnonzero(links)
        return pa.table([pa.array(rep[has]), pa.array(rep[low[has]]), pa.array(links[has].astype(np.int64))],
                        names=["a", "b", "links"])

    pairs = classes.select("rep", "m", "e").mapInArrow(
        deal, "pair string, side int, rep bigint, m bigint, e " + dict(classes.dtypes)["e"])
    return pairs.groupBy("pair").applyInArrow(join, "a bigint, b bigint, links bigint")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.9,
                    blocks: int = 4, tile: int = 16384, sample: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine must lie in (0, 1]")
    ship(vectors.sparkSession)
    rows = vectors.select(vectors[vec_id].cast("bigint").alias("id"), vectors[embedding].alias("e"))
    usable = F.col("id").isNotNull() & finite(F.col("e")) & F.exists("e", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    common = rows.where("ok").groupBy(F.size("e").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = common.dim if common else 0
    h1, h2 = hash128(F.col("e"))
    rows = rows.withColumn("ok", F.col("ok") & (F.size("e") == dim))
    rows = rows.withColumn("h1", F.when(F.col("ok"), h1)).withColumn("h2", F.when(F.col("ok"), h2))
    classes = saved(rows.where("ok").groupBy("h1", "h2").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("e").alias("e")))
    first = classes.orderBy("h1", "h2").limit(sample).select("e").toArrow()
    space = Subspaces(matrix(first["e"], np.float64) if len(first) else np.zeros((0, dim)), max(dim, 2), cosine, blocks)
    linked = saved(class_links(classes, space, cosine, tile))
    degree = linked.groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(linked, "a", "b")
    named = (classes.select("h1", "h2", "rep", "m")
             .join(degree, F.col("rep") == F.col("a"), "left")
             .join(roots, F.col("rep") == F.col("node"), "left")
             .select(F.col("h1").alias("c1"), F.col("h2").alias("c2"),
                     (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n"),
                     F.coalesce("root", "rep").alias("component")))
    out = rows.select("id", "h1", "h2").join(named, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(False)).alias("kept"))
