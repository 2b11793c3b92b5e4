"""Mixing sources to target weights (operator 2).

Every source gets a target number of words.  A source's rows lie in blocks by a
keyed hash (``block_rows`` rows on average), so a block is a random part of its
source and a source of any size spreads over many blocks.  A target is whole
passes over the source plus a rest.  For the rest the rows are walked by block
and hash, and each that still fits is taken, until the rest is full or no row
left is small enough.  The walk is made of stretches: in each, the rows up to what
was missing at its start are taken whole up to the block that crosses it, and in
that block one by one.  What is missing after a stretch is less than a row that
was passed over, so there are few stretches.

The drawn blocks go to output shards by a splitting tree: each node divides the
block quotas of its shards between two halves by one multivariate hypergeometric
draw, seeded by the node, so every leaf can be computed alone, from the root.
A leaf holds, per source, a run of positions of the source's permuted blocks;
runs of different shards are disjoint and cover every drawn block once.  Rows
taken where less than a block was missing lie thin over many blocks; they ride
with the drawn blocks in turn.  Within a shard rows are shuffled by a keyed hash.

What the driver holds is one row of figures and the stretches per source.

Defined results: a NULL or empty text has size 0 and is never short of its
target; a NULL source is a source that comes last; repeated rows are rows each,
a NULL doc_id is allowed; an empty table gives no rows; all columns are kept whatever their
names, and those that the operator adds replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, names, packed, saved, ship, unpacked

#: Up to so many sources their table (about 100 bytes a row) is broadcast.
BROADCAST_SOURCES = 50_000


@dataclass
class Source:
    """Figures of a source: whole passes, and what is left after them."""

    number: int
    name: str | None
    size: int
    rows: int
    target: float = 0.0
    blocks: int = 1
    passes: int = 0
    rest: int = 0
    drawn: int = 0  # blocks of the pass that isn't whole
    #: Stretches of the rest: (last block, most words of a row, left for the last block).
    walk: list[tuple[int, int, int]] = field(default_factory=list)

    @property
    def draws(self) -> int:
        return self.passes * self.blocks + self.drawn

    @property
    def end(self) -> int:
        """Last block of the walk."""
        return min(self.walk[-1][0], self.blocks - 1) if self.walk else -1


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Share of all words by weight; a source stops at ``most`` times its size
    and the excess is shared anew by weight until none is above."""
    out = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in sorted(open_))
        over = [i for i in sorted(open_) if left * weights[i] / weight >= most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
            open_.remove(i)
    return out


def split(q: np.ndarray, n: int, rng: np.random.Generator, limit: int = 10 ** 9) -> np.ndarray:
    """``n`` of the blocks ``q``, drawn by a multivariate hypergeometric.  numpy draws from
    fewer than ``limit``; of more, most go in units of several blocks of a source,
    and what is left of the units by blocks, so that the numbers are exact."""
    total = int(q.sum())
    if total < limit:
        return rng.multivariate_hypergeometric(q, n, method="marginals")
    unit = -(-total // (limit // 2))
    units = np.maximum(q // unit - 1, 0)  # one unit of a source is dealt by blocks
    rest, whole = q - units * unit, int(units.sum())
    left = total - whole * unit
    drawn = min(max(n * whole // total, -(-(n - left) // unit), 0), n // unit, whole)
    return split(units, drawn, rng, limit) * unit + split(rest, n - drawn * unit, rng, limit)


def leaf(quotas: np.ndarray, shard: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first position, number) of each source's blocks in a shard: the path from
    the root, where each node splits its quotas between two halves."""
    lo, hi = 0, shards
    q, first = quotas.astype(np.int64), np.zeros(len(quotas), dtype=np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        total = int(q.sum())
        rng = np.random.default_rng([seed, lo, hi])
        left = split(q, total * (mid - lo) // (hi - lo), rng) if total else q
        if shard < mid:
            q, hi = left, mid
        else:
            first, q, lo = first + left, q - left, mid
    return first, q


def with_sizes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 7) -> DataFrame:
    """The rows with ``size`` (words of the text) and ``_mix`` (keyed hash)."""
    words = F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("bigint")
    h = F.xxhash64(F.lit(seed), docs[doc_id], docs[text])
    return docs.withColumns({"size": words, "_mix": h})


def _block(mix: str = "_mix", blocks: str = "_blocks"):
    """Block number of a row: its hash as a fraction of the source's blocks."""
    return F.floor(F.shiftrightunsigned(F.col(mix), 11) * F.lit(2.0 ** -53) * F.col(blocks)).cast("bigint")


def _sources(rows: DataFrame, source: str, weights: list[float], share: float, most: float, block_rows: int) -> list[Source]:
    got = rows.groupBy(F.col(source).alias("name")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    found = [Source(i, r["name"], r["size"], r["rows"])
             for i, r in enumerate(got.orderBy(F.asc_nulls_last("name")).toLocalIterator())]
    want = targets([s.size for s in found], [weights[s.number % len(weights)] for s in found], share, most)
    for s, t in zip(found, want):
        s.target, s.blocks = t, max(1, ceil(s.rows / block_rows))
        if s.size:
            s.passes = int(t // s.size)
            s.rest = round(t - s.passes * s.size)
    return found


def _figures(rows: DataFrame, found: list[Source], source: str) -> DataFrame:
    """Rows with the figures of their source: _s, _blocks and the like."""
    schema = ("_name string, _s bigint, _blocks bigint, _passes bigint, source_size bigint, target double, "
              "_walk array<struct<hi: bigint, most: bigint, left: bigint>>")
    table = rows.sparkSession.createDataFrame(
        [(s.name, s.number, s.blocks, s.passes, s.size, s.target, s.walk) for s in found], schema)
    if len(found) <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    return rows.join(table, rows[source].cast("string").eqNullSafe(F.col("_name"))).drop("_name")


def _fitting(size: np.ndarray, mix: np.ndarray, copies: np.ndarray, left: int) -> np.ndarray:
    """How many of the ``copies`` of each row are taken, one by one by hash, each
    that still fits."""
    takes = np.zeros(len(size), dtype=np.int64)
    for i in np.lexsort((size, mix)).tolist():
        if size[i] <= left:
            takes[i] = min(int(copies[i]), left // int(size[i])) if size[i] else copies[i]
            left -= int(takes[i] * size[i])
    return takes


def _copies(rows: DataFrame, *keys: str) -> DataFrame:
    """Equal rows (same hash and size) as one with their number: a block holds
    few different ones, however often they are repeated."""
    return rows.groupBy(*keys, "_mix", "size").agg(F.count(F.lit(1)).alias("copies"))


def _stretch(by: DataFrame, missing: dict[int, tuple[int, int]]) -> dict[int, tuple[int | None, int, int]]:
    """The next stretch of each source: (block that crosses what is missing or
    none, left for it, left after it), by two-level running sums.  ``missing``:
    (block walked last, words missing).  Sources without a fitting row are absent."""
    state = by.sparkSession.createDataFrame([(s, *x) for s, x in missing.items()], "s1 bigint, _after bigint, _left bigint")
    if len(missing) <= BROADCAST_SOURCES:
        state = F.broadcast(state)
    rest = by.join(state, F.col("_s") == F.col("s1")).where("_b > _after and size > 0 and size <= _left")
    blocks = saved(rest.groupBy("_s", "_left", "_b").agg(F.sum("size").alias("w")).withColumn("_super", F.expr("_b div 1024")))
    before = Window.partitionBy("_s").orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)
    supers = blocks.groupBy("_s", "_super").agg(F.sum("w").alias("w")).select(
        F.col("_s").alias("s2"), F.col("_super").alias("super2"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("before"))
    inner = Window.partitionBy("_s", "_super").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    at = (blocks.join(supers, (F.col("_s") == F.col("s2")) & (F.col("_super") == F.col("super2")))
          .withColumn("until", F.col("before") + F.coalesce(F.sum("w").over(inner), F.lit(0))))
    first = at.groupBy("_s", "_left").agg(
        F.min(F.when(F.col("until") + F.col("w") >= F.col("_left"), F.struct("_b", "until"))).alias("x"), F.sum("w").alias("w"))
    found, crossed = {}, []
    for r in first.toLocalIterator():  # one row a source
        if r["x"] is None:
            found[r["_s"]] = (None, 0, r["_left"] - r["w"])
        else:
            crossed.append((r["_s"], r["x"]["_b"], r["_left"] - r["x"]["until"]))
    if not crossed:
        return found
    table = by.sparkSession.createDataFrame(crossed, "s1 bigint, b1 bigint, _left bigint")
    if len(crossed) <= BROADCAST_SOURCES:
        table = F.broadcast(table)

    def fill(t: pa.Table) -> pa.Table:
        from pulsewatch.llm import mixing as M
        size, left = t["size"].to_numpy(), t["_left"][0].as_py()
        after = left - int((size * M._fitting(size, t["_mix"].to_numpy(), t["copies"].to_numpy(), left)).sum())
        return pa.table({"_s": t["_s"][:1], "_b": t["_b"][:1], "left": [left], "after": [after]})

    inside = by.join(table, (F.col("_s") == F.col("s1")) & (F.col("_b") == F.col("b1"))).select("_s", "_b", "size", "_mix", "_left")
    for r in _copies(inside, "_s", "_b", "_left").groupBy("_s").applyInArrow(fill, "_s bigint, _b bigint, left bigint, after bigint").toLocalIterator():
        found[r["_s"]] = (r["_b"], r["left"], r["after"])
    return found


def _draw_rest(rows: DataFrame, found: list[Source], source: str) -> None:
    """The stretches that make up the rest of each source, and its drawn blocks:
    those up to the last stretch that began with at least a block missing."""
    by = saved(_figures(rows.select(source, "size", "_mix"), [s for s in found if s.rest], source).select(
        "_s", _block().alias("_b"), "size", "_mix"))
    missing = {s.number: (-1, s.rest) for s in found if s.rest}
    while missing:
        met = _stretch(by, missing)
        for number, (b, left, after) in met.items():
            s, most = found[number], missing[number][1]
            s.walk.append((s.blocks if b is None else b, most, left))
            if len(s.walk) == 1 or most * s.blocks >= s.size:
                s.drawn = s.end + 1
        missing = {n: (b, after) for n, (b, _, after) in met.items() if b is not None and after}


def _shards_of_blocks(rows: DataFrame, found: list[Source], shards: int, seed: int) -> DataFrame:
    """(_s, _b, draws array<struct<epoch, shard>>) of every drawn block and of
    those whose rows ride with it."""
    quotas = np.array([s.draws for s in found], dtype=np.int64)
    live = np.flatnonzero(quotas)
    # Positions are visited in steps coprime with their number: a permutation.
    step = []
    for n in quotas[live].tolist():
        a = max(1, int(n * 0.6180339887))
        while gcd(a, n) != 1:
            a += 1
        step.append(a)
    steps, of_pass, passes, drawn_blocks, ends = (np.array(x, dtype=np.int64).reshape(-1) for x in (
        step, *zip(*[(s.blocks, s.passes, max(1, s.drawn), s.end) for s in (found[i] for i in live)]))) if step else (quotas,) * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pulsewatch.llm import mixing as M
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                first, n = M.leaf(quotas[live], shard, shards, seed)
                which = np.repeat(np.arange(len(live)), n)
                # The first of a run of positions exactly, the others from it: no overflow.
                start = np.array([f * s % q for f, s, q in zip(first.tolist(), step, quotas[live].tolist())], dtype=np.int64)
                onward = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                drawn = (start[which] + onward * steps[which]) % quotas[live][which]
                b, epoch = drawn % of_pass[which], drawn // of_pass[which]
                to = np.where(epoch == passes[which], np.maximum(b, ends[which]), b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(live[which]), pa.array(b), pa.array(to), pa.array(drawn_blocks[which]), pa.array(epoch),
                     pa.array(np.full(len(which), shard))], names=["_s", "_b", "_to", "_by", "epoch", "shard"])

    spark = rows.sparkSession
    leaves = spark.range(shards).mapInArrow(run, "_s bigint, _b bigint, _to bigint, _by bigint, epoch bigint, shard bigint")
    leaves = leaves.select("_s", F.explode(F.expr("sequence(_b, _to, _by)")).alias("_b"), "epoch", "shard")
    return leaves.groupBy("_s", "_b").agg(F.collect_list(F.struct("epoch", "shard")).alias("draws"))


def mix(rows: DataFrame, source: str = "source", weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5,
        most: float = 2.0, block_rows: int = 64, shard_words: int = 1_000_000, seed: int = 7) -> DataFrame:
    """All rows with source_size, target, taken and draws (epoch, shard of every
    time a row is drawn).  ``rows``: of ``with_sizes``.

    ``weights`` go to the sources in code point order, repeating; ``share``: words
    of the mix by words of all rows; ``most``: a source's target by its size.
    """
    if not 0 < share <= most:
        raise ValueError("share must lie in (0, most]")
    ship(rows.sparkSession)
    added = ["source_size", "target", "taken", "draws"]
    columns = names(rows, added)
    slim = saved(rows.select(rows[source].alias("_source"), "size", "_mix"))
    rows = rows.select(packed(rows, added).alias("_row"), rows[source].alias("_source"), "size", "_mix")
    source = "_source"
    found = _sources(slim, source, list(weights), share, most, block_rows)
    if any(s.rest for s in found):
        _draw_rest(slim, found, source)
    shards = max(1, ceil(sum(s.target for s in found) / shard_words))
    blocks = saved(_shards_of_blocks(rows, found, shards, seed))
    numbered = _figures(rows, found, source).withColumn("_at", _block()).withColumnRenamed("_s", "_number").drop("_source")
    marked = numbered.join(blocks, (F.col("_number") == F.col("_s")) & (F.col("_at") == F.col("_b")), "left").drop("_s", "_b")
    marked = marked.withColumn("draws", F.coalesce("draws", F.array().cast(dict(blocks.dtypes)["draws"])))
    stretch = F.expr("filter(_walk, x -> x.hi >= _at)")  # the first of them is the block's own
    marked = marked.withColumn("_in", F.get(stretch, F.lit(0))).withColumns(
        {"_last": F.coalesce(F.col("_in.hi") == F.col("_at"), F.lit(False)), "_left": F.col("_in.left"),
         "_most": F.col("_in.most")}).drop("_in", "_walk")
    whole = marked.where("not _last").withColumn("_fits", F.coalesce(F.col("size") <= F.col("_most"), F.lit(False)))
    out = whole.unionByName(_last_blocks(marked.where("_last"), _takes(slim, found, source)))
    out = out.withColumn("draws", F.expr("if(_fits, draws, filter(draws, x -> x.epoch != _passes))"))
    out = out.withColumn("taken", (F.size("draws") * F.col("size")).cast("bigint"))
    return out.select(*unpacked("_row", columns), *added)


def _takes(slim: DataFrame, found: list[Source], source: str) -> DataFrame:
    """(n, m, z, copies, takes): of the rows of a source's last blocks by hash
    and size, how many there are and how many are taken."""
    at = _figures(slim, found, source).withColumn("_b", _block())
    at = at.withColumn("_in", F.get(F.expr("filter(_walk, x -> x.hi >= _b)"), F.lit(0))).where("_in.hi = _b")

    def fit(t: pa.Table) -> pa.Table:
        from pulsewatch.llm import mixing as M
        takes = M._fitting(t["size"].to_numpy(), t["_mix"].to_numpy(), t["copies"].to_numpy(), t["_left"][0].as_py())
        return pa.table({"n": t["_s"], "m": t["_mix"], "z": t["size"], "copies": t["copies"], "takes": pa.array(takes)})

    rows = _copies(at.withColumn("_left", F.col("_in.left")), "_s", "_b", "_left")
    return saved(rows.groupBy("_s", "_b").applyInArrow(fit, "n bigint, m bigint, z bigint, copies bigint, takes bigint"))


def _last_blocks(rows: DataFrame, takes: DataFrame) -> DataFrame:
    """The rows of last blocks with ``_fits``.  Of equal rows that are taken in
    part the first are, counted in two levels so that many don't meet in a task."""
    known = rows.join(takes, (F.col("_number") == F.col("n")) & (F.col("_mix") == F.col("m")) & (F.col("size") == F.col("z")))
    partly = "takes > 0 and takes < copies"
    out = known.withColumn("_fits", F.col("takes") > 0)
    if not takes.where(partly).isEmpty():
        some = saved(known.where(partly).withColumn("_nr", F.monotonically_increasing_id()))
        some = some.withColumn("_salt", F.col("_nr") % 256)
        keys = ["n", "m", "z", "_salt"]
        before = Window.partitionBy("n", "m", "z").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
        counts = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("_nr"))
        some = some.join(counts.drop("_c"), keys).withColumn("_fits", F.col("_before") + place <= F.col("takes"))
        out = out.where(f"not ({partly})").unionByName(some.drop("_salt", "_before", "_nr"))
    return out.drop("n", "m", "z", "copies", "takes")


def drawn_rows(mixed: DataFrame, columns: list[str], doc_id: str = "doc_id", seed: int = 7) -> DataFrame:
    """One row per draw, dealt to the output shards and shuffled within each."""
    each = mixed.select(packed(mixed.select(*columns)).alias("_row"), mixed[doc_id].alias("_id"), F.explode("draws").alias("_draw"))
    order = F.xxhash64(F.lit(seed), F.col("_draw.shard"), F.col("_draw.epoch"), F.col("_id"))
    return each.withColumn("_order", order).withColumn("_shard", F.col("_draw.shard")).repartition("_shard") \
        .sortWithinPartitions("_shard", "_order").select(*unpacked("_row", columns))
