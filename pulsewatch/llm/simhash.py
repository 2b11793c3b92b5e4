"""SimHash near-dedup (operator 6).

A fingerprint has 8 positional bytes; two fingerprints that differ in at most
3 bits share at least 5 of them.  The inverted index is keyed by groups of
positional bytes: of the 14 groups of four positions whose numbers xor to zero
(the planes of the 8 points), the one that avoids any three differing
positions is always shared, so every such pair meets in a posting, while a
posting stays 2^24 times shorter than that of one byte alone.  In a posting the
shared positional bytes of each pair are tallied, pairs with the guaranteed
minimum are kept and verified by their differing bits.

Equal fingerprints are one class from the start.  A posting of more than
``tile`` classes is split into tiles, and pairs of tiles are dealt to tasks.  A
task returns a spanning forest of the links it finds, so the links of a group
stay in proportion to the group.

Defined results: a NULL or empty text has fingerprint zero, linked like any
other; repeated rows get one row each; a NULL doc_id gets its component from
the others of its class and counts for nothing itself; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, packed, saved, ship, unpacked, written
from .graph import components

SEED = 42


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Unsigned fingerprint of a text: bytes.lower() and bytes.split() treat
    exactly A-Z and the white space of the contract."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1, out=starts[1:])
    first = starts[:n].tolist()
    last = (starts[min(shingle, len(words)):][:n] - 1).tolist()
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(first[at:at + (1 << 15)], last[at:at + (1 << 15)])])
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
        for k in range(0, len(bits), 255):  # sums of up to 255 ones fit a byte
            ones += np.add.reduce(bits[k:k + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3,
                 also: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, fp bigint) of every row, and the bigint columns ``also``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pulsewatch.llm.simhash import fingerprint as of
        for batch in batches:
            fps = [of(t.as_py(), shingle) for t in batch.column(1)]
            signed = np.array(fps, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed), *batch.columns[2:]], names=names)
        give_back()

    also = also or {}
    names = ["doc_id", "fp", *also]
    picked = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").cast("binary").alias("b"),
                         *[c.alias(n) for n, c in also.items()])
    return picked.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def byte_groups(max_bits: int) -> list[tuple[int, ...]]:
    """Groups of byte positions of which any pair within max_bits shares one."""
    if max_bits <= 3:
        return [g for g in combinations(range(8), 4) if not g[0] ^ g[1] ^ g[2] ^ g[3]]
    if max_bits > 7:
        raise ValueError("at most 7 differing bits: beyond that no positional byte need be shared")
    return list(combinations(range(8), 8 - max_bits))


def posting_keys(fp: Column, max_bits: int) -> Column:
    keys = []
    for number, group in enumerate(byte_groups(max_bits)):
        parts = [F.shiftright(fp, 8 * p).bitwiseAND(F.lit(255)) for p in group]
        keys.append(F.struct(F.lit(number).alias("g"), F.concat_ws("-", *parts).alias("k")) if len(group) > 4 else
                    F.struct(F.lit(number).alias("g"), sum(
                        (F.shiftleft(x, 8 * i) for i, x in enumerate(parts)), F.lit(0).cast("bigint")).alias("k")))
    return F.explode(F.array(*keys))


def linked_within(fps: np.ndarray, split: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of a posting (split 0) or between its first ``split``
    fingerprints and the rest: tally of shared bytes, then differing bits."""
    left, right = (fps, fps) if not split else (fps[:split], fps[split:])
    out_i, out_j = [], []
    step = max(1, (1 << 21) // max(1, len(right)))
    for at in range(0, len(left), step):
        x = left[at:at + step, None] ^ right[None, :]
        shared = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=2, dtype=np.uint8)
        i, j = np.nonzero(shared >= 8 - max_bits)
        near = np.bitwise_count(x[i, j]) <= max_bits
        i, j = i[near] + at, j[near] + split
        near = i < j
        out_i.append(i[near])
        out_j.append(j[near])
    return np.concatenate(out_i), np.concatenate(out_j)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes reaches by the links."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if np.array_equal(low, before):
            return low


def _cells(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Runs of equal ``columns`` in sorted batches: (sides, fingerprints), whole."""
    held, last = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], axis=1)
        rows = np.stack([batch.column("t").to_numpy(zero_copy_only=False),
                         batch.column("fp").to_numpy(zero_copy_only=False)], axis=1)
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts = [0, *cut.tolist(), len(rows)]
        for s, e in zip(starts, starts[1:]):
            if last is not None and (keys[s] == last).all():
                held.append(rows[s:e])
            else:
                if held:
                    yield np.concatenate(held)
                held, last = [rows[s:e]], keys[s]
    if held:
        yield np.concatenate(held)


def links(classes: DataFrame, max_bits: int = 3, tile: int = 2048) -> DataFrame:
    """(a, b) spanning the links of distinct fingerprints (column fp)."""
    ship(classes.sparkSession)
    entries = classes.select("fp", posting_keys(F.col("fp"), max_bits).alias("p")).select("p.g", "p.k", "fp")
    if dict(entries.dtypes)["k"] == "string":
        entries = entries.withColumn("k", F.xxhash64("k"))
    sizes = entries.groupBy("g", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = entries.join(sizes, ["g", "k"]).withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    met = met.withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    cells = met.select("g", "k", "t", "fp", F.explode(F.expr("sequence(0, tiles - 1)")).alias("o")).select(
        "g", "k", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", "fp")
    cell = ["g", "k", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pulsewatch.llm import simhash as S
        a, b, n = [], [], 0
        for rows in S._cells(batches, ["g", "k", "i", "j"]):
            fps = rows[:, 1].copy().view(np.uint64)
            if len(fps) < 2:
                continue
            split = int((rows[:, 0] == rows[0, 0]).sum())
            i, j = S.linked_within(fps, 0 if split == len(fps) else split, max_bits)
            low = S.forest(len(fps), i, j)
            other = np.flatnonzero(low != np.arange(len(fps)))
            a.append(rows[other, 1])
            b.append(rows[low[other], 1])
            n += len(other)
            if n >= 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b, n = [], [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return cells.repartition(*cell).sortWithinPartitions(*cell, "t").mapInArrow(run, "a bigint, b bigint").distinct()


def _members(fps: DataFrame, max_bits: int, tile: int) -> DataFrame:
    """(_fp, low_doc, root) of every fingerprint of ``fps`` (doc_id, fp)."""
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("low_doc"))
    roots = components(links(classes.select("fp"), max_bits, tile), "a", "b")
    return classes.join(roots, classes["fp"] == roots["node"], "left").select(
        F.col("fp").alias("_fp"), "low_doc", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3,
                    max_bits: int = 3, tile: int = 2048) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) of every row."""
    fps = saved(fingerprints(docs, text, doc_id, shingle))
    named = _members(fps, max_bits, tile)
    lowest = named.groupBy("root").agg(F.min("low_doc").alias("component_id"))
    member = named.join(lowest, "root").select("_fp", "component_id")
    return fps.join(member, fps["fp"] == member["_fp"]).select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3,
             max_bits: int = 3, tile: int = 2048) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id, and
    of rows that repeat it the first by a hash of the text.  Rows without an id
    stay where their group has no other.  All columns are kept, whatever their names."""
    # Rows are numbered and written: a row is known by its number whatever its
    # id, and a number that is kept meets one row.
    rows = docs.select(packed(docs).alias("_doc"), F.monotonically_increasing_id().alias("_row"))
    rows = written(docs.sparkSession, rows, "numbered")
    asked = rows.select(F.col("_doc").getField(text).alias("text"), F.col("_doc").getField(doc_id).alias("doc_id"), "_row")
    fps = saved(fingerprints(asked, "text", "doc_id", shingle, {"h": F.xxhash64(asked["text"]), "_row": asked["_row"]}))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "_row")
    one = fps.groupBy("fp").agg(F.min(first).alias("one"))
    found = one.join(_members(fps, max_bits, tile), F.col("fp") == F.col("_fp"))
    kept = found.groupBy("root").agg(F.min("one").alias("one")).select(F.col("one._row").alias("_kept"))
    return rows.join(kept, rows["_row"] == kept["_kept"]).select(*unpacked("_doc", docs.columns))
