"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsewatch.session import ensure_checkpoint_dir

# The white space of the word contracts: space and \t \n \v \f \r.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that Python
    tasks can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_pulsewatch_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="pulsewatch-"), "pulsewatch_tasks.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("pulsewatch", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._pulsewatch_shipped = True


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there
    and a lost executor costs a reread, not a recomputation."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def saved(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def hash128(*cols: Column) -> tuple[Column, Column]:
    """Two chained 64-bit hashes: equal values only, for all practical sizes."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)


def packed(df: DataFrame, without: Sequence[str] = ()) -> Column:
    """The columns of a table, but those named, as one struct: an operator's own columns
    beside it can't meet theirs."""
    return F.struct(*[df[f"`{c}`"] for c in names(df, without)])


def names(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    """The columns of a table but those named, whatever their case."""
    drop = {w.lower() for w in without}
    return [c for c in df.columns if c.lower() not in drop]


def unpacked(row: str, columns: Sequence[str], instead: dict[str, Column] | None = None) -> list[Column]:
    """The columns of a struct of ``packed``, some with another value."""
    other = {k.lower(): v for k, v in (instead or {}).items()}
    return [other.get(c.lower(), F.col(row).getField(c)).alias(c) for c in columns]


def crc32_mod(col: Column, n: int) -> Column:
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n))


def matrix(column, dtype):
    """A non-null Arrow list column of equal lengths as a 2-d numpy array."""
    import pyarrow as pa
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def slices(batch, column: int, size: int):
    """Parts of a record batch whose strings in ``column`` take about ``size`` bytes
    together; a longer string is a part by itself."""
    import numpy as np
    import pyarrow.compute as pc
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(upto[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + size, side="right")))
        yield batch.slice(at, end - at)
        at = end


def give_back() -> None:
    """Return freed memory to the system at the end of a task: the worker stays for
    the stages to come, and what it holds idle they lack."""
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)
