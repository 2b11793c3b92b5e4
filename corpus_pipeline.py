"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, packing.

Each stage works on all rows that its predecessor kept; all but the last return
the columns of ``documents``.  Between stages the rows are written as Parquet to
the shared folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsewatch.llm import lines, mixing, simhash, toxicity
from pulsewatch.llm.common import table, written
from pulsewatch.llm.queries import pack_digest, toxicity_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    return toxicity.reject(docs, toxicity_model(spark, docs, sf_dir)).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the lines that an earlier one holds cut out."""
    kept = lines.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))
    return kept.select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs, shingle=3, max_bits=3).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, by output shard, shuffled."""
    return mixing.drawn_rows(mixing.mix(mixing.with_sizes(docs)), COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 tokens."""
    return pack_digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Fingerprints, hypergeometric draws and token ids aren't SQL; the stages are
#: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
