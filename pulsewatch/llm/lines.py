"""Line dedup (operator 5), DataFrame functions only.

Every line becomes a 128-bit key hash with its document and position.  The
hashes are range-partitioned and sorted by (hash, document, position), so a
window streams over the occurrences of a key and its first document is the one
it starts with.  A key may hold a third of all lines, so this is done in two
levels: first within (hash, salt of the document), which leaves the lines of at
most ``salts`` documents per hash, then within the hash alone.  What is dropped
comes back as one keep bitmap per document: 64-bit words by number, words
that keep every line left out.  Text is never shuffled with the lines; it meets
the bitmap once.

Defined results: a NULL or empty text is one empty line; repeated rows of one
doc_id and text share a bitmap, and rows of one doc_id with other texts are the
same document; a NULL doc_id is one document that comes after all others; an
empty table gives no rows; extra columns are kept whatever their names, and the
columns that the operator adds replace those of the same name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash128, names, packed, unpacked

SPACE = " \t\n\x0b\x0c\r"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def ascii_lower(s: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.when(F.octet_length(s) == F.char_length(s), F.lower(s)).otherwise(
        F.translate(s, string.ascii_uppercase, string.ascii_lowercase))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _later_than_first(occ: DataFrame, keys: list[str]) -> DataFrame:
    """Range-partition by the keys, sort by document and position within, and
    mark the lines whose document isn't the first of their key."""
    first = F.first("_doc").over(Window.partitionBy(*keys).orderBy(*keys, "_doc", "_pos")
                                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (occ.repartitionByRange(*keys).sortWithinPartitions(*keys, "_doc", "_pos")
            .withColumn("_later", F.col("_doc") != first))


def keep_bitmaps(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 10,
                 salts: int = 64) -> DataFrame:
    """(_doc, _text_hash, keep map<int, bigint>) of the documents that lose lines."""
    doc = F.coalesce(docs[doc_id].cast("bigint"), F.lit((1 << 63) - 1))
    lines = docs.select(doc.alias("_doc"), F.xxhash64(docs[text]).alias("_text_hash"),
                        F.posexplode(split_lines(docs[text])).alias("_pos", "_line"))
    lines = lines.withColumn("_key", line_key(F.col("_line"))).where(F.char_length("_key") >= min_chars)
    h1, h2 = hash128(F.col("_key"))
    occ = lines.select(h1.alias("_h1"), h2.alias("_h2"),
                       F.pmod(F.xxhash64("_doc"), F.lit(salts)).cast("int").alias("_salt"),
                       "_doc", "_text_hash", "_pos")
    by_salt = _later_than_first(occ, ["_h1", "_h2", "_salt"])
    by_key = _later_than_first(by_salt.where("not _later").drop("_later", "_salt"), ["_h1", "_h2"])
    lost = (by_salt.where("_later").select("_doc", "_text_hash", "_pos")
            .unionByName(by_key.where("_later").select("_doc", "_text_hash", "_pos")))
    bit = F.expr("shiftleft(1L, _pos % 64)")
    words = (lost.repartition("_doc", "_text_hash").withColumn("_word", F.expr("cast(_pos div 64 as int)"))
             .groupBy("_doc", "_text_hash", "_word").agg(F.bitwise_not(F.bit_or(bit)).alias("_bits")))
    return words.groupBy("_doc", "_text_hash").agg(
        F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("keep"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 10,
                salts: int = 64) -> DataFrame:
    """The documents with the lines they keep, and n_lines, n_dropped, keep.

    ``min_chars``: keys of fewer code points are always kept.
    """
    bitmaps = keep_bitmaps(docs, text, doc_id, min_chars, salts)
    added = ["n_lines", "n_dropped", "keep"]
    kept_columns = names(docs, added)
    doc = F.coalesce(docs[doc_id].cast("bigint"), F.lit((1 << 63) - 1))
    base = docs.select(packed(docs, [*added, text]).alias("_row"), docs[text].cast("string").alias("_text"), doc.alias("_d"),
                       F.xxhash64(docs[text]).alias("_t"))
    joined = base.join(bitmaps, (F.col("_d") == F.col("_doc")) & (F.col("_t") == F.col("_text_hash")), "left")
    lines = split_lines(F.col("_text"))
    flags = F.expr("""flatten(transform(sequence(0, cast((_n - 1) div 64 as int)),
        w -> transform(sequence(0, 63), b -> getbit(coalesce(keep[w], -1L), b) = 1)))""")
    kept = F.filter(F.zip_with(lines, flags, lambda x, f: F.when(f, x)), lambda x: x.isNotNull())
    out = (joined.withColumn("_n", F.size(lines))
           .withColumn("_kept", F.when(F.col("keep").isNotNull(), kept))
           .withColumn("n_lines", F.col("_n").cast("bigint"))
           .withColumn("n_dropped", F.when(F.col("keep").isNull(), F.lit(0).cast("bigint"))
                       .otherwise(F.col("_n") - F.size("_kept")).cast("bigint"))
           .withColumn("_shown", F.when(F.col("keep").isNull(), F.coalesce(F.col("_text"), F.lit("")))
                       .otherwise(F.array_join("_kept", "\n"))))
    return out.select(*unpacked("_row", kept_columns, {text: F.col("_shown")}), *added)
