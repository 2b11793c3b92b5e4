"""Small frames with the hard cases that every operator must take."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, pos int, keep string"
#: Names that operators use inside: columns of the caller that have them are kept.
INTERNAL = ("_doc _text_hash _n _d _t _kept _row _text _shown _found _pieces _values _s _name _number _b _at _in _last "
            "_left _most _fits _passes _blocks _walk _salt _nr _before _draw _order _shard _of fp h root one p n m z _id").split()


def docs(spark, texts, sources=None, parts=3):
    rows = [(i, t, "en", (sources[k] if sources else "s"), len(t or ""), "x", 7, 1, "k")
            for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def hard_texts(seed=3, n=40):
    """(doc_id, text): nulls, empties, a very long text, copies, near copies."""
    r = random.Random(seed)
    words = ["ab", "cde", "fghi", "jk", "Lmn", "opq", "éa", "stu", "v", "wxyz"]
    line = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared = [line(6) for _ in range(4)]
    out = [(0, None), (1, ""), (2, " \t "), (3, "\n\n")]
    for i in range(4, n):
        ls = [line(r.randint(1, 12)) for _ in range(r.randint(1, 8))] + r.sample(shared, r.randint(0, 3))
        r.shuffle(ls)
        out.append((i, "\n".join(ls)))
    out.append((n, "\n".join(line(10) for _ in range(3000))))  # very long
    out += [(n + 1, out[5][1]), (n + 2, out[5][1]), (n + 3, out[6][1].upper()), (n + 4, out[7][1] + " more")]
    out.append(out[8])  # a repeated row
    return out


def same_rows(df, expected):
    got = sorted(map(tuple, df.collect()), key=repr)
    assert got == sorted(map(tuple, expected), key=repr)


def lit_hash(spark, value):
    return spark.range(1).select(F.xxhash64(F.lit(value))).first()[0]


def clashing(df):
    """The frame with a column of every internal name."""
    return df.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in INTERNAL})


def clashes_kept(df):
    """Every row has the columns of ``clashing`` as they were."""
    for r in df.collect():
        for c in INTERNAL:
            assert r[c] == f"{c}:{'none' if r.doc_id is None else r.doc_id}", c
    return df
