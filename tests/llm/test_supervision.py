"""Operators 11 to 13 against brute force."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsewatch.llm import centroids, quality, resample

from .helpers import docs, empty_docs, hard_texts

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    inside = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def texts_of_quality():
    r = np.random.default_rng(5)
    plain = ["the", "river", "of", "stone", "walked", "and", "garden", "with", "morning", "from", "light", "quiet"]
    out = hard_texts(seed=7)
    at = 1000
    for _ in range(60):
        ws = [str(w) for w in r.choice(plain, 80)]
        ws = [w + "." if k % 9 == 8 else w for k, w in enumerate(ws)]
        out.append((at, " ".join(ws)))
        at += 1
    for k in range(20):
        ws = [str(w) for w in r.choice(plain, 80)]
        junk = [" ".join(w + "###" for w in ws), " ".join(w.upper() + "!!" for w in ws), " | ".join(ws),
                " ".join(w for w in ws[:9] for _ in range(8))]
        out.append((at, junk[k % 4]))
        at += 1
    return out


def plain_em(votes):
    """Expectation-maximisation over documents, not patterns."""
    rules, (gr, gw), (br, bw) = range(len(quality.RULES)), quality.PRIOR_GOOD, quality.PRIOR_BAD
    share, acc, q = 0.5, [(gr / (gr + gw), br / (br + bw)) for _ in rules], [0.0] * len(votes)
    for _ in range(500):
        new = []
        for v in votes:
            good, bad = math.log(share), math.log(1 - share)
            for (a, b), x in zip(acc, v):
                if x == "+":
                    good, bad = good + math.log(a), bad + math.log(1 - b)
                elif x == "-":
                    good, bad = good + math.log(1 - a), bad + math.log(b)
            new.append(1 / (1 + math.exp(min(500, max(-500, bad - good)))))
        if max(abs(x - y) for x, y in zip(q, new)) < 1e-13:
            return new
        q, share = new, (sum(new) + 1) / (len(new) + 2)
        acc = []
        for j in rules:
            tell = lambda side, good: sum(x if good else 1 - x for x, v in zip(q, votes) if v[j] == side)  # noqa: B023, E731
            gp, gm, bm, bp = tell("+", True) + gr, tell("-", True) + gw, tell("-", False) + br, tell("+", False) + bw
            acc.append((gp / (gp + gm), bm / (bm + bp)))
    return q


def test_quality_matches_brute_force(spark):
    data = texts_of_quality()
    got = quality.judge(docs(spark, data, parts=5)).collect()
    want = {}
    for i, t in data:
        want.setdefault(i, plain_counts(t))
    assert len(got) == len(data)
    order = [r["votes"] for r in got]
    posterior = plain_em(order)
    for r, p in zip(got, posterior):
        assert tuple(r[c] for c in quality.COUNTS) == want[r["doc_id"]], r
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed
        assert abs(r["posterior"] - p) < 1e-6
        assert r["kept"] == (not failed and r["posterior"] >= 0.5)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert set(range(1000, 1060)) <= kept and not kept & set(range(1060, 1080))


def test_quality_of_given_documents(spark):
    from pulsewatch.llm.common import table
    sf = "/root/testdata/sf0.01"
    got = quality.judge(table(spark, sf, "documents"))
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("good"))
    r = {(x["good"], x["kept"]): x["n"] for x in got.where("not base_failed").join(labels, "doc_id")
         .groupBy("good", "kept").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert r.get((1, False), 0) <= 0.005 * r[1, True]
    assert r[0, False] >= 0.9 * (r[0, False] + r.get((0, True), 0))


def test_quality_of_no_rows_and_no_texts(spark):
    assert quality.judge(empty_docs(spark)).collect() == []
    got = quality.judge(docs(spark, [(1, None), (2, ""), (None, " \n")])).collect()
    assert sorted(repr(r["doc_id"]) for r in got) == ["1", "2", "None"]
    assert all(r["base_failed"] and not r["kept"] and r["n_words"] == 0 for r in got)


def test_windows_do_not_cross_texts():
    same = "a b c d e f g h"
    assert [m[4] for m in quality.measure([same, same, same + " x " + same, None])] == [0, 0, 16, 0]


SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int, v int"


def vector_rows(n=400, dim=64, seed=2):
    r = np.random.default_rng(seed)
    v = (r.normal(size=(n, dim)) * 0.1).astype(np.float32)
    v[50:90] = v[49]                                # copies
    out = [(i, x.tolist()) for i, x in enumerate(v)]
    out += [(n, None), (n + 1, []), (n + 2, [0.0] * dim), (n + 3, [float("nan")] * dim), (n + 4, [float("inf")] * dim),
            (n + 5, [None] + [1.0] * (dim - 1)), (n + 6, [1.0] * (dim + 1)), (None, v[3].tolist()), (5, v[5].tolist()),
            (n + 7, [3e38] * dim)]
    return out


def brute_lloyd(data, k, rounds, dim=64):
    def fine(v):
        return v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(x) * 256 < centroids.LARGEST for x in v)
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in data if fine(v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cents = [v for _, v in first]

    def assign():
        x = np.array([v for _, v in kept], dtype=np.int64)
        d = ((x[:, None, :] - np.array(cents, dtype=np.int64)[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        c, _ = assign()
        for j in range(len(cents)):
            mine = [kept[p][1] for p in np.flatnonzero(c == j)]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    c, d = assign()
    spent = {j: int(d[c == j].sum()) for j in range(len(cents))}
    return sorted(((i, int(j), int(x), spent[int(j)], int(d.sum()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest())
                   for (i, _), j, x in zip(kept, c, d)), key=repr)


@pytest.mark.parametrize("k,rounds,width,chunk", [(40, 5, 2, 64), (7, 3, 5, 1000), (500, 2, 1, 97)])
def test_centroids_match_brute_force(spark, k, rounds, width, chunk):
    data = vector_rows()
    df = spark.createDataFrame([(i, v, "c", 1, 2) for i, v in data], SCHEMA).repartition(5)
    got = centroids.cluster(df, k=k, rounds=rounds, width=width, chunk=chunk).collect()
    assert sorted(map(tuple, got), key=repr) == brute_lloyd(data, k, rounds)


def test_centroids_of_no_rows(spark):
    for data in ([], [(1, None), (2, [1.0])], [(None, [0.5] * 64)]):
        df = spark.createDataFrame([(i, v, "c", 1, 2) for i, v in data], SCHEMA)
        assert centroids.cluster(df).collect() == []


def plain_resample(data, target, percent, buckets):
    def feats(t):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)
        return [zlib.crc32(x.encode()) % buckets for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]], len(w)
    s, t = [0] * buckets, [0] * buckets
    for _, x in data:
        for b in feats(x)[0]:
            s[b] += 1
    for x in target:
        for b in feats(x)[0]:
            t[b] += 1
    g = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in data:
        f, n = feats(x)
        w = sum(g[b] for b in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), w, score, n])
    may = sorted((r for r in rows if r[0] is not None and r[4] >= 20), key=lambda r: (-r[3], r[0]))
    drawn = {id(r): k + 1 for k, r in enumerate(may[:len(may) * percent // 100])}
    return sorted((tuple(r[:4]) + (drawn.get(id(r)),) for r in rows), key=repr)


TARGET = "item_id long, text string, score int"


@pytest.mark.parametrize("percent,buckets,segment_rows", [(25, 10_000, 1 << 20), (100, 50, 7), (60, 1000, 3), (0, 10, 5)])
def test_resample_matches_brute_force(spark, percent, buckets, segment_rows):
    data = hard_texts(seed=11, n=150)
    data += [(500 + k, "Ünder the ABC def " * 9 + "x²") for k in range(30)] + [(None, "a b c " * 20)]
    data = list(dict.fromkeys(data))  # the place among rows of one id is free: tested below
    target = ["ab cde the def", None, "", "opq stu jk abc DEF abc"]
    frame = docs(spark, data, parts=4).withColumn("score", F.lit(1)).withColumn("rank", F.lit("r")).withColumn("row", F.lit(2))
    bench = spark.createDataFrame([(k, x, 1) for k, x in enumerate(target)], TARGET)
    got = resample.resample(frame, bench, percent=percent, buckets=buckets, segment_rows=segment_rows)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resample(data, target, percent, buckets)


def test_resample_ties_and_empty_tables(spark):
    bench = spark.createDataFrame([], TARGET)
    assert resample.resample(empty_docs(spark), bench).collect() == []
    one = docs(spark, [(3, "a b c d " * 6)] * 200 + [(4, "e " * 30)])
    got = resample.resample(one, bench, percent=50, segment_rows=10).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 101)) and len(got) == 201


def test_samples_are_regular_and_bounded(spark):
    rows = spark.range(10_000).select((F.col("id") % 7).alias("score"), F.col("id").alias("doc_id"), F.col("id").alias("row"))
    runs = rows.repartition(8).sortWithinPartitions(F.desc("score"), "doc_id", "row")
    got = resample._regular(runs, 100)
    assert abs(len(got) - 100) <= 8
    ranked = resample.ranked(rows, 5_000, segment_rows=500)
    want = sorted(((r["score"], r["doc_id"]) for r in rows.collect()), key=lambda r: (-r[0], r[1]))[:5_000]
    have = sorted((r["rank"], r["score"], r["doc_id"]) for r in ranked.where("rank is not null").collect())
    assert [h[1:] for h in have] == want and [h[0] for h in have] == list(range(1, 5_001))
