"""Operators 1 and 8 against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsewatch.llm import topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, e string, pair string, dim int"


def rows(seed=1, n=300, dim=16):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dim)).astype(np.float32)
    base[1:60] = base[0] + r.normal(size=(59, dim)).astype(np.float32) * 0.25
    base[100:110] = base[99]                       # copies
    base[110:120] = -base[99]
    base[n - 1] = base[n - 2] * 3                  # same direction
    out = [(i, v.tolist()) for i, v in enumerate(base)]
    out += [(n, None), (n + 1, []), (n + 2, [0.0] * dim), (n + 3, [float("nan")] * dim), (n + 4, [float("inf")] * dim),
            (n + 5, [None] + [1.0] * (dim - 1)), (n + 6, [1.0] * (dim + 1)), (None, base[0].tolist()),
            (5, base[5].tolist())]
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, v, 0, 1, "e", "p", 2) for i, v in data], SCHEMA).repartition(4)


def usable(i, v, dim=16):
    return i is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(data, cosine):
    ok = [k for k, (i, v) in enumerate(data) if usable(i, v)]
    u = np.array([data[k][1] for k in ok], dtype=np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    ids = np.array([data[k][0] for k in ok])
    low = ids.copy()
    while True:
        new = np.array([min([low[i], *low[near[i]]]) for i in range(len(low))])
        if (new == low).all():
            break
        low = new
    out = {k: (data[k][0], 0, data[k][0], data[k][0] is not None) for k in range(len(data))}
    for p, k in enumerate(ok):
        out[k] = (int(ids[p]), int(near[p].sum()), int(low[p]), bool(ids[p] == low[p]))
    return sorted(out.values(), key=repr)


@pytest.mark.parametrize("blocks,tile,cosine", [(4, 4096, 0.9), (4, 16, 0.9), (1, 32, 0.8), (8, 64, 0.95)])
def test_near_duplicates_match_brute_force(spark, blocks, tile, cosine):
    data = rows()
    got = vectors.near_duplicates(frame(spark, data), cosine=cosine, blocks=blocks, tile=tile, sample=64)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(data, cosine)


def test_near_duplicates_of_nothing(spark):
    assert vectors.near_duplicates(frame(spark, [])).count() == 0
    got = vectors.near_duplicates(frame(spark, [(1, None), (2, [0.0, 0.0])])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_a_pair_is_counted_in_one_block(spark):
    same = [(i, [1.0, 0.0, 0.0, 1e-3 * i]) for i in range(50)]
    got = vectors.near_duplicates(frame(spark, same), blocks=2, tile=8).collect()
    assert {r.n_links for r in got} == {49} and {r.component_id for r in got} == {0}


@pytest.mark.parametrize("shard_rows,fan_in,big,tile_rows", [
    (8192, 32, 1, 16384), (10, 2, 1, 3), (16, 3, 2.0 ** 20, 1), (16, 3, 2.0 ** 24, 5)])
def test_top_k_matches_brute_force(spark, shard_rows, fan_in, big, tile_rows):
    data = [(i, None if v is None else [None if x is None else x * big for x in v]) for i, v in rows(n=120) if i != 5]
    df = frame(spark, data)
    got = topk.top_k(df, F.pmod(df["vec_id"], F.lit(10)) == 0, k=5, scale=4, shard_rows=shard_rows, fan_in=fan_in, tile_rows=tile_rows)
    want = []
    fine = [(i, [math.floor(4 * x) for x in v]) for i, v in data
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in fine:
        if q % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in fine if c != q and len(w) == len(v))
            want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:5])]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_groups_do_not_grow_with_the_queries(spark, monkeypatch, tmp_path):
    """Fifty times more queries, and one id that a third of the rows repeat: no group holds more."""
    def most(n):
        seen = tmp_path / str(n)
        seen.mkdir()
        def watched(k):
            def run(t):
                (seen / f"{t['dim'][0]}-{t['v'].nbytes}-{t['row'][0]}-{len(t)}").touch()
                return shard(t)
            return run

        shard = topk._shard(5) if not hasattr(topk._shard, "plain") else topk._shard.plain
        watched.plain = shard
        monkeypatch.setattr(topk, "_shard", watched)
        df = frame(spark, [(i if i % 3 else 7, [float(i % 11), 1.0]) for i in range(n)])
        got = topk.top_k(df, F.lit(True), shard_rows=100, tile_rows=100)
        assert got.count() == 5 * n
        return max(int(f.name.rsplit("-", 1)[1]) for f in seen.iterdir())

    assert most(60) <= 120 and most(3000) <= 2 * 100 * 1.5


def test_top_k_ties_and_few_candidates(spark):
    data = [(i, [1.0, 1.0]) for i in range(4)]
    df = frame(spark, data)
    got = topk.top_k(df, df["vec_id"] == 2, k=5).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 0), (2, 1), (3, 3)]
    assert topk.top_k(frame(spark, []), F.lit(True)).count() == 0
