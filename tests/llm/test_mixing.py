"""Operator 2: targets, takings, and the splitting tree."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsewatch.llm import mixing

from .helpers import clashes_kept, clashing, docs, empty_docs, hard_texts


def brute_targets(sizes, weights, share=1.5):
    """The rule as it is stated: share by weight, stop at twice, share the excess anew."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while True:
        w = sum(weights[i] for i in open_)
        for i in open_:
            out[i] = left * weights[i] / w
        over = [i for i in open_ if out[i] > 2 * sizes[i]]
        if not over:
            return out
        for i in over:
            out[i] = 2.0 * sizes[i]
        open_ = [i for i in open_ if i not in over]
        left = share * sum(sizes) - sum(out[i] for i in range(len(sizes)) if i not in open_)
        if not open_:
            return out


def test_targets_follow_the_rule():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 20):
        sizes = [int(x) for x in r.integers(0, 1000, n)]
        weights = [(3.0, 1.0, 2.0)[i % 3] for i in range(n)]
        got = mixing.targets(sizes, weights)
        assert got == pytest.approx(brute_targets(sizes, weights))
        assert sum(got) == pytest.approx(1.5 * sum(sizes)) and all(g <= 2 * s + 1e-9 for g, s in zip(got, sizes))
    assert mixing.targets([0, 0], [3.0, 1.0]) == [0.0, 0.0] and mixing.targets([], []) == []


def test_tree_leaves_are_disjoint_and_cover_the_quotas():
    quotas = np.array([17, 0, 400, 3])
    shards, held = 13, defaultdict(list)
    for shard in range(shards):
        first, n = mixing.leaf(quotas, shard, shards, seed=5)
        assert abs(n.sum() - quotas.sum() / shards) <= np.log2(shards) + 1
        for s in range(4):
            held[s] += range(first[s], first[s] + n[s])
    assert [sorted(held[s]) for s in range(4)] == [list(range(q)) for q in quotas]


def test_quotas_beyond_what_numpy_draws_from():
    quotas = np.array([2_000_000_000, 7, 30_000_000_000, 0, 999])
    rng = np.random.default_rng(3)
    for n in (0, 1, 12_345_678_901, int(quotas.sum()) - 1, int(quotas.sum())):
        got = mixing.split(quotas, n, rng)
        assert got.sum() == n and (got >= 0).all() and (got <= quotas).all()
    half = mixing.split(quotas, int(quotas.sum()) // 2, rng)
    assert abs(half[2] / 15e9 - 1) < 0.001
    shards, last = 10_000_000, np.zeros(5, dtype=np.int64)
    for shard in (0, 1, 4_999_999, 5_000_000, shards - 1):
        first, n = mixing.leaf(quotas, shard, shards, seed=5)
        assert (first >= last).all() and abs(n.sum() - quotas.sum() / shards) <= 30
        last = first + n
    assert (last == quotas).all()


def test_units_cover_the_quotas_as_single_draws_do():
    quotas, rng = np.array([170, 0, 400, 3, 55]), np.random.default_rng(9)
    for n in range(0, 629, 37):
        got = mixing.split(quotas, n, rng, limit=100)
        assert got.sum() == n and (got >= 0).all() and (got <= quotas).all()
    many = np.mean([mixing.split(quotas, 314, rng, limit=100) for _ in range(400)], axis=0)
    assert np.allclose(many, quotas / 2, rtol=0.1, atol=0.7)


def test_rows_repeated_very_often(spark):
    texts = [(7, "a b c")] * 3000 + [(i, "w " * 5) for i in range(100, 160)]
    out = mixed(spark, texts, ["s"] * 3000 + ["s"] * 30 + ["t"] * 30, block_rows=4, shard_words=500).collect()
    assert len(out) == len(texts)
    mine = [r for r in out if r.source == "s"]
    assert mine[0].target - 5 <= sum(r.taken for r in mine) <= mine[0].target + 0.5
    assert len({len(r.draws) for r in mine if r.doc_id == 7}) == 2  # taken in part


def test_columns_of_any_name_are_kept(spark):
    texts = [(i, "w " * (3 + i % 9)) for i in range(200)] + [(None, None)]
    df = clashing(docs(spark, texts, [f"s{i % 3}" for i in range(201)]))
    out = mixing.mix(mixing.with_sizes(df), block_rows=4, shard_words=100)
    assert clashes_kept(out).count() == 201
    assert set(df.columns) | {"target", "taken", "draws"} <= set(out.columns)
    drawn = clashes_kept(mixing.drawn_rows(out, df.columns))
    assert drawn.columns == df.columns and drawn.count() == sum(len(r.draws) for r in out.collect())


def mixed(spark, texts, sources, **options):
    return mixing.mix(mixing.with_sizes(docs(spark, texts, sources)), **options)


@pytest.mark.parametrize("block_rows,shard_words", [(64, 1_000_000), (4, 500)])
def test_takings_come_near_targets(spark, block_rows, shard_words):
    texts = [(i, "w " * (5 + i * 7 % 40)) for i in range(600)]
    sources = [None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 7}" for i in range(600)]
    out = mixed(spark, texts, sources, block_rows=block_rows, shard_words=shard_words)
    assert {"key", "pos", "size", "target", "taken"} <= set(out.columns)
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == list(range(600))
    assert all(r["size"] == 5 + r.doc_id * 7 % 40 and r.taken == r["size"] * len(r.draws) <= 2 * r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    names = sorted((s for s in by if s is not None)) + [None]
    size = [sum(r["size"] for r in by[s]) for s in names]
    want = brute_targets(size, [(3.0, 1.0, 2.0)[i % 3] for i in range(len(names))])
    for s, n, t in zip(names, size, want):
        assert {r.source_size for r in by[s]} == {n} and by[s][0].target == pytest.approx(t)
        taken = sum(r.taken for r in by[s])
        assert t - (10 if block_rows == 64 else 45) <= taken <= t + 0.5, s  # short of one row of the last block
    again = mixed(spark, texts[::-1], sources[::-1], block_rows=block_rows, shard_words=shard_words)
    assert sorted((r.doc_id, r.taken, sorted(r.draws)) for r in again.collect()) == sorted(
        (r.doc_id, r.taken, sorted(r.draws)) for r in rows)


def brute_rest(rows, rest, blocks):
    """Rows walked by block and hash, each taken that still fits."""
    taken, left = Counter(), rest
    for r in sorted(rows, key=lambda r: (((r["_mix"] % 2**64) >> 11) * 2.0**-53 * blocks // 1, r["_mix"], r["size"])):
        if left and r["size"] <= left:
            taken[r.doc_id], left = 1, left - r["size"]
    return taken


@pytest.mark.parametrize("giant", [900, 5000, 12_000])
def test_a_very_long_document_leaves_no_source_short(spark, giant):
    """One document of a source is longer than many of its blocks, or than its rest."""
    n, per = 1500, 500
    size = [giant if i % per == 7 else 3 + i * 7 % 40 for i in range(n)]
    texts, sources = [(i, "w " * s) for i, s in enumerate(size)], [f"s{i // per}" for i in range(n)]
    rows = {r.doc_id: r for r in mixing.with_sizes(docs(spark, texts, sources)).collect()}
    out = mixed(spark, texts, sources, block_rows=4, shard_words=3000).collect()
    assert sorted(r.doc_id for r in out) == list(range(n))
    for s in set(sources):
        mine = [r for r in out if r.source == s]
        total, target = mine[0].source_size, mine[0].target
        passes = int(target // total)
        want = brute_rest([rows[r.doc_id] for r in mine], round(target - passes * total), -(-per // 4))
        assert {r.doc_id: len(r.draws) - passes for r in mine} == {r.doc_id: want[r.doc_id] for r in mine}
        unused = min((r["size"] for r in mine if len(r.draws) == passes), default=1)
        assert target - unused < sum(r.taken for r in mine) <= target + 0.5, s
        assert all(len({d.epoch for d in r.draws}) == len(r.draws) for r in mine)
    by = Counter()
    for r in out:
        for d in r.draws:
            by[d.shard] += r["size"] if r["size"] < giant else 0
    assert len(by) == max(by) + 1 and max(by.values()) < 3 * sum(by.values()) / len(by)


def test_drawn_rows_are_as_many_as_the_draws(spark):
    texts = hard_texts()
    out = mixed(spark, texts, [f"s{i % 3}" for i in range(len(texts))], block_rows=4, shard_words=300)
    drawn = mixing.drawn_rows(out, ["doc_id", "text"])
    want = Counter()
    for r in out.collect():
        want[r.doc_id] += len(r.draws)
    assert Counter(r.doc_id for r in drawn.collect()) == +want


def test_empty_texts_and_tables(spark):
    assert mixing.mix(mixing.with_sizes(empty_docs(spark))).count() == 0
    rows = mixed(spark, [(1, None), (2, ""), (None, " ")], ["a", None, "a"]).collect()
    assert {(r["size"], r.taken, r.target) for r in rows} == {(0, 0, 0.0)}


def test_words_are_those_of_the_contract(spark):
    df = mixing.with_sizes(docs(spark, [(1, "a b\x1cc d\x0be\x85f")]))
    assert df.select(F.col("size")).first()[0] == 4
