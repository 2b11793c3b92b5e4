"""Operators 5 and 6 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from pulsewatch.llm import lines, simhash

from .helpers import clashes_kept, clashing, docs, empty_docs, hard_texts


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_lines(texts, min_chars=10):
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for i, t in texts:
        for x in (t or "").split("\n"):
            first[key(x)] = min(first.get(key(x), i), i)
    out = []
    for i, t in texts:
        ls = (t or "").split("\n")
        kept = [x for x in ls if len(key(x)) < min_chars or first[key(x)] == i]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("salts", [1, 64])
def test_line_dedup_matches_brute_force(spark, salts):
    texts = hard_texts()
    got = lines.dedup_lines(docs(spark, texts), salts=salts)
    assert set(got.columns) >= {"key", "size", "pos", "n_lines", "n_dropped", "keep"}
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == brute_lines(texts)


def test_line_dedup_hot_line_and_long_document(spark):
    texts = [(i, f"a line that everyone has\nown line number {i}") for i in range(300)]
    texts.append((300, "\n".join(["a line that everyone has", "short", "x" * 50] * 2000)))
    got = lines.dedup_lines(docs(spark, texts, parts=8))
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == brute_lines(texts)


def test_line_dedup_of_one_id_with_two_texts_and_none(spark):
    texts = [(1, "the same long line\nfirst text here"), (1, "another text at all\nthe same long line"),
             (None, "the same long line")]
    got = {(r.doc_id, r.text) for r in lines.dedup_lines(docs(spark, texts)).collect()}
    assert got == {(1, texts[0][1]), (1, texts[1][1]), (None, "")}
    assert lines.dedup_lines(empty_docs(spark)).count() == 0


def test_columns_of_any_name_are_kept(spark):
    texts = hard_texts() + [(None, "no id\nat all here")]
    df = clashing(docs(spark, texts))
    out = clashes_kept(lines.dedup_lines(df))
    assert out.columns == [c for c in df.columns if c != "keep"] + ["n_lines", "n_dropped", "keep"] and out.count() == len(texts)
    kept = clashes_kept(simhash.keep_one(df))
    assert kept.columns == df.columns
    plain = simhash.keep_one(docs(spark, texts))
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == sorted([(r.doc_id, r.text) for r in plain.collect()], key=repr)


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, bits=3):
    fps = np.array([f for _, f in pairs], dtype=np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
    out = np.array([i for i, _ in pairs])
    while True:
        new = np.array([out[near[i]].min() for i in range(len(out))])
        if (new == out).all():
            return out.tolist()
        out = new


def test_simhash_matches_brute_force(spark):
    texts = hard_texts()
    got = simhash.near_duplicates(docs(spark, texts)).collect()
    pairs = [(i, brute_print(t)) for i, t in texts]
    want = [(i, f"{f:016x}", c) for (i, f), c in zip(pairs, brute_components(pairs))]
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted(want)
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("bits,tile", [(3, 2048), (3, 8), (0, 16), (2, 16), (5, 16)])
def test_links_are_complete(spark, bits, tile):
    r = random.Random(bits)
    fps = [r.getrandbits(64) for _ in range(60)]
    for f in fps[:40]:  # neighbours at every distance, and chains
        g = f
        for _ in range(6):
            g ^= sum(1 << b for b in r.sample(range(64), r.randint(0, 6)))
            fps.append(g)
    fps = sorted(set(fps))
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    from pulsewatch.llm.graph import components
    roots = {r.node: r.root for r in components(simhash.links(df, bits, tile), "a", "b").collect()}
    want = brute_components(list(zip(signed, fps)), bits)
    assert [roots.get(s, s) for s in signed] == want


def test_one_row_of_each_group_stays(spark):
    texts = hard_texts()
    kept = [r.doc_id for r in simhash.keep_one(docs(spark, texts)).collect()]
    groups = {r.component_id for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert sorted(kept) == sorted(groups)


def test_rows_without_an_id_or_with_one_id_stay_by_their_group(spark):
    r = random.Random(8)
    t = [" ".join(str(r.random()) for _ in range(30)) for _ in range(7)]
    texts = [(None, t[0]), (None, t[1]), (None, t[2]), (None, t[2]), (1, t[3]), (1, t[4]), (2, t[4]), (5, t[5]), (None, t[5]),
             (6, t[6]), (6, t[6])]
    kept = simhash.keep_one(docs(spark, texts))
    assert kept.columns == docs(spark, texts).columns
    want = [(None, t[0]), (None, t[1]), (None, t[2]), (1, t[3]), (1, t[4]), (5, t[5]), (6, t[6])]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert simhash.keep_one(empty_docs(spark)).count() == 0


def test_word_and_hash_contract():
    assert simhash.fingerprint(b"") == simhash.fingerprint(None) == 0
    assert simhash.fingerprint("A b".encode()) == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint(" x y É".encode()) == brute_print(" x y É")
    assert hashlib.sha256(b"").hexdigest()  # the digest that queries add is plain SHA-256
