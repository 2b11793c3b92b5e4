"""Operator 7: exact round trip of every id."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pulsewatch.llm import packing
from pulsewatch.llm.queries import tokenizer_path

from .helpers import docs, empty_docs, hard_texts

ODD = ["it's we'll 'so don't", "a\x1cb\x85c\xa0d e", "x<|endoftext|>y <|startoftext|>", "éa ́b", "İSTANBUL ΣΑΣ ß",
       "12 3.4 ½ ²", "!!!hello,%%% (World)", "中文 テスト ไทย", "a" * 500, "​zero﻿width", "''' \"quoted\" _x_ `y`"]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("chunks", [1, 37, 1 << 20])
def test_encoder_equals_the_tokenizer(whole, chunks):
    enc = packing.Encoder(tokenizer_path(), chunks=chunks)
    r = random.Random(5)
    texts = ODD + ["", None, "ünïcode WORDS: (straße) don't 's '' ÀÉ×÷ ß" * 9, "a" * 500, "<|endoftext|> x<|b"] + ["".join(r.choice("aB é'.,!<|> \n\t9ß-中́") for _ in range(80)) for _ in range(300)]
    for t, ids in zip(texts, enc.encode(pa.array(texts, pa.string())), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole(t)[:-1], t
    assert enc.encode(pa.array([], pa.string())) == [] and enc.encode(pa.array([None, ""], pa.string())) == [b"", b""]


def test_memory_of_the_encoder_is_one_window(whole):
    """Words met once leave nothing behind."""
    import tracemalloc
    enc, r = packing.Encoder(tokenizer_path()), random.Random(1)
    texts = lambda: pa.array([" ".join("".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(400)) for _ in range(50)])
    enc.encode(texts())
    tracemalloc.start()
    for _ in range(5):
        enc.encode(texts())
    assert tracemalloc.get_traced_memory()[0] < 1_000_000
    tracemalloc.stop()


@pytest.mark.parametrize("window,piece,block", [(4096, 1024, 1 << 19), (64, 16, 500), (32, 32, 1)])
def test_every_id_lies_in_one_piece(spark, whole, window, piece, block):
    texts = hard_texts() + [(1000 + i, t) for i, t in enumerate(ODD)]
    texts = [x for k, x in enumerate(texts) if x not in texts[:k]]
    got = packing.pack(docs(spark, texts), tokenizer_path(), window=window, piece=piece, block_tokens=block).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        assert len(r.ids) == 4 * r.length > 0
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in texts:
        ids, at = whole(t), 0
        for r in sorted(by_doc.pop(i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids[at:at + r.length]
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window


def test_nothing_to_pack(spark):
    assert packing.pack(empty_docs(spark), tokenizer_path()).count() == 0


def test_differencing_balances():
    r = np.random.default_rng(2)
    for n, k in ((1, 1), (3, 5), (10, 3), (200, 40)):
        sizes = r.integers(1, 1000, n)
        w = packing.differencing(sizes, k)
        sums = np.bincount(w, weights=sizes, minlength=k)
        assert len(w) == n and w.max() < k and sums.sum() == sizes.sum()
        if n > 4 * k:
            assert sums.max() - sums.min() <= 0.1 * sums.mean()
    assert sorted(np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])) == [14, 16]


def test_window_count_rises_until_all_fit():
    sizes = np.array([60] * 5)
    w = packing.windows_for(sizes, 100)  # three windows hold the sum, but no two fit one
    assert np.bincount(w, weights=sizes).max() <= 100 and len(set(w.tolist())) == 5
