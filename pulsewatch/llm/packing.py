"""Packing token sequences by multiway differencing (operator 7).

Each task tokenizes its own rows and packs them in blocks of about
``block_tokens`` tokens, so nothing is shuffled and memory is one block.
Whole windows of a long document are cut off as they are; the remainder is cut
into pieces of at most ``piece`` tokens.  Karmarkar-Karp differencing then deals
the pieces of a block to k windows: every piece starts as a partial partition
(its size and k - 1 empty windows), and the two partial partitions with the
largest imbalance are merged largest-against-smallest until one is left, which
leaves near-equal windows.  k starts at the least possible count and rises
while any window exceeds the capacity.

Defined results: a NULL or empty text is the end id alone; repeated rows are
packed once each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import give_back, ship, slices

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")

# A chunk without white space that the tokenizer surely splits into leading
# marks, one word and trailing marks; anything else is encoded as it stands.
_MARKS = r"[!-&(-/:;=>?@\[-`{-~]*"
_SIMPLE = rf"^(?P<before>{_MARKS})(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<after>{_MARKS})$"
# Controls that splitting takes for white space and the tokenizer does not.
_ODD_SPACE = "[\\x1c-\\x1f]"
_WORD_END = "</w>"
#: Texts are encoded in slices of about so many bytes.
SLICE_BYTES = 1 << 22


def _gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs ``pool[start:start + size]`` one after the other."""
    at = np.cumsum(size) - size
    return pool[np.repeat(start - at, size) + np.arange(int(size.sum()))]


class Encoder:
    """Token ids of texts as little-endian uint32 bytes.

    No token spans white space, so the ids of a text are those of its chunks in order.
    A slice of texts has its chunks counted in Arrow, each kind is cut into marks,
    a word and marks, and the ids of the distinct parts are laid out by index.  Plain
    words need no normalising and no pattern: they go to the vocabulary's merges alone.
    Nothing is kept from one window of ``chunks`` chunks to the next.
    """

    def __init__(self, path: str, chunks: int = 1 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(_WORD_END)]] = True
        self.chunks = chunks

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case words of letters, and how many each has: the last token of
        a word, and no other, ends one."""
        if not words:
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        runs = self.plain.encode_batch_fast([" ".join(words[i:i + 256]) for i in range(0, len(words), 256)], add_special_tokens=False)
        ids = np.concatenate([np.asarray(r.ids, dtype="<u4") for r in runs])
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def _odd(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any parts without white space; an empty one has none."""
        if not parts:
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        e = self.tokenizer.encode(parts, is_pretokenized=True, add_special_tokens=False)
        return np.asarray(e.ids, dtype="<u4"), np.bincount(np.asarray(e.word_ids, dtype=np.int64), minlength=len(parts))

    def _window(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after the other, and how many each has."""
        coded = chunks.dictionary_encode()
        kinds, empty = coded.dictionary, pa.scalar("")
        m = pc.extract_regex(kinds, _SIMPLE)
        simple = pc.is_valid(m)
        # A very long odd chunk, or one with a special token's sign, is encoded apart.
        apart = pc.and_(pc.invert(simple), pc.or_(pc.greater(pc.utf8_length(kinds), 64), pc.match_substring(kinds, "<|")))
        alone = np.flatnonzero(apart.to_numpy(zero_copy_only=False))
        rest = pc.if_else(pc.or_(simple, apart), empty, kinds)
        sides = [pc.fill_null(pc.struct_field(m, name), empty) for name in ("before", "after")]
        word = pc.fill_null(pc.utf8_lower(pc.struct_field(m, "word")), empty)
        n = len(kinds)
        words = word.filter(simple).dictionary_encode()
        odd = pa.concat_arrays([sides[0], rest, sides[1]]).dictionary_encode()
        pools, sizes = zip(self._words(words.dictionary.to_pylist()), self._odd(odd.dictionary.to_pylist()))
        extra = [self.whole(x) for x in kinds.take(pa.array(alone)).to_pylist()]
        pool = np.concatenate([*pools, *extra])
        size = np.concatenate([*sizes, [len(x) for x in extra], [0]]).astype(np.int64)
        start = np.cumsum(size) - size
        # Four parts a kind: marks, a word or what is encoded apart, any other chunk, marks.
        part = np.full((n, 4), len(size) - 1)
        first_odd = len(words.dictionary)
        part[:, [0, 2, 3]] = first_odd + odd.indices.to_numpy().reshape(3, n).T
        part[simple.to_numpy(zero_copy_only=False), 1] = words.indices.to_numpy()
        part[alone, 1] = first_odd + len(odd.dictionary) + np.arange(len(alone))
        pool = _gather(pool, start[part].reshape(-1), size[part].reshape(-1))
        size = size[part].sum(axis=1)
        each = coded.indices.to_numpy()
        del part, kinds, rest, sides, word, odd, words, m
        return _gather(pool, (np.cumsum(size) - size)[each], size[each]), size[each]

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        """Ids of each text; a NULL has none."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        split = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))  # may give empty chunks: they have no ids
        flat, count = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False)
        ids, sizes = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(flat), self.chunks):
            i, n = self._window(flat.slice(at, self.chunks))
            ids.append(i)
            sizes.append(n)
        raw = np.concatenate(ids).tobytes()
        upto = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])[np.concatenate([[0], np.cumsum(count)])] * 4
        out = [raw[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[k] = self.whole(texts[k].as_py()).tobytes()
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window number (0..k-1) of each size by k-way Karmarkar-Karp differencing.

    A partial partition is a descending array of window sums, less its smallest
    once all k are in use, and the tree node that holds each window's pieces.
    """
    n = len(sizes)
    children: list[tuple[int, int]] = [(-1, -1)] * n
    heap = [(-int(s), i, np.array([s], dtype=np.int64), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        if len(a) + len(b) <= k:  # no window of one meets a used one of the other
            sums, held = np.concatenate([a, b]), np.concatenate([in_a, in_b])
        else:
            pad_a, pad_b = k - len(a), k - len(b)
            sums = np.pad(a, (0, pad_a)) + np.pad(b, (0, pad_b))[::-1]
            in_a = np.pad(in_a, (0, pad_a), constant_values=-1)
            in_b = np.pad(in_b, (0, pad_b), constant_values=-1)[::-1]
            held = np.where(in_a >= 0, in_a, in_b)
            both = np.flatnonzero((in_a >= 0) & (in_b >= 0))
            held[both] = np.arange(len(children), len(children) + len(both))
            children.extend(zip(in_a[both].tolist(), in_b[both].tolist()))
        rank = np.argsort(-sums, kind="stable")
        sums, held = sums[rank], held[rank]
        if len(sums) == k:
            sums = sums - sums[-1]
        order += 1
        heapq.heappush(heap, (-int(sums[0]), order, sums, held))
    window = np.zeros(n, dtype=np.int64)
    if heap:
        for w, node in enumerate(heap[0][3].tolist()):
            todo = [node]
            while todo:
                x = todo.pop()
                if 0 <= x < n:
                    window[x] = w
                elif x >= n:
                    todo.extend(children[x])
    return window


def windows_for(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Fewest near-equal windows that hold the sizes; the count rises while
    a window exceeds the capacity."""
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        w = differencing(sizes, k)
        over = int(np.bincount(w, weights=sizes, minlength=k).max()) - capacity
        if over <= 0:
            return w
        k += 1


def _pack_block(docs: list[tuple], first: int, capacity: int, piece: int) -> tuple[list[tuple], int]:
    """Rows of a block and the next free sequence number."""
    rows, rest, seq = [], [], first
    for doc_id, ids in docs:
        total, at = len(ids) // 4, 0
        while total - at >= capacity:
            rows.append((doc_id, at, capacity, ids[4 * at:4 * (at + capacity)], total, seq, 0))
            at, seq = at + capacity, seq + 1
        while at < total:
            n = min(piece, total - at)
            rest.append((doc_id, at, n, ids[4 * at:4 * (at + n)], total))
            at += n
    window = windows_for(np.array([r[2] for r in rest], dtype=np.int64), capacity)
    used: dict[int, int] = {}
    numbered: dict[int, int] = {}
    for r, w in zip(rest, window.tolist()):
        s = numbered.setdefault(w, seq + len(numbered))
        rows.append((*r, s, used.get(s, 0)))
        used[s] = used.get(s, 0) + r[2]
    return rows, seq + len(numbered)


def pack(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", window: int = 4096,
         end_id: int = 2, piece: int = 1024, block_tokens: int = 1 << 19) -> DataFrame:
    """Pieces of all documents with their ids (uint32, little-endian), the
    sequence that holds each and the offset there.

    ``tokenizer``: path of a tokenizers JSON file that every executor can read.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from pulsewatch.llm import packing as P
        enc = P.encoder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        seq = TaskContext.get().partitionId() << 36
        types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        held, tokens = [], 0

        def out():
            nonlocal held, tokens, seq
            rows, seq = P._pack_block(held, seq, window, piece)
            held, tokens = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                for i, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1))):
                    held.append((i, ids + end))
                    tokens += len(ids) // 4 + 1
                    if tokens >= block_tokens:
                        yield out()
        if held:
            yield out()
        give_back()

    picked = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    return picked.mapInArrow(run, SCHEMA)
