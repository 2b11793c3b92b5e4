"""Toxicity scores from a counterfactually regularised classifier (operator 10).

Logistic regression over the set of words and word beginnings of a text, fitted
on a bounded sample of labelled rows.  Sentences that name a group get a counterfactual twin with
the identity terms swapped; the squared difference of the two scores is part of
the loss, so the identity terms themselves gain no weight and neutral mentions
of a group stay clean.  An L1 term keeps only words that carry evidence, so the
length of a text adds no noise to its score and the model is a few words.

Words and beginnings enter the fit when their share of toxic and of other texts
differs by more than ``screen`` standard errors.  The sample is ``max_rows`` labelled rows, the first by a hash of the id: enough
for any input size, and the only bounded part; scoring reads every text whole.

Defined results: a NULL or empty text has no words and gets the score of the
intercept; with no usable labels every score is ``prior``; labels that are NULL
are ignored, and of repeated labels the largest counts; repeated rows are scored
each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, ship

# Groups of identity terms that may stand for one another.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "queer"), ("transgender", "cisgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("african", "european", "american", "mexican", "chinese", "indian"),
    ("immigrants", "locals", "refugees", "citizens"), ("immigrant", "local", "refugee", "citizen"),
    ("old", "young"), ("disabled", "blind", "deaf"),
    ("frauen", "männer"), ("frau", "mann"), ("femmes", "hommes"), ("femme", "homme"),
    ("mujeres", "hombres"), ("mujer", "hombre"),
)
_SWAP = {w: g[(i + 1) % len(g)] for g in IDENTITY_GROUPS for i, w in enumerate(g)}
_SENTENCE = re.compile(r"[.!?\n]+")
_LETTERS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)


def words(text: str | None) -> set[str]:
    """Distinct lower-case words: runs of letters."""
    chunks = set((text or "").lower().split())
    plain = set(filter(str.isalpha, chunks))
    runs = set(_LETTERS.findall(" ".join(chunks - plain)))
    letters = set(filter(str.isalpha, runs))
    for run in runs - letters:  # the pattern takes signs such as ² and ½ for letters
        letters.update("".join(c if c.isalpha() else " " for c in run).split())
    return plain | letters


def features(found: set[str]) -> set[str]:
    """Words, and the beginnings of longer ones marked by a star."""
    out = set(found)
    for n in BEGINNINGS:
        out.update([w[:n] + "*" for w in found if len(w) > n])
    return out


def counterfactual(text: str) -> set[str] | None:
    """Words of the text with the identity terms of its sentences swapped;
    None where no sentence names a group."""
    if _SWAP.keys().isdisjoint(words(text)):
        return None
    out: set[str] = set()
    for sentence in _SENTENCE.split(text):
        w = words(sentence)
        out |= {_SWAP.get(x, x) for x in w}
    return out


@dataclass
class Model:
    """Score of a text: sigmoid(intercept + the weights of its words)."""

    intercept: float
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self._words = {w: x for w, x in self.weights.items() if not w.endswith("*")}
        self._starts = [(n, {w[:-1]: x for w, x in self.weights.items() if w.endswith("*") and len(w) == n + 1})
                        for n in BEGINNINGS]

    def score(self, text: str | None) -> float:
        found = words(text)
        held = [self._words[w] for w in found.intersection(self._words)]
        for n, known in self._starts:
            if known:
                held += [known[b] for b in {w[:n] for w in found if len(w) > n}.intersection(known)]
        z = self.intercept + sum(sorted(held))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[ends[1:]] - total[ends[:-1]]


def screened(rows: list[tuple[str, str | None, int]], min_docs: int, screen: float) -> list[str]:
    """Features whose share differs between the labels by ``screen`` standard errors."""
    seen: tuple[dict[str, int], dict[str, int]] = ({}, {})
    size = [0, 0]
    for w, _, y in rows:
        size[y] += 1
        count = seen[y]
        for x in features(set(w.split())):
            count[x] = count.get(x, 0) + 1
    out = []
    for x in seen[0].keys() | seen[1].keys():
        n, p = seen[0].get(x, 0), seen[1].get(x, 0)
        share = (n + p) / (size[0] + size[1])
        error = np.sqrt(share * (1 - share) * (1 / size[0] + 1 / size[1]))
        if n + p >= min_docs and abs(p / size[1] - n / size[0]) > screen * error:
            out.append(x)
    return sorted(out)


def fit_words(rows: list[tuple[str, str | None, int]], min_docs: int = 3, screen: float = 4.0, l1: float = 2e-4,
              fairness: float = 1.0, rounds: int = 400, prior: float = 0.01) -> Model:
    """Proximal gradient on log loss + fairness * (logit - twin's logit)^2 + l1.

    ``rows``: (words, words of the counterfactual twin or None, label 0/1),
    words joined by spaces.
    """
    labels = np.array([r[2] for r in rows], dtype=float)
    if not len(rows) or labels.min() == labels.max():
        p = min(max(float(labels.mean()) if len(rows) else prior, 0.001), 0.999)
        return Model(float(np.log(p / (1 - p))))
    vocabulary = {w: i for i, w in enumerate(screened(rows, min_docs, screen))}

    def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        held = [sorted(vocabulary[x] for x in features(set(t.split())) if x in vocabulary) for t in texts]
        ends = np.cumsum([0] + [len(h) for h in held])
        return np.fromiter((i for h in held for i in h), dtype=np.int64, count=int(ends[-1])), ends

    at, ends = packed([r[0] for r in rows])
    paired = np.array([i for i, r in enumerate(rows) if r[1] is not None], dtype=np.int64)
    twin_at, twin_ends = packed([rows[i][1] for i in paired])
    n, size = len(rows), len(vocabulary)
    row_of, twin_of = np.repeat(np.arange(n), np.diff(ends)), np.repeat(np.arange(len(paired)), np.diff(twin_ends))
    # A step for each word of 1 over a bound of its curvature: frequent words step less.
    mean_len = np.maximum(1.0, np.diff(ends))
    curve = np.bincount(at, weights=mean_len[row_of], minlength=size) / (4 * n)
    if len(paired):
        both = np.bincount(at, minlength=size) + np.bincount(twin_at, minlength=size)
        curve = curve + fairness * both * 2 * float(mean_len[paired].max()) / n
    # Far fewer words move than texts hold: long steps, halved when the loss rises.
    step = 32.0 / np.maximum(curve, 1e-9)
    weights, bias = np.zeros(size), float(np.log(labels.mean() / (1 - labels.mean())))

    def forward(w, b):
        z = b + _sums(w[at], ends)
        gap = z[paired] - b - _sums(w[twin_at], twin_ends) if len(paired) else np.zeros(0)
        loss = float(np.mean(np.logaddexp(0, z) - labels * z) + fairness * np.square(gap).sum() / n + l1 * np.abs(w).sum())
        return 1 / (1 + np.exp(-np.clip(z, -60, 60))), gap, loss

    p, gap, loss = forward(weights, bias)
    for _ in range(rounds):
        d = (p - labels) / n
        g0 = d.sum()
        d[paired] += 2 * fairness * gap / n
        g = np.bincount(at, weights=d[row_of], minlength=size)
        if len(paired):
            g = g - np.bincount(twin_at, weights=(2 * fairness * gap / n)[twin_of], minlength=size)
        while True:
            moved = weights - step * g
            moved = np.sign(moved) * np.maximum(0, np.abs(moved) - step * l1)
            moved_bias = bias - min(4.0, float(step.min()) * 4) * g0 if size else bias
            new = forward(moved, moved_bias)
            if new[2] <= loss + 1e-12 or step.max() < 1e-6:
                break
            step = step / 2
        done = loss - new[2] < 1e-7
        weights, bias, (p, gap, loss) = moved, float(moved_bias), new
        step = step * 1.2
        if done:
            break
    kept = {w: float(weights[i]) for w, i in vocabulary.items() if weights[i]}
    return Model(bias, kept)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
        max_rows: int = 6000, max_words: int = 2_000, prior: float = 0.01, **options) -> Model:
    """Fit on the first ``max_rows`` labelled ids by a hash of the id, one row of
    each: that of the first text by its hash.

    ``max_words``: the training rows (not the scored ones) are texts of at most so
    many distinct words, which bounds what the driver holds.
    """
    ship(docs.sparkSession)
    known = (labels.where(labels[label].isNotNull()).groupBy(labels[doc_id].cast("bigint").alias("_id"))
             .agg(F.max(F.col(label)).cast("int").alias("_y")).where("_y in (0, 1)"))
    picked = docs.select(docs[doc_id].cast("bigint").alias("_doc"), docs[text].cast("string").alias("_text"))

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pulsewatch.llm import toxicity as T
        for batch in batches:
            out = []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = T.words(t)
                if len(w) <= max_words:
                    twin = T.counterfactual(t or "")
                    out.append((" ".join(sorted(w)), " ".join(sorted(twin)) if twin is not None else None, y))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))],
                names=["w", "twin", "y"])

    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    one = F.min_by(F.struct("_text", "_y"), F.xxhash64("_text")).alias("x")
    rows = (picked.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).groupBy("_id").agg(one).select("x._text", "x._y")
            .mapInArrow(prepared, "w string, twin string, y int").toLocalIterator())
    data = sorted((r.w, r.twin or "", r.twin is None, r.y) for r in rows)
    return fit_words([(w, None if alone else t, y) for w, t, alone, y in data],
                     prior=prior, **options)


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([model.score(t.as_py()) for t in batch.column(1)], pa.float64())],
                names=["doc_id", "score"])

    picked = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("t"))
    return picked.mapInArrow(run, "doc_id bigint, score double")


def reject(docs: DataFrame, model: Model, text: str = "text", at: float = 0.5) -> DataFrame:
    """The rows that score below ``at``, with all their columns."""
    ship(docs.sparkSession)
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.score(t.as_py()) < at for t in batch.column(where)]
            yield batch.filter(pa.array(keep, pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
