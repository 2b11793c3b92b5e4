"""Quality by weak supervision (operator 11).

Rules look at one figure of a text each and vote for it, against it, or abstain.
How far a rule is to be trusted isn't set by hand: expectation-maximisation over
the votes of all documents estimates, per rule, how often it votes for a good text
and how often against a bad one, and the share of good texts.  The posterior
probability that a text is good decides, instead of every rule having to pass.

One pass over the texts makes their figures and votes; they are written once.
Documents with the same votes are alike to the model, so the fit sees the number
of documents per pattern of votes: at most ``3 ** len(RULES)`` rows whatever the
input, made by a partial aggregate over all documents.  An abstention says
nothing about a text.  A few votes given to each rule beforehand (``PRIOR_GOOD``,
``PRIOR_BAD``) are the start and keep the two classes in their meaning.

Defined results: a NULL or empty text has no words, fails the base rules, and all
rules abstain; with no votes at all the posterior is the share of good texts;
repeated rows are judged and counted each; a NULL id stays NULL; an empty table
gives no rows; extra columns are ignored.  Equal windows of words are found by
64-bit hashes within a text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, written
from .html import STOP_WORDS

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\f\r"
_NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
_STOPS = frozenset(w.encode() for w in STOP_WORDS)
_ENDS = (b".", b"!", b"?", b".\"", b".)", "…".encode(), "。".encode())
WINDOW = 8

#: Rule: (figure, good from, good to, bad below, bad above); between, it abstains.
#: Figures are shares of a text's words unless named otherwise.
RULES = {
    "length": ("n_words", 40, 200_000, 15, float("inf")),
    "word_length": ("mean_word", 3.0, 9.0, 2.2, 14.0),
    "symbols": ("symbols", 0.0, 0.02, 0.0, 0.12),
    "letters": ("letters", 0.85, 1.0, 0.6, float("inf")),
    "capitals": ("capitals", 0.0, 0.15, 0.0, 0.5),
    "marks": ("marks", 0.0, 0.02, 0.0, 0.15),
    "sentences": ("sentences", 0.015, 0.34, 0.004, 0.6),
    "stop_words": ("stops", 0.08, 0.75, 0.02, float("inf")),
    "runs": ("runs", 0.0, 0.03, 0.0, 0.15),
    "top_word": ("top", 0.0, 0.12, 0.0, 0.3),
    "duplicate_lines": ("dup_lines", 0.0, 0.1, 0.0, 0.3),
    "repeated_words": ("repeats", 0.0, 0.05, 0.0, 0.3),
}
#: A text shorter than so many words is only judged by its length.
LEAST_WORDS = 15
#: Votes that every rule starts with, right and wrong, on good texts and on bad
#: ones: a rule seldom blames a good text, and a bad text has some faults of many.
PRIOR_GOOD, PRIOR_BAD = (19.0, 1.0), (3.0, 7.0)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", votes string"


def repeat_words(codes: np.ndarray, owner: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words lie in a window of ``window`` words that its text holds twice
    or more.  ``codes``: a hash per word; ``owner``: the number of its text, ascending."""
    inside = np.zeros(len(codes), dtype=bool)
    n = len(codes) - window + 1
    if n <= 0:
        return inside
    h = np.zeros(n, dtype=np.uint64)
    for j in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j:j + n]
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(owner[:n] == owner[window - 1:])
    h, text = h[at] + owner[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), owner[at]
    order = np.argsort(h, kind="stable")
    h, text, at = h[order], text[order], at[order]
    same = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    twice = np.zeros(len(h), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(codes) + 1, dtype=np.int64)
    starts = at[twice]
    edge[starts] += 1
    np.subtract.at(edge, starts + window, 1)
    return np.cumsum(edge[:-1]) > 0


def figures(text: str, words: list[bytes], lines: list[str], n_dup: int, n_symbols: int, chars: int, n_repeat: int) -> dict[str, float]:
    """What the rules look at."""
    n, raw = max(1, len(words)), text.encode("utf-8", "replace")
    full = len(raw) - sum(raw.count(c.encode()) for c in _SPACES)
    return {
        "n_words": len(words), "mean_word": chars / n, "symbols": n_symbols / n,
        "letters": len(raw.translate(None, _NOT_LETTERS)) / max(1, full),
        "capitals": sum(map(bytes.isupper, words)) / n,
        "marks": (text.count("!!") + text.count("??")) / n,
        "sentences": sum(w.endswith(_ENDS) for w in words) / n,
        "stops": sum(map(_STOPS.__contains__, words)) / n,
        "runs": sum(map(bytes.__eq__, words, words[1:])) / n,
        "top": max(Counter(words).values(), default=0) / n,
        "dup_lines": n_dup / max(1, len(lines)), "repeats": n_repeat / n,
    }


def vote(f: dict[str, float]) -> str:
    """One character per rule: + for, - against, 0 abstains."""
    out = []
    for name, (figure, low, high, below, above) in RULES.items():
        x = f[figure]
        if f["n_words"] < LEAST_WORDS and name != "length":
            out.append("0")
        else:
            out.append("+" if low <= x <= high else "-" if x < below or x > above else "0")
    return "".join(out)


def measure(texts: list[str | None]) -> list[tuple]:
    """COUNTS and the votes of each text."""
    texts = [t or "" for t in texts]
    split = [t.encode("utf-8", "replace").split() for t in texts]  # at the contract's white space
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    codes = np.fromiter((hash(x) for w in split for x in w), np.int64, int(sizes.sum())).astype(np.uint64)
    inside = repeat_words(codes, np.repeat(np.arange(len(texts)), sizes))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    covered = np.concatenate([[0], np.cumsum(inside)])
    repeats = (covered[ends[1:]] - covered[ends[:-1]]).tolist()
    out = []
    for t, w, n_repeat in zip(texts, split, repeats):
        lines = [x for x in t.split("\n") if x.strip(_SPACES)]
        n_dup, n_symbols = len(lines) - len(set(lines)), sum(map(t.count, SYMBOLS))
        chars = len(t) - sum(map(t.count, _SPACES))
        out.append((len(w), chars, n_symbols, n_dup, n_repeat,
                    vote(figures(t, w, lines, n_dup, n_symbols, chars, n_repeat))))
    return out


def votes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", slice_bytes: int = 1 << 22) -> DataFrame:
    """COUNTS and votes of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pulsewatch.llm import quality as Q
        for batch in batches:
            for part in slices(batch, 1, slice_bytes):
                rows = list(zip(*Q.measure(part.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in rows[:-1]), pa.array(rows[-1], pa.string())],
                    names=["doc_id", *Q.COUNTS, "votes"])

    return docs.select(docs[doc_id].cast("bigint"), docs[text].cast("string")).mapInArrow(run, SCHEMA)


@dataclass(frozen=True)
class Model:
    """Share of good texts; per rule how often it votes + on a good text and - on
    a bad one, where it votes."""
    good: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def posterior(self, plus: np.ndarray, minus: np.ndarray) -> np.ndarray:
        """Probability of a good text for rows of votes (0/1 per rule)."""
        a, b = np.array(self.on_good), np.array(self.on_bad)
        log = np.log(self.good) - np.log1p(-self.good)
        log = log + plus @ (np.log(a) - np.log1p(-b)) + minus @ (np.log1p(-a) - np.log(b))
        return 1 / (1 + np.exp(-np.clip(log, -500, 500)))


def sides(patterns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    at = np.array([list(p) for p in patterns]).reshape(len(patterns), -1)
    return (at == "+").astype(float), (at == "-").astype(float)


def expectation_maximisation(patterns: list[str], counts: list[int], rounds: int = 500, settled: float = 1e-10) -> Model:
    """Accuracies and share from the number of documents per pattern of votes.
    It starts from the priors and ends when no figure moves by ``settled``."""
    m = len(RULES)
    model = Model(0.5, (PRIOR_GOOD[0] / sum(PRIOR_GOOD),) * m, (PRIOR_BAD[0] / sum(PRIOR_BAD),) * m)
    if not patterns:
        return model
    plus, minus = sides(patterns)
    n = np.array(counts, dtype=float)
    for _ in range(rounds):
        good = n * model.posterior(plus, minus)
        bad = n - good
        right_good, wrong_good = good @ plus + PRIOR_GOOD[0], good @ minus + PRIOR_GOOD[1]
        right_bad, wrong_bad = bad @ minus + PRIOR_BAD[0], bad @ plus + PRIOR_BAD[1]
        old, model = model, Model(
            float((good.sum() + 1) / (n.sum() + 2)), tuple((right_good / (right_good + wrong_good)).tolist()),
            tuple((right_bad / (right_bad + wrong_bad)).tolist()))
        if max(abs(x - y) for x, y in zip((old.good, *old.on_good, *old.on_bad),
                                          (model.good, *model.on_good, *model.on_bad))) < settled:
            break
    return model


def fit(voted: DataFrame) -> tuple[Model, dict[str, float]]:
    """The model of all documents of ``votes`` and the posterior of each pattern;
    one row per pattern is fetched."""
    seen = voted.groupBy("votes").count().orderBy("votes").collect()
    patterns = [r["votes"] for r in seen]
    model = expectation_maximisation(patterns, [r["count"] for r in seen])
    return model, dict(zip(patterns, model.posterior(*sides(patterns)).tolist())) if patterns else {}


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = 20, max_repeat_pct: int = 30,
          threshold: float = 0.5) -> DataFrame:
    """COUNTS of every row, the base rules, the votes, the posterior probability
    that the text is good, and whether it is kept."""
    spark = docs.sparkSession
    voted = written(spark, votes(docs, text, doc_id), "votes")
    known = spark.createDataFrame(list(fit(voted)[1].items()), "votes string, posterior double")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return (voted.join(F.broadcast(known), "votes").withColumn("base_failed", failed)
            .select("doc_id", *COUNTS, "base_failed",
                    (~F.col("base_failed") & (F.col("posterior") >= threshold)).alias("kept"), "votes", "posterior"))
