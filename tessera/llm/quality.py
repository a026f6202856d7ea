"""Pairwise quality ranking: Bradley-Terry scores over text statistics, cut at a quantile."""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, crc32_of, cut, drawn, map_texts, prepare, text_column

#: Labelled rows that a fit reads at most (expected), and preference pairs that it draws from them.
FIT_ROWS = 20_000
FIT_PAIRS = 200_000
RIDGE = 1e-4
STEPS = 40

FEATURES = [
    "upper", "digit", "mark", "non_ascii", "odd_mark", "pipe", "mean_word", "long_word", "log_words", "distinct", "repeat_next",
    "mark_word", "shout_word", "pipe_word", "line_share", "repeat_line", "mean_line", "stop_line", "top_word", "packed",
]

_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[48:58] = 3
for _b in b".,;:'\"-()?\n":
    _CLASS[_b] = 4
for _b in b"!#$%&*+/<=>@[\\]^_`{}~":
    _CLASS[_b] = 5
_CLASS[124] = 6
_CLASS[128:] = 7
_MARKS = b"!#$%&*+=@^~"


def features(text: str | None) -> list[float]:
    """Length-free statistics of a whole text; an empty or null text has zeros."""
    raw = as_bytes(text)
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    count = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8)
    letters, size, n = max(1, int(count[1] + count[2])), len(raw), len(words)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    same = sum(map(bytes.__eq__, words, words[1:]))
    marked = sum(w[-1] in _MARKS for w in words)
    shouted = sum(map(bytes.isupper, words))
    bars = seen.get(b"|", 0)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = [len(x) for x in lines]
    sample = raw if size >= 64 else raw * (64 // size + 1)
    return [
        count[1] / letters, count[3] / size, count[4] / size, count[7] / size, count[5] / size, count[6] / size,
        (size - n) / n / 10, sum(len(w) > 20 for w in words) / n, math.log1p(n) / 10, len(seen) / n, same / n,
        marked / n, shouted / n, bars / n, len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(sum(lengths) / max(1, len(lines))) / 10, sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines)),
        max(seen.values()) / n, len(zlib.compress(sample, 1)) / len(sample),
    ]


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each row's text."""

    def make():
        return lambda ids, texts: (ids, [features(t) for t in texts])

    prepare(docs.sparkSession)
    return map_texts(docs, "doc_id long, x array<double>", make, ["doc_id", "text"])


def _logistic(diff: np.ndarray) -> np.ndarray:
    """Weights that minimise the mean logistic loss of preferred-minus-other differences, with a ridge; by Newton steps."""
    n, d = diff.shape
    w = np.zeros(d)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -50, 50)))
        gradient = -(diff.T @ p) / n + RIDGE * w
        hessian = (diff.T * (p * (1 - p))) @ diff / n + RIDGE * np.eye(d)
        step = np.linalg.solve(hessian, gradient)
        w -= step / max(1.0, float(np.linalg.norm(step)) / 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """A ranking model from statistics and 0/1 labels.

    Pairs of a row of label 1 and one of label 0 are drawn by a fixed seed; the Bradley-Terry score is linear in
    standardised statistics. ``cut`` is the score at the quantile that leaves as many training rows below it as
    have label 0, ``scale`` the spread of scores around it. With one label only, every score is that label's side.
    """
    if not len(x) or y.min() == y.max():
        return {"w": [0.0] * len(FEATURES), "mean": [0.0] * len(FEATURES), "std": [1.0] * len(FEATURES), "cut": 0.0 if len(y) and y[0] == 0 else -1e-9, "scale": 1.0, "one": None if not len(y) else int(y[0])}
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    mean, std = x.mean(0), x.std(0)
    std[std < 1e-9] = 1.0
    z = np.clip((x - mean) / std, -8, 8)
    rng = np.random.default_rng(0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = _logistic(z[rng.choice(good, FIT_PAIRS)] - z[rng.choice(bad, FIT_PAIRS)])
    s = z @ w
    ranked = np.sort(s)
    at = len(bad)
    # the middle of the widest step among the ranks near the quantile
    low, high = max(1, at - max(1, len(s) // 100)), min(len(s) - 1, at + max(1, len(s) // 100))
    best = low + int(np.argmax(ranked[low : high + 1] - ranked[low - 1 : high]))
    return {"w": w.tolist(), "mean": mean.tolist(), "std": std.tolist(), "cut": float((ranked[best - 1] + ranked[best]) / 2), "scale": float(max(1e-6, np.abs(s - ranked[best]).mean() / 2)), "one": None}


def score(x: str, model: dict) -> Column:
    """The model's score of an array column, 0 to 1; 0.5 is the quantile cut. A JVM expression."""
    if model["one"] is not None:
        return F.lit(float(model["one"]))
    terms = [F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.get(F.col(x), F.lit(i)) - F.lit(m)) / F.lit(s))) * F.lit(w) for i, (w, m, s) in enumerate(zip(model["w"], model["mean"], model["std"]))]
    raw = reduce(lambda a, b: a + b, terms) - F.lit(model["cut"])
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), -raw / F.lit(model["scale"])))))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(crc32_of(doc_id) % 3 == 1, F.lit(False))


def fit_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, y): the labels that a fit reads, 0 or 1, outside the held-out third: all up to FIT_ROWS, else about so many by hash.

    A doc_id of several labels counts by its smallest; rows with any other value are left out.
    """
    own = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("y"))
    total = own.count()
    return own.where(drawn("doc_id", 9, FIT_ROWS / total)) if total > FIT_ROWS else own


def learn(rows: DataFrame, labels: DataFrame) -> dict:
    """Fit on the (doc_id, x) rows that have a label of ``fit_labels``."""
    got = rows.join(labels, "doc_id").select("x", "y").toArrow()
    x = np.array(got.column(0).to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, np.array(got.column(1).to_pylist(), dtype=int))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Null and empty texts have a score, that of zero statistics; repeated rows get equal scores; without labels of
    both values every score is the one label's (0.5 without any). Statistics are of whole texts, however long. Further columns are not read.
    """
    rows = cut(featured(docs))
    model = learn(rows, fit_labels(labels))
    scored = rows.select("doc_id", held_out().alias("held_out"), score("x", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, whole rows, scored in one pass after the fit.

    The model is that of ``quality_scores``; only the documents it is fit on are read before. Repeated rows are kept or
    rejected together; null and empty texts are scored like any other.
    """
    own = cut(fit_labels(labels))
    model = learn(featured(docs.select("doc_id", "text").join(own.select("doc_id"), "doc_id", "left_semi")), own)

    x = text_column(lambda: lambda texts: [features(t) for t in texts], "array<double>")
    prepare(docs.sparkSession)
    return docs.withColumn("_x", x("text")).where(score("_x", model) >= 0.5).drop("_x")
