"""Quality scores from a regularised quadratic discriminant.

Each text becomes a vector of document statistics (length, word shape, symbols,
letter case, repetition of words, word runs and lines), transformed by logarithm
or log-odds.  Per class, count, sum and sum of products are added up by Spark
over all labelled rows, so the driver sees a few hundred numbers.  Each class
covariance is shrunk towards the pooled one and its diagonal; its Cholesky factor
is computed once and sent with the scorer.  The score is the logistic of the
difference of the classes' log-densities (Mahalanobis distances and
log-determinants) plus the log-odds of the classes.  The difference counts in
proportion n / (n + 10) to a text's n words, as shares of few words say little.

Defined cases: a null text is empty and scored like any text; rows with a null
label are not learned from; a repeated document or label counts as often as it
occurs; without both classes every score is 0.5.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usertrail.llm.common import bounded_batches, column, landed, slices, text_of, texts

_SYMBOLS = re.compile(r"[^\w\s.,;:'\"!?()\-]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LETTERS = re.compile(r"[^\W\d_]")
_DIGITS = re.compile(r"\d")
#: The number of words at which the densities count for half.
TRUST_WORDS = 10.0
FEATURES = ("chars", "words", "word_length", "symbols", "upper", "exclaims", "digits", "distinct", "top_word",
            "repeated_runs", "repeated_lines", "line_length", "short_words", "stops")


def _odds(part: float, whole: float) -> float:
    """Smoothed log-odds of a share."""
    return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))


def statistics(text: str) -> list[float]:
    n = len(text)
    found = text.split()
    n_words = len(found)
    counts = Counter(found)
    lines = [x for x in text.split("\n") if x.strip()]
    runs = n_words - 2
    letters = sum(map(str.isalpha, text)) if n < 200 else n - len(_LETTERS.sub("", text))
    seen = len(set(zip(found, found[1:], found[2:]))) if runs > 0 else 0
    lengths = [len(w) for w in found]
    return [
        float(np.log1p(n)), float(np.log1p(n_words)),
        float(np.log1p(sum(lengths) / n_words)) if n_words else 0.0,
        _odds(n - len(_SYMBOLS.sub("", text)), n), _odds(n - len(_UPPER.sub("", text)), letters),
        _odds(text.count("!"), n_words), _odds(n - len(_DIGITS.sub("", text)), n),
        _odds(len(counts), n_words), _odds(max(counts.values(), default=0), n_words),
        _odds(max(runs, 0) - seen, max(runs, 0)), _odds(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(n / max(len(lines), 1))), _odds(sum(x <= 3 for x in lengths), n_words),
        _odds(text.count(". ") + text.count(".\n"), n_words),
    ]


@dataclass
class Model:
    means: np.ndarray    # classes 0 and 1
    factors: np.ndarray  # inverse Cholesky factors
    log_dets: np.ndarray
    log_odds: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d
                   for m, f, d in zip(self.means, self.factors, self.log_dets)]
        words = np.expm1(x[:, FEATURES.index("words")])
        trust = words / (words + TRUST_WORDS)
        return 1 / (1 + np.exp(np.clip(-(trust * (density[1] - density[0]) + self.log_odds), -500, 500)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = 0.1,
        ridge: float = 0.02) -> Model | None:
    """From count, sum and sum of products a class; None unless both classes are there."""
    if any(moments.get(c, (0,))[0] < 2 for c in (0, 1)):
        return None
    n = np.asarray([moments[c][0] for c in (0, 1)])
    means = np.asarray([moments[c][1] / moments[c][0] for c in (0, 1)])
    covs = [moments[c][2] / moments[c][0] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = sum(k * c for k, c in zip(n, covs)) / n.sum()
    level = np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(pooled))
    factors, dets = [], []
    for c in covs:
        lower = np.linalg.cholesky((1 - shrinkage - ridge) * c + shrinkage * pooled + ridge * level)
        factors.append(np.linalg.inv(lower))
        dets.append(2 * np.log(np.diag(lower)).sum())
    return Model(means, np.asarray(factors), np.asarray(dets), float(np.log(n[1] / n[0])))


def featurise(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and its vector ``x``, written once: learning and scoring read it."""
    rows = bounded_batches(docs).select(F.col(key).alias("key"), text_of(text).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [column(batch, "key"), pa.array([statistics(t) for t in texts(batch)], pa.list_(pa.float64()))],
                ["key", "x"])

    return landed(rows.mapInArrow(measure, f"key {docs.schema[key].dataType.simpleString()}, x array<double>"), "quality")


def learn(features: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality") -> Model | None:
    """Fit on all labelled rows of ``labels``."""
    named = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    d = len(FEATURES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = np.asarray(column(batch, "label"))
            x = np.asarray(column(batch, "x").flatten()).reshape(-1, d)
            for c in (0, 1):
                z = x[y == c]
                sums[c] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], sums.shape[1]), pa.int32()), pa.array(np.tile(np.arange(sums.shape[1]), 2), pa.int32()),
             pa.array(sums.ravel())], ["label", "at", "value"])

    rows = (features.join(named, "key").select("label", "x").mapInArrow(add, "label int, at int, value double")
            .groupBy("label", "at").agg(F.sum("value").alias("value")).collect())
    total = np.zeros((2, 1 + d + d * d))
    for r in rows:
        total[r["label"], r["at"]] = r["value"]
    return fit({c: (t[0], t[1:1 + d], t[1 + d:].reshape(d, d)) for c, t in enumerate(total)})


def score(features: DataFrame, model: Model | None) -> DataFrame:
    """key and score, 0 to 1."""
    d = len(FEATURES)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(column(batch, "x").flatten()).reshape(-1, d)
            s = np.full(len(x), 0.5) if model is None else np.round(model.scores(x), 6)
            yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.array(s)], ["key", "score"])

    return features.mapInArrow(rate, f"key {features.schema['key'].dataType.simpleString()}, score double")
