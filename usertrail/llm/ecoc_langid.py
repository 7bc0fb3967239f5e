"""Language identification with error-correcting output codes.

Every language gets a codeword of plus and minus ones.  Each bit is a binary
classifier over hashed character n-grams (one to three characters): the summed
log-odds of the n-grams in the languages whose bit is plus, against the others,
each language weighing the same.  A text's margins on all bits are compared with
the codewords by a weighted exponential loss (loss-based decoding, Allwein et
al., 2000); the nearest codeword wins.  A bit weighs as much as it tells the
languages apart in training.  If the second codeword is almost as near, the text
is flagged ambiguous.

The n-gram counts cover every training text, and are summed by Spark; the driver
sees one row a language and hash bucket (``buckets`` bounds them).

Defined cases: a text that is null, or has no letter, is ``und`` with score 0, and
not ambiguous; rows without a language are not learned from; without any language
to learn all texts are ``und``; with only one, all texts with a letter are of it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usertrail.llm.common import bounded_batches, column, give_back, slices, text_of, texts

BUCKETS = 1 << 14
UNDETERMINED = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_FACTORS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def only_letters(text: str) -> str:
    """The text with a blank for everything that is no letter (str.isalpha)."""
    found = _NOT_LETTERS.sub(" ", text)
    if not found.isascii():
        # to a pattern, other numbers than decimal digits are word characters too: \u00b2, \u00bd, \u2167
        other = {ord(c): " " for c in set(found) if not c.isalpha()}
        if other.keys() - {32}:
            found = found.translate(other)
    return found


def ngram_counts(text: str, buckets: int = BUCKETS) -> np.ndarray | None:
    """Counts a hash bucket, or None without letters.  ``buckets`` is a power of two."""
    letters = only_letters(text).lower()
    if not letters.strip():
        return None
    codes = np.frombuffer(f" {letters} ".encode("utf-32-le"), "<u4").astype(np.uint64)
    shift, one, out = np.uint64(65 - buckets.bit_length()), codes, []
    for n, factor in enumerate(_FACTORS):
        if n:
            one = (one[:-1] << np.uint64(20)) ^ (one[:-1] >> np.uint64(17)) ^ codes[n:]
        out.append(((one + np.uint64(n + 1)) * factor) >> shift)
    return np.bincount(np.concatenate(out).astype(np.int64), minlength=buckets)


def codewords(n: int) -> np.ndarray:
    """A codeword a language, in rows: all splits of up to five languages, else the best of 200 random ones."""
    if n <= 5:
        splits = [[1 if i in side or i == 0 else -1 for i in range(n)] for k in range(n - 1)
                  for side in combinations(range(1, n), k)]
        return np.asarray(splits, np.int8).reshape(-1, n).T if splits else np.empty((n, 0), np.int8)
    rng, bits, best = np.random.default_rng(7), int(np.ceil(10 * np.log2(n))), (-1, None)
    for _ in range(200):
        code = rng.choice(np.asarray([-1, 1], np.int8), (n, bits))
        code[0, np.abs(code.sum(axis=0)) == n] *= -1  # a bit that splits nothing
        near = (bits - code.astype(int) @ code.T.astype(int)) // 2 + bits * np.eye(n, dtype=int)
        if near.min() > best[0]:
            best = (near.min(), code)
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray     # languages x bits
    weights: np.ndarray  # buckets x bits, scaled so that the languages' mean margin is about one
    trust: np.ndarray    # a bit's share in the loss

    @property
    def buckets(self) -> int:
        return self.weights.shape[0]


def fit(langs: list[str], counts: np.ndarray) -> Model:
    """From n-gram counts, languages x buckets."""
    code = codewords(len(langs))
    share = (counts + 0.05) / (counts + 0.05).sum(axis=1, keepdims=True) if len(langs) else counts
    weights, trust = np.zeros((counts.shape[1], code.shape[1])), np.zeros(code.shape[1])
    for b in range(code.shape[1]):
        w = np.log(share[code[:, b] > 0].mean(axis=0)) - np.log(share[code[:, b] < 0].mean(axis=0))
        margin = share @ w
        middle = (margin[code[:, b] > 0].min() + margin[code[:, b] < 0].max()) / 2
        w = w - middle
        margin = code[:, b] * (margin - middle)
        spread = np.sqrt(np.maximum(share @ w**2 - (share @ w) ** 2, 1e-9))
        weights[:, b] = w / max(margin.mean(), 1e-9)
        trust[b] = max((margin / spread).min(), 1e-3)
    return Model(langs, code, weights.astype(np.float32), trust / trust.sum() if len(trust) else trust)


def train(rows: DataFrame, *, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> Model:
    """Learn from all rows that have a language."""
    known = bounded_batches(rows).select(F.col(lang).cast("string").alias("lang"), text_of(text).alias("text")).where(
        "lang is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = defaultdict(lambda: np.zeros(buckets, np.int64))
        for batch in slices(batches):
            for name, t in zip(column(batch, "lang").to_pylist(), texts(batch)):
                got = ngram_counts(t, buckets)
                if got is not None:
                    sums[name] += got
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])],
                ["lang", "bucket", "n"])
        give_back()

    sums = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.toArrow()
    names = got.column("lang").to_pylist()
    langs = sorted(set(names))
    counts = np.zeros((len(langs), buckets))
    at = {name: i for i, name in enumerate(langs)}
    counts[[at[x] for x in names], np.asarray(got.column("bucket"), dtype=np.int64)] = np.asarray(got.column("n"))
    return fit(langs, counts)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language numbers, scores and losses' lead, for margins texts x bits."""
    loss = np.exp(np.clip(-margins[:, None, :] * model.code[None], -20, 20)) @ model.trust
    near = np.exp(-4 * np.maximum(loss - loss.min(axis=1, keepdims=True), 0))
    best = loss.argmin(axis=1)
    rest = np.sort(loss, axis=1)
    lead = rest[:, 1] - rest[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
    return best, near.max(axis=1) / near.sum(axis=1), lead


def predict(docs: DataFrame, model: Model, *, text: str = "text", ambiguous_lead: float = 0.05) -> DataFrame:
    """All columns of ``docs``, with a struct ``lang_id`` of (lang, score, ambiguous) behind them."""
    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for lo in range(0, len(batch), 64):
                found = [ngram_counts(t, model.buckets) if model.langs else None for t in batch.iloc[lo:lo + 64]]
                rows = [(UNDETERMINED, 0.0, False)] * len(found)
                at = [i for i, f in enumerate(found) if f is not None]
                if at:
                    x = np.stack([found[i] for i in at]).astype(np.float32)
                    margins = (x @ model.weights) / x.sum(axis=1, keepdims=True)
                    for i, b, s, lead in zip(at, *decode(model, margins.astype(np.float64))):
                        rows[i] = (model.langs[b], round(float(s), 6), bool(lead < ambiguous_lead))
                out += rows
            yield pd.DataFrame(out, columns=["lang", "score", "ambiguous"])
        give_back()

    # only the texts go to Python; non-deterministic, lest a filter on the result computes it again
    return bounded_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                       label.asNondeterministic()(text_of(text)).alias("lang_id"))


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n
