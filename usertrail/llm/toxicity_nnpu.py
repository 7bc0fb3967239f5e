"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Only confirmed toxic examples and unlabelled texts are learned from.  With the class
prior p, the risk of a scorer is p R(toxic called toxic wrong) + [R(unlabelled
called clean wrong) - p R(toxic called clean wrong)]; the bracket estimates the
clean texts' risk, which can't be negative.  Where a batch makes it so, the step
goes the other way (the non-negative estimator), which keeps the classifiers from
learning the examples by heart.

Features are the hashed words, pairs of neighbouring words and beginnings of longer words that
a text holds (once each).  Those whose share among the toxic examples differs from that among the
unlabelled by ``least_z`` standard errors are kept, at most ``most_features``, the
strongest first.  A few logistic classifiers are trained by Adam on shuffled
batches (numpy, from different seeds); a text's score is their mean probability.

The fit takes bounded samples (documented parameter ``most_rows`` a side: the rows with the
smallest key hashes); the class prior is counted over all labels given.  Scoring
runs over every text, in tasks, with the few thousand weights in the closure.

Defined cases: a null text is empty; an empty text gets the bias's score; null
labels are not counted; a key labelled both 0 and 1 counts as toxic, and a repeated
document as often as it occurs; without a toxic example, or without unlabelled texts, every
score is the prior (0 without labels).  Other columns are carried by the caller.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usertrail.llm.common import WordHashes, bounded_batches, column, give_back, landed, mix64, slices, text_of, texts, words

BITS = 18
#: Lengths of the beginnings: inflected and compound words share them.
STARTS = (4, 5)


class Features:
    """The hash buckets of a text's words, of its neighbouring pairs, and of its longer words' beginnings."""

    def __init__(self, bits: int = BITS):
        self.bits, self.whole, self.starts = bits, WordHashes(), WordHashes()

    def __call__(self, text: str) -> np.ndarray:
        found = words(text)
        if not found:
            return np.empty(0, np.int64)
        hashes = self.whole(found)
        two = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
        starts = [self.starts([f"{w[:n]}-" for w in set(found) if len(w) > n]) for n in STARTS]
        return (mix64(np.concatenate([hashes, two, *starts])) >> np.uint64(64 - self.bits)).astype(np.int64)


@dataclass
class Model:
    slot: np.ndarray     # bucket -> feature number, or -1
    weights: np.ndarray  # classifiers x features
    bias: np.ndarray
    prior: float

    def score(self, found: np.ndarray) -> float:
        """From a text's buckets."""
        if not len(self.bias):
            return self.prior
        at = self.slot[found]
        at = np.unique(at[at >= 0])
        margin = self.weights[:, at].sum(axis=1) + self.bias
        return float((1 / (1 + np.exp(np.clip(-margin, -500, 500)))).mean())


def risk(margin_toxic: np.ndarray, margin_any: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the estimate under the logistic loss: toxic ones, and clean ones (may be below zero)."""
    loss = lambda z: np.logaddexp(0, -z).mean()
    return prior * loss(margin_toxic), loss(-margin_any) - prior * loss(-margin_toxic)


def fit(toxic: list[np.ndarray], unlabelled: list[np.ndarray], n: int, prior: float, *, seed: int = 0, epochs: int = 40,
        batch: int = 512, rate: float = 0.02, precision: float = 1.5) -> tuple[np.ndarray, float]:
    """One classifier, from the feature numbers that each text holds.

    ``precision`` is that of a normal prior on each weight: the fewer examples, the more it holds back."""
    decay = precision / max(len(toxic), 1)
    rng = np.random.default_rng(seed)
    w, m, v, t = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1), 0
    w[n] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))

    def margins(rows: list[np.ndarray]) -> np.ndarray:
        return np.asarray([w[r].sum() for r in rows]) + w[n]

    def pull(rows: list[np.ndarray], each: np.ndarray) -> np.ndarray:
        out = np.zeros(n + 1)
        np.add.at(out, np.concatenate(rows), np.repeat(each, [len(r) for r in rows]))
        out[n] = each.sum()
        return out / len(rows)

    steps = max(-(-max(len(toxic), len(unlabelled)) // batch), 1)
    for _ in range(epochs):
        order_p, order_u = rng.permutation(len(toxic)), rng.permutation(len(unlabelled))
        for k in range(steps):
            p = [toxic[i] for i in order_p[k::steps]] or toxic
            u = [unlabelled[i] for i in order_u[k::steps]] or unlabelled
            zp, zu = margins(p), margins(u)
            up, uu = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))  # slopes of the loss of being called clean
            clean = pull(u, uu) - prior * pull(p, up)
            if risk(zp, zu, prior)[1] >= 0:
                step = clean + prior * pull(p, up - 1)
            else:
                step = -clean
            step[:n] += decay * w[:n]
            t += 1
            m, v = 0.9 * m + 0.1 * step, 0.999 * v + 0.001 * step**2
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:n], float(w[n])


def learn(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic",
          prior: float | None = None, most_rows: int = 8_000, most_features: int = 4_096, least_z: float = 4.0,
          classifiers: int = 3, bits: int = BITS) -> Model:
    """Learn from ``docs`` as unlabelled texts and from those of them that ``labels`` calls toxic."""
    named = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    n_all, n_toxic = named.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    share = prior if prior is not None else (n_toxic / n_all if n_all else 0.0)
    nothing = Model(np.full(1 << bits, -1), np.empty((0, 0)), np.empty(0), share)
    order = [F.xxhash64("key"), "key"]
    chosen = (named.where("label = 1").select("key").distinct().orderBy(*order).limit(most_rows).withColumn("toxic", F.lit(1))
              .union(docs.select(F.col(key).alias("key")).where("key is not null").distinct().orderBy(*order)
                     .limit(most_rows).withColumn("toxic", F.lit(0))))
    rows = bounded_batches(docs).select(F.col(key).alias("key"), text_of(text).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in slices(batches):
            found = [np.unique(features(t)) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([column(batch, "toxic"), pa.array(found, pa.list_(pa.int64()))], ["toxic", "found"])
        give_back()

    # at most 2 * most_rows keys, so they may be broadcast
    sample = landed(rows.join(F.broadcast(chosen), "key").select("toxic", "text").mapInArrow(
        measure, "toxic int, found array<long>"), "toxicity")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2 or not 0 < share < 1:
        return nothing
    p, u = (F.col(c) / sizes[k] for c, k in (("n_1", 1), ("n_0", 0)))
    mean = (F.col("n_1") + F.col("n_0") + 1) / (sizes[1] + sizes[0] + 2)
    z = F.abs(p - u) / F.sqrt(mean * (1 - mean) * (1 / sizes[1] + 1 / sizes[0]))
    kept = (sample.select("toxic", F.explode("found").alias("bucket")).groupBy("bucket")
            .agg(F.count_if(F.col("toxic") == 1).alias("n_1"), F.count_if(F.col("toxic") == 0).alias("n_0"))
            .where(z >= least_z).orderBy(z.desc(), "bucket").limit(most_features).select("bucket").toArrow())
    chosen_buckets = np.asarray(kept.column("bucket"), dtype=np.int64)
    slot = np.full(1 << bits, -1)
    slot[chosen_buckets] = np.arange(len(chosen_buckets))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [slot[np.asarray(f.values, dtype=np.int64)] for f in column(batch, "found")]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "toxic"), pa.array([f[f >= 0].astype(np.int32) for f in found], pa.list_(pa.int32()))], ["toxic", "at"])

    held = sample.mapInArrow(reduce, "toxic int, at array<int>").toArrow().to_pylist()
    sides = {c: [np.asarray(r["at"], np.int64) for r in sorted(held, key=lambda r: r["at"]) if r["toxic"] == c] for c in (0, 1)}
    fits = [fit(sides[1], sides[0], len(chosen_buckets), share, seed=s) for s in range(classifiers)]
    return Model(slot, np.asarray([w for w, _ in fits]), np.asarray([b for _, b in fits]), share)


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1) of every text."""
    rows = bounded_batches(docs).select(F.col(key).alias("key"), text_of(text).alias("text"))
    bits = len(model.slot).bit_length() - 1

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in slices(batches):
            out = [round(model.score(features(t)), 6) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.array(out, pa.float64())], ["key", "score"])
        give_back()

    return rows.mapInArrow(rate, f"key {docs.schema[key].dataType.simpleString()}, score double")
