"""Toxicity from positive and unlabelled texts: held-out results, the risk by hand, and defined cases."""

from __future__ import annotations

import numpy as np
import pytest

from usertrail.llm import toxicity_nnpu as X
from usertrail.llm.queries import op12_toxicity_nnpu

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    return {r.doc_id: r for r in op12_toxicity_nnpu(spark, SF).collect()}


def test_held_out(spark, scored):
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(scored) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored.values())
    held = [r for r in labels if scored[r.doc_id].held_out]
    assert 0.15 < len(held) / len(labels) < 0.35
    assert np.mean([scored[r.doc_id].predicted == r.toxic for r in held]) >= 0.94
    clean = [r for r in held if not r.toxic]
    assert np.mean([scored[r.doc_id].predicted for r in clean]) <= 0.02


def test_scores_are_the_models(spark):
    """A plain loop over the words gives the same scores."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = X.learn(spark.read.parquet(f"{SF}/documents.parquet"), labels, most_rows=2000)
    import xxhash

    from usertrail.llm.common import words
    for r, s in zip(docs.orderBy("doc_id").collect(), X.score(docs, model).orderBy("key").collect()):
        plain = words(r.text or "")
        found = [xxhash.xxh64_intdigest(w) for w in plain]
        mixed = [*found, *((a * 0x9E3779B97F4A7C15 + b) % 2**64 for a, b in zip(found, found[1:])),
                 *(xxhash.xxh64_intdigest(w[:n] + "-") for w in plain for n in X.STARTS if len(w) > n)]
        at = {int(model.slot[int(X.mix64(np.asarray([m], np.uint64))[0]) >> (64 - X.BITS)]) for m in mixed} - {-1}
        margins = [sum(w[i] for i in at) + b for w, b in zip(model.weights, model.bias)]
        assert s.key == r.doc_id and s.score == pytest.approx(np.mean([1 / (1 + np.exp(-m)) for m in margins]), abs=2e-6)


def test_risk_by_hand():
    zp, zu, prior = np.asarray([2.0, -1.0]), np.asarray([0.5, -3.0, 1.0]), 0.3
    loss = lambda z: np.log(1 + np.exp(-z))
    toxic, clean = X.risk(zp, zu, prior)
    assert toxic == pytest.approx(0.3 * (loss(2.0) + loss(-1.0)) / 2)
    assert clean == pytest.approx((loss(-0.5) + loss(3.0) + loss(-1.0)) / 3 - 0.3 * (loss(-2.0) + loss(1.0)) / 2)


def test_fit_is_calibrated_and_keeps_the_clean_risk_from_falling_below_zero():
    rng = np.random.default_rng(0)
    draw = lambda bad: np.flatnonzero(rng.random(6) < ([0.9, 0.1, 0.5, 0.5, 0.5, 0.5] if bad else [0.05, 0.6, 0.5, 0.5, 0.5, 0.5]))
    toxic, other = [draw(True) for _ in range(1000)], [draw(rng.random() < 0.2) for _ in range(4000)]
    w, b = X.fit(toxic, other, 6, 0.2, epochs=60)
    say = lambda rows: 1 / (1 + np.exp(-np.asarray([w[r].sum() + b for r in rows])))
    assert say(other).mean() == pytest.approx(0.2, abs=0.05)
    assert say([draw(True) for _ in range(500)]).mean() > 0.6 > 0.15 > say([draw(False) for _ in range(500)]).mean()
    # every text has a feature of its own: an unconstrained fit would drive the estimate far below zero
    own_p, own_u = [np.asarray([i]) for i in range(50)], [np.asarray([50 + i]) for i in range(50)]
    w, b = X.fit(own_p, own_u, 100, 0.5, epochs=300, precision=0)
    assert X.risk(w[:50] + b, w[50:] + b, 0.5)[1] > -0.2


def test_defined_cases(spark):
    docs = spark.createDataFrame(
        [(1, None, 0), (2, "", 0), (None, "some text", 0), (4, "bad " * 50_000, 0), (5, "bad words", 1), (5, "bad words", 1)]
        + [(k, "good words here", 0) for k in range(10, 60)] + [(k, "bad words here", 0) for k in range(60, 70)],
        "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(1, None), (None, 1), (5, 0), (5, 1), *((k, 1) for k in range(60, 66)), *((k, 0) for k in range(10, 40))],
                                   "doc_id long, toxic int")
    model = X.learn(docs, labels, least_z=1.0)
    got = X.score(docs, model).collect()
    assert len(got) == docs.count()
    by = {r.key: r.score for r in got}
    assert by[1] == by[2] and by[60] > by[10] and by[5] > by[10] and all(0 <= r.score <= 1 for r in got)
    none = X.learn(docs, labels.where("toxic = 0"))
    assert {r.score for r in X.score(docs, none).collect()} == {0.0}
    assert {r.score for r in X.score(docs, X.learn(docs, labels.where("false"))).collect()} == {0.0}
    assert X.score(docs.where("false"), model).count() == 0
    empty = X.learn(docs.where("false"), labels)
    assert {r.score for r in X.score(docs, empty).collect()} == {round(empty.prior, 6)}
