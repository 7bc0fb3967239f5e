"""Language ID by output codes and quality by quadratic discriminant: held-out accuracy and defined cases."""

from __future__ import annotations

import numpy as np
import pytest

from usertrail.llm import ecoc_langid as L
from usertrail.llm import quality_qda as Q
from usertrail.llm.queries import op2_quality_qda, op7_ecoc_langid

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6, 12, 40])
def test_codewords_are_apart(n):
    code = L.codewords(n).astype(int)
    assert code.shape[0] == n
    if n > 1:
        far = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(far) >= max(1, code.shape[1] // 4)
        assert (np.abs(code.sum(axis=0)) < n).all() or n > 5


def test_langid_held_out(spark):
    rows = {r.doc_id: r for r in op7_ecoc_langid(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    assert len(rows) == len(docs)
    held = [r for r in docs if rows[r.doc_id].held_out]
    assert 0.15 < len(held) / len(docs) < 0.35
    assert sum(rows[r.doc_id].lang_pred == r.lang for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_langid_defined_cases(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("nothing", None)],
                                  "text string, lang string")
    model = L.train(train)
    assert model.langs == ["de", "en"]
    docs = spark.createDataFrame([(1, None, 7), (2, "123 +!", 7), (3, "", 7), (4, "the dog the cat", 7), (5, "x" * 200_000, 7),
                                  (None, "die katze und der hund", 7)], "doc_id long, text string, doc int")
    got = {r.doc.doc_id: r.lang_id for r in L.predict(docs, model).collect()}
    assert [got[i].lang for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[4].lang == "en" and got[None].lang == "de" and got[5].lang in ("en", "de")
    empty = L.train(train.where("false"))
    assert {r.lang_id.lang for r in L.predict(docs, empty).collect()} == {"und"}
    one = L.train(train.where("lang = 'en'"))
    assert {r.lang_id.lang for r in L.predict(docs, one).collect()} == {"und", "en"}
    assert L.predict(docs.where("false"), model).count() == 0


def test_only_letters_count():
    """A text has a letter if and only if one of its characters is one by Unicode (str.isalpha)."""
    import sys

    for c in ["\u00b2", "\u00bd", "\u2167", "\u2460", "5", "\u0663", "_", "\u0301", "-"]:
        assert L.ngram_counts(f"{c} {c}") is None, c
    for c in ["a", "\u00e9", "\u65e5", "\u00aa", "\u0434"]:
        assert L.ngram_counts(f"{c} 5") is not None, c
    wrong = [c for c in map(chr, range(sys.maxunicode + 1)) if (L.only_letters(c).strip() != "") != c.isalpha()]
    assert not wrong, wrong[:5]


def test_quality_held_out(spark):
    rows = {r.doc_id: r for r in op2_quality_qda(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in labels if rows[r.doc_id].held_out]
    assert sum(rows[r.doc_id].predicted == r.quality for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())


def test_quality_moments_equal_plain():
    rng = np.random.default_rng(1)
    x = [rng.normal(c, 1 + c, (500, 3)) for c in (0, 1)]
    model = Q.fit({c: (500, v.sum(0), v.T @ v) for c, v in enumerate(x)}, shrinkage=0.1, ridge=0.02)
    covs = [np.cov(v.T, bias=True) for v in x]
    pooled = sum(covs) / 2
    for c in (0, 1):
        want = 0.88 * covs[c] + 0.1 * pooled + 0.02 * (np.diag(np.diag(pooled)) + 1e-6 * np.eye(3))
        got = np.linalg.inv(model.factors[c].T @ model.factors[c])
        assert np.allclose(got, want)
        assert np.isclose(model.log_dets[c], np.linalg.slogdet(want)[1])


def test_quality_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "word " * 50_000, 0), (None, "some text. here", 0)],
                                 "doc_id long, text string, x int")
    features = Q.featurise(docs)
    labels = spark.createDataFrame([(1, None), (3, 1)], "doc_id long, quality int")
    assert Q.learn(features, labels) is None
    assert {r.score for r in Q.score(features, None).collect()} == {0.5}
    assert Q.featurise(docs.where("false")).count() == 0


def test_langid_query_equals_plain(spark):
    """The query's languages and scores, from counts added up and decoded one text at a time."""
    import zlib

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    fold = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 for r in docs}
    counts = {r.doc_id: L.ngram_counts(r.text or "") for r in docs}
    langs = sorted({r.lang for r in docs if r.lang is not None and fold[r.doc_id] != 2 and counts[r.doc_id] is not None})
    sums = np.zeros((len(langs), L.BUCKETS))
    for r in docs:
        if r.lang is not None and fold[r.doc_id] != 2 and counts[r.doc_id] is not None:
            sums[langs.index(r.lang)] += counts[r.doc_id]
    model = L.fit(langs, sums)
    got = {r.doc_id: r for r in op7_ecoc_langid(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, c in counts.items():
        assert got[i].held_out == (fold[i] == 2)
        if c is None:
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        margins = (c.astype(np.float64) @ model.weights.astype(np.float64)) / c.sum()
        best, score, _ = L.decode(model, margins[None])
        assert got[i].lang_pred == langs[best[0]] and abs(got[i].score - score[0]) < 1e-3


def test_quality_query_equals_plain(spark):
    """The query's scores, from class moments of all learned rows and densities by the covariances' inverses."""
    import zlib

    sf = "/root/testdata/sf0.001"
    x = {r.doc_id: np.asarray(Q.statistics(r.text or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in x}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()
              if r.doc_id in x and fold[r.doc_id] != 0 and r.quality in (0, 1)]
    of = [np.asarray([x[i] for i, y in labels if y == c]) for c in (0, 1)]
    covs, n = [np.cov(v.T, bias=True) for v in of], [len(v) for v in of]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    level = np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(pooled))
    shrunk = [0.88 * c + 0.1 * pooled + 0.02 * level for c in covs]

    def density(v, c):
        d = v - of[c].mean(axis=0)
        return -0.5 * d @ np.linalg.solve(shrunk[c], d) - 0.5 * np.linalg.slogdet(shrunk[c])[1]

    for r in op2_quality_qda(spark, sf).collect():
        v = x.pop(r.doc_id)
        words = np.expm1(v[Q.FEATURES.index("words")])
        odds = words / (words + Q.TRUST_WORDS) * (density(v, 1) - density(v, 0)) + np.log(n[1] / n[0])
        assert abs(r.score - 1 / (1 + np.exp(np.clip(-odds, -500, 500)))) < 1e-4
        assert r.held_out == (fold[r.doc_id] == 0) and r.predicted == (r.score >= 0.3)
    assert not x
