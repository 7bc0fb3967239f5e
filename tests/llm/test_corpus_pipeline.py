"""The pipeline against its stages done plainly, one document at a time, on the driver."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from tests.llm.test_bag_minhash import plain as near_groups
from tests.llm.test_line_dedup import plain as without_lines
from tests.llm.test_phrase_index import plain as hits
from usertrail.llm import ecoc_langid, sp_nbest

SF = "/root/testdata/sf0.001"


def test_stages_named_and_columns_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_equals_plain(spark):
    import public_tokenizers

    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = ecoc_langid.train(table)
    rows = []
    for r in table.collect():
        counts = ecoc_langid.ngram_counts(r.text or "")
        if counts is not None:
            margins = (counts.astype(np.float32)[None] @ model.weights) / counts.sum()
            if ecoc_langid.decode(model, margins.astype(np.float64))[2][0] >= 0.05:
                rows.append((r.doc_id, r.text))
    rows = [(i, t) for i, t, _ in without_lines(rows)]
    kept = {min(map(int, g)) for g in near_groups(rows)}
    rows = [r for r in rows if r[0] in kept]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, _, n, _ in hits(rows, items, 10) if n == 0}
    of = sp_nbest.lattice(public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: np.frombuffer(of.encode(t or "", 4)[1][0][1], "<i4").tolist() for i, t in rows if i in clean}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
    assert 0 < len(got) < table.count()


def test_empty_and_null(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0)], docs.schema)
    for start in (odd, docs.where("false")):
        out = start
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, SF)
        assert out.count() == 0
