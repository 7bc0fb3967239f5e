"""Exact and proximity matches of the positional index against plain search."""

from __future__ import annotations

import random

import duckdb

from usertrail.llm import phrase_index as P
from usertrail.llm.common import words
from usertrail.llm.queries import ORACLE, op8_phrase_index


def plain(docs, items, size):
    out = []
    for key, text in docs:
        w = words(text or "")
        hit, found = set(), set()
        for item, t in items:
            for g in P.windows(words(t or ""), size):
                for s in range(len(w) - len(g) + 1):
                    if w[s:s + len(g)] == g:
                        hit.update(range(s, s + len(g)))
                        found.add("" if item is None else str(item))
        out.append((key, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["key"], r["n_words"], r["n_hit"], r["items"]) for r in df.collect()), key=repr)


def test_find_equals_plain(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK_BYTES", 300)  # many chunks
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["a", "B", "cé", "d.", "東", "x1"]) for _ in range(n))
    items = [(k % 25 if k else None, text(rng.choice([0, 1, 2, 3, 5, 7]))) for k in range(30)] + [(77, None), (78, "!!")]
    docs = [(k if k != 5 else None, text(rng.choice([0, 1, 4, 30]))) for k in range(80)] + [(9, None), (9, None)]
    ds = spark.createDataFrame([(*r, 0, "") for r in docs], "doc_id long, text string, sizes int, terms string").repartition(3)
    bs = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, chunk int")
    index = P.build_index(ds)
    assert got(P.find(index, bs, size=3)) == plain(docs, items, 3)
    for terms, slop in ((["A", "東"], 0), (["a", "東", "b"], 2), (["zz"], 3)):
        want = []
        for key, t in docs:
            w = words(t or "")
            for i, x in enumerate(w):
                want += [(key, i)] * (x in [q.lower() for q in terms] and all(
                    any(abs(j - i) <= slop for j, y in enumerate(w) if y == q.lower()) for q in terms))
        near = [(r["key"], r["position"]) for r in P.proximity(index, terms, slop).collect()]
        assert set(near) <= set(want) and {k for k, _ in near} <= {k for k, _ in want}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert P.find(P.build_index(docs.where("false")), items).count() == 0
    assert got(P.find(P.build_index(docs), items.where("false"))) == [(1, 2, 0, [])]
    assert got(P.find(P.build_index(docs), items)) == [(1, 2, 2, ["1"])]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = sorted(con.execute(ORACLE["op8_phrase_index"]).fetchall())
    assert sorted(map(tuple, op8_phrase_index(spark, sf).collect())) == want
    assert any(r[2] for r in want)
