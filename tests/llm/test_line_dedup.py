"""Line dedup against a plain comparison of all lines."""

from __future__ import annotations

import random

import duckdb
from pyspark.sql import functions as F

from usertrail.llm import line_dedup as D
from usertrail.llm.queries import ORACLE, op3_line_dedup, op3_line_dedup_every



def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(rows):
    """[(id, new text, n_dropped)], rows of distinct ids or of equal content."""
    out, before = [], []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = [] if text is None else text.split("\n")
        stay = []
        for line in lines:
            w = line.strip(" ").lower().split(" ")
            gone = w != [""] and any(w == b or (min(len(w), len(b)) >= 8 and abs(len(w) - len(b)) <= 1
                                                and distance(w, b) <= 1) for b in before)
            if not gone:
                before.append(w)
                stay.append(line)
        out.append((doc_id, None if text is None else "\n".join(stay), len(lines) - len(stay)))
    return out


def test_within_one(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(400):
        a = [rng.choice("xyz") for _ in range(rng.randrange(6))]
        b = [rng.choice("xyz") for _ in range(rng.randrange(6))] if rng.random() < 0.5 else list(a)
        if b and rng.random() < 0.7:
            b[rng.randrange(len(b))] = rng.choice("xyz")
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>").withColumn("ok", D.within_one(F.col("a"), F.col("b")))
    assert all(r.ok == (distance(r.a, r.b) <= 1) for r in df.collect())


def corpus(seed):
    rng = random.Random(seed)
    lines, rows = [""], []
    for k in range(60):
        doc = []
        for _ in range(rng.randrange(8)):
            if rng.random() < 0.6 and lines:
                w = rng.choice(lines).split(" ")
                act = rng.randrange(5)
                at = rng.randrange(len(w))
                if act == 0:
                    w[at] = rng.choice("abc")
                elif act == 1:
                    del w[at]
                elif act == 2:
                    w.insert(at, rng.choice("abc"))
                line = " ".join(w)
                line = line.upper() + "!" if act == 3 else line
            else:
                line = " ".join(rng.choice("abc") for _ in range(rng.choice([0, 3, 5, 7, 8, 9, 15, 16, 17, 33])))
            lines.append(line)
            doc.append(line)
        rows.append((k, "\n".join(doc)))
    return rows


def test_equals_plain(spark):
    rows = corpus(3) + [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "long " + "word " * 3000 + "end")]
    docs = spark.createDataFrame([(*r, 0, 0, "") for r in rows], "doc_id long, text string, line int, n int, first string").repartition(4)
    got = sorted((r.doc.doc_id, r.text, r.n_dropped) for r in D.dedup(docs).collect())
    assert got == sorted(plain(rows))
    assert sum(r[2] for r in got) > 50


def test_chain_keeps_every_other_line(spark):
    w = [f"w{k}" for k in range(12)]
    chain = [" ".join([f"new{i}" for i in range(k)] + w[k:]) for k in range(7)]
    docs = spark.createDataFrame([(k, line) for k, line in enumerate(chain)], "doc_id long, text string")
    got = {r.doc.doc_id: r.text for r in D.dedup(docs).collect()}
    assert got == {k: line if k % 2 == 0 else "" for k, line in enumerate(chain)}
    # lines that stay for different reasons: the shorter one goes for a later-made variant that stays
    rows = [(1, " ".join(w)), (2, " ".join(w[:5] + ["x"] + w[5:])), (3, " ".join(w[:5] + ["x", "y"] + w[5:])),
            (4, " ".join(w[:5] + ["x", "y", "z"] + w[5:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc.doc_id, r.text, r.n_dropped) for r in D.dedup(docs).collect()) == plain(rows)


def test_null_ids_and_repeats(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven"
    rows = [(None, f"{a}\nx"), (1, a), (1, a), (2, f"{b}\nshort"), (2, f"{b}\nshort")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc.doc_id), r.text) for r in D.dedup(docs).collect())
    assert got == sorted([("None", "x"), ("1", a), ("1", ""), ("2", f"{b}\nshort"), ("2", "")])
    got = sorted((str(r.doc.doc_id), r.text) for r in D.dedup(docs, min_words=5).collect())
    assert got == sorted([("None", "x"), ("1", a), ("1", ""), ("2", f"{b}\nshort"), ("2", "short")])
    assert D.dedup(docs.where("false")).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = sorted(con.execute(ORACLE["op3_line_dedup"]).fetchall())
    assert sorted(map(tuple, op3_line_dedup(spark, sf).collect())) == want
    assert any(r[2] for r in want)


def test_every_repeat_whatever_its_words(spark):
    rows = [(1, "Menu\n\n東京都の天気\n  \nnext page"), (2, "menu \n\n東京都の天気\n  \nNext Page\nown"), (3, "x"), (3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc.doc_id, r.text, r.n_dropped) for r in D.dedup(docs, min_words=1).collect())
    assert got == [(1, rows[0][1], 0), (2, "\n  \nown", 3), (3, "", 1), (3, "x", 0)]


def test_query_of_every_repeat_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = sorted(con.execute(ORACLE["op3_line_dedup_every"]).fetchall())
    assert sorted(map(tuple, op3_line_dedup_every(spark, sf).collect())) == want
    assert any(r[2] for r in want)
