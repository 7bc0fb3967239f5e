"""Prefix polynomial hashes against plain comparison of the texts."""

from __future__ import annotations

import hashlib
import random

from usertrail.llm import span_hash as H


def prefix(text):
    return H.Prefix(H.code_points(text))


def test_spans_and_extensions():
    rng = random.Random(4)
    for _ in range(200):
        a = "".join(rng.choice("ab🙂") for _ in range(rng.randrange(0, 40)))
        b = "".join(rng.choice("ab🙂") for _ in range(rng.randrange(0, 40)))
        p, q = prefix(a), prefix(b)
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        n = rng.randrange(0, 6)
        fits = i + n <= len(a) and j + n <= len(b)
        assert H.same_span(p, i, q, j, n) == (fits and a[i:i + n] == b[j:j + n])
        want = 0
        while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
            want += 1
        assert H.common_extension(p, i, q, j) == want


def test_continued_prefix_is_the_whole_texts():
    a, b = prefix("hello world"), prefix("hello there")
    cont = H.Prefix(H.code_points("there"), a.values[:, :7])
    assert (cont.values == b.values).all()


def test_likeness():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    f = H.fingerprint(prefix(text))
    assert H.likeness(f, f) == 1.0
    edited = H.fingerprint(prefix(text[:3750] + "".join(rng.choice("xyz") for _ in range(1250))))
    assert 0.7 <= H.likeness(f, edited) <= 0.75
    middle = H.fingerprint(prefix(text[:2000] + "#" + text[2001:]))
    assert 0.93 <= H.likeness(f, middle) < 1.0
    other = H.fingerprint(prefix("".join(rng.choice("abcdefgh ") for _ in range(9000))))
    assert H.likeness(f, other) < 0.05
    longer = H.fingerprint(prefix(text + text))
    assert 0.45 <= H.likeness(f, longer) == H.likeness(longer, f) <= 0.5
    empty = H.fingerprint(prefix(""))
    assert H.likeness(empty, empty) == 1.0 and H.likeness(empty, f) == 0.0


def test_shifted_text_stays_alike():
    rng = random.Random(6)
    for n in (500, 5000, 40_000):
        text = "".join(rng.choice("abcdefgh é🙂") for _ in range(n))
        f = H.fingerprint(prefix(text))
        for near in ("#" + text, text[1:], text[:n // 9] + "new" + text[n // 9:], "words put in front " + text):
            g = H.fingerprint(prefix(near))
            assert 0.6 < H.likeness(f, g) == H.likeness(g, f) < 1.0
        assert H.likeness(f, H.fingerprint(prefix("".join(rng.choice("abcdefgh é🙂") for _ in range(n))))) < 0.1


def want(rows):
    rows = sorted(rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        n, cut = len(t), len(t) // 4
        nxt = rows[(k + 1) % len(rows)][1]
        edited = t[:n - cut] + nxt[:cut]
        f, g, h = (H.fingerprint(prefix(x)) for x in (t, edited, nxt))
        out[i] = (n, hashlib.sha256(edited.encode()).hexdigest(), f, g, H.likeness(f, g), H.likeness(f, h))
    return out


def got(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in df.collect()}


def test_query_equals_plain(spark):
    from usertrail.llm.queries import op6_span_hash
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op6_span_hash(spark, sf)) == want(rows)


def test_small_tables(spark):
    schema = "doc_id long, text string, part long, whole string"
    rows = [(1, "", 0, ""), (2, "abcdefgh", 0, ""), (3, None, 0, ""), (4, "x", 0, "")]
    df = H.fingerprints(spark.createDataFrame(rows, schema).repartition(3))
    assert got(df) == want([(i, t or "") for i, t, *_ in rows])
    one = H.fingerprints(spark.createDataFrame([(5, "abcdefgh", 1, "")], schema))
    assert got(one) == want([(5, "abcdefgh")])
    assert H.fingerprints(spark.createDataFrame([], schema)).count() == 0
    twice = H.fingerprints(spark.createDataFrame([(None, "same text", 1, ""), (None, "same text", 1, "")], schema)).collect()
    assert [r.near_next for r in twice] == [1.0, 1.0]
