"""Spelling groups against a plain comparison of all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from usertrail.llm import spelling_groups as S
from usertrail.llm.queries import op13_spelling_groups


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def expected(counts):
    """From word -> n; candidates by deleted letters, which both of a near pair share."""
    shared = {}
    for w in counts:
        for v in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            shared.setdefault(v, []).append(w)
    close = {w: set() for w in counts}
    for ws in shared.values():
        for a in ws:
            close[a].update(b for b in ws if near(a, b))
    form = {}
    for w, n in counts.items():
        best = min(close[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(close[w]), counts[form[w]] if form[w] else None))
    return out


def plain_counts(docs):
    total = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{key}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_plain(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op13_spelling_groups(spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = got.collect()
    assert len(rows) == len({r.word for r in rows})
    assert {tuple(r) for r in rows} == expected(plain_counts(docs))


@pytest.mark.parametrize("part_words", [3, 4096])
def test_random_words(spark, part_words):
    rng = random.Random(part_words)
    words = {}
    for _ in range(400):
        w = "".join(rng.choice("abcdeéÉ×") for _ in range(rng.randrange(6, 10)))
        for v in (w, w[1:], w[:3] + rng.choice("aé") + w[4:], w + "a", w + "é"):
            if len(v) >= 6:
                words[v] = rng.choice([5, 5, 5, 25, 125, 700])
    for k in range(8):  # a chain of forms
        words["chainlink" + "x" * k] = 5 ** (8 - k)
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in S.groups(frame, part_words=part_words).collect()]
    assert len(got) == len(words) and set(got) == expected(words)


def test_defined_cases(spark):
    long = "verylong" * 50_000
    rows = [(None, "Variant variant VARIANT variant variant", 1), (1, None, 1), (2, "", 1), (3, "Été été " * 9, 1), (3, "variants " * 40, 1),
            (3, "variants " * 40, 1), (4, f"{long} " * 5, 1), (4, f"{long}s " * 30, 1), (5, "a1b2 short", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(2)
    counted = {r.word: r.n for r in S.count_words(docs, typo_one_in=None).collect()}
    assert counted == {"variant": 5, "variants": 80, long: 5, long + "s": 30}
    got = {r.word: r for r in S.groups(S.count_words(docs, typo_one_in=None)).collect()}
    assert got["variant"].form == got["variant"].root == "variants" and got["variants"].form is None
    assert got[long].form == long + "s" and got[long].n_near == 1
    assert S.groups(S.count_words(docs.where("false"))).count() == 0
