"""BagMinHash signatures, and near-duplicate classes against all pairs."""

from __future__ import annotations

import random

import numpy as np

from usertrail.llm import bag_minhash as B
from usertrail.llm.common import WordHashes, mix64, word_bytes, words

H = WordHashes()


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    docs = []
    for _ in range(300):
        w = rng.integers(1, 12, 60)
        v = np.where(rng.random(60) < 0.5, w, rng.integers(1, 12, 60))
        docs.append((w, v))
    agree, want = [], []
    for w, v in docs:
        t = B.signatures(np.repeat([0, 1], 60), np.concatenate([base, base]), np.concatenate([w, v]), 2)
        agree.append((t[0] == t[1]).mean())
        want.append(np.minimum(w, v).sum() / np.maximum(w, v).sum())
    error = np.asarray(agree) - np.asarray(want)
    assert abs(error.mean()) < 4 * error.std() / np.sqrt(len(error)) + 1e-3
    assert error.std() < 1.3 * np.sqrt(np.mean([x * (1 - x) for x in want]) / B.SIZE)


def test_signature_ignores_order_and_batch():
    rng = np.random.default_rng(0)
    s, c = rng.integers(0, 2**63, 50, dtype=np.uint64), rng.integers(1, 9, 50)
    alone = B.signatures(np.zeros(50, int), s, c, 1)
    p = rng.permutation(50)
    both = B.signatures(np.r_[np.zeros(7, int), np.ones(50, int)], np.r_[s[:7], s[p]], np.r_[c[:7], c[p]], 2)
    assert (both[1] == alone[0]).all()


def plain_signature(shingles, counts, size, steps=4000):
    """Every process by itself, step by step, far beyond the point where none matters any more."""
    best, golden = np.full(size, np.inf), 0x9E3779B97F4A7C15
    one = lambda x: int(mix64(np.array([x % 2**64], np.uint64))[0])
    for shingle, count in zip(shingles.tolist(), counts.tolist()):
        low, high, seed = 0, 1, shingle
        while low < count:
            time = 0.0
            for step in range(1, steps):
                r = one(seed + step * golden)
                time -= np.log(((r >> 11) + 0.5) * 2.0**-53) / (high - low)
                if time >= best.max():
                    break
                s = one(r ^ 0xA0761D6478BD642F)
                bits, lo, hi = one(s + golden), low, high
                while lo < count < hi:
                    middle, bit, bits = (lo + hi) // 2, bits & 1, bits >> 1
                    lo, hi = (middle, hi) if bit else (lo, middle)
                if hi <= count:
                    at = (s >> 32) * size >> 32
                    best[at] = min(best[at], time)
            low, high = high, 2 * high
            seed = one(shingle + low * golden)
    return best


def test_signatures_equal_step_by_step_processes():
    rng = np.random.default_rng(8)
    sizes = [1, 3, 40, 2]
    doc, n = np.repeat(np.arange(len(sizes)), sizes), sum(sizes)
    shingle, count = rng.integers(0, 2**63, n, dtype=np.uint64), rng.choice([1, 1, 2, 3, 7], n)
    got = B.signatures(doc, shingle, count, len(sizes))
    for d in range(len(sizes)):
        assert (got[d] == plain_signature(shingle[doc == d], count[doc == d], B.SIZE)).all()


def test_few_processes_take_few_rounds(monkeypatch):
    """A text of one shingle needs some 900 points: they are drawn many at once, not a round of array calls each."""
    calls = []
    monkeypatch.setattr(B, "mix64", lambda x: calls.append(x.size) or mix64(x))
    B.signatures(np.zeros(1, np.int64), np.array([12345], np.uint64), np.ones(1, np.int64), 1)
    assert len(calls) < 100
    calls.clear()
    n = 50_000
    B.signatures(np.zeros(n, np.int64), np.arange(n, dtype=np.uint64), np.ones(n, np.int64), 1)
    assert max(calls) == n


def test_word_bytes_are_the_words():
    odd = "".join(map(chr, range(0x250))) + " \u3000x\u2028y\x85z\xa0Q \U0001F600É"
    for text in ("", " ", "Ab-cD9 x", odd, *(f"a{c}B" for c in odd)):
        assert word_bytes(text.encode()) == [w.encode() for w in words(text)]
    assert (H(words(odd)) == H(word_bytes(odd.encode()))).all()


def plain(rows, threshold=0.8):
    counts = [B.shingle_counts(t or "", H) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or (
                    len(counts[i][0]) and len(counts[j][0]) and B.similarity(counts[i], counts[j]) >= threshold):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted((sorted(map(str, g)) for g in groups.values()))


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    shared = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.5:
            w = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 40, 150]))]
            w += shared if rng.random() < 0.4 else []
        rows.append((k, " ".join(w) if w or rng.random() < 0.5 else None))
    return rows


def test_classes_equal_all_pairs(spark):
    rows = corpus(5, 150)
    docs = spark.createDataFrame([(*r, "x", 0, 0) for r in rows], "doc_id long, text string, t string, node int, bands int")
    groups = {}
    for r in B.near_duplicates(docs).collect():
        groups.setdefault(r.class_id, []).append(r["key"])
    assert sorted(sorted(map(str, g)) for g in groups.values()) == plain(rows)
    assert all(min(g) == c for c, g in groups.items())
    kept = B.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(groups)


def test_null_ids_and_repeats(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (None, "alone here"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["key"]), str(r.class_id)) for r in B.near_duplicates(docs).collect())
    assert got == sorted([("None", "3"), ("None", "3"), ("3", "3"), ("None", "None"), ("4", "4"), ("5", "4")])
    assert sorted(str(r.doc_id) for r in B.one_of_each(docs).collect()) == ["3", "4", "None"]
    assert B.near_duplicates(docs.where("false")).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "lead long, node long")
    got = {r.node: r.root for r in B.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}
