"""Alignment of two tokenizers against a plain walk over the tokens of whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from usertrail.llm import token_align as T
from usertrail.llm.queries import op11_token_align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = ["", " ", "\n", "a\n", "  a  b ", "a▁b", "▁", "ﬁ Å é é", "a\tb\n\nc\n", "a\r\n", "\xa0x", "<s> </s> <|endoftext|> <0x41>",
       "\x00a", "日本 語\n語 日", "x\n'y 12345 ___   q　r", "\na b\nc", "é" * 300, "a  \n  b", "\x1c x\x1dy", "🙂🙂 🙂\n🙂", "w " * 50]


@pytest.fixture(scope="module")
def pair():
    return T.Pair(A, B, most=500)


def plain(pair, text):
    """Ids, groups and links by whole-text encoding, or None without tokens."""
    whole = f" {text}".encode()
    a, b = pair.a.encode(f" {text}", add_special_tokens=False).ids, pair.b.encode(text)
    bytes_a, bytes_b = [pair.bytes_a[i] for i in a], [pair.bytes_b[i] for i in b]
    if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return None
    groups, links, i, j, end_a, end_b = [([], [])], [], 0, 0, len(bytes_a[0]), len(bytes_b[0])
    while True:
        links.append((a[i], b[j]))
        here = min(end_a, end_b)
        both = end_a == end_b
        if end_a == here:
            groups[-1][0].append(a[i])
        if end_b == here:
            groups[-1][1].append(b[j])
        if here == len(whole):
            break
        if both:
            groups.append(([], []))
        if end_a == here:
            i += 1
            end_a += len(bytes_a[i])
        if end_b == here:
            j += 1
            end_b += len(bytes_b[j])
    shown = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
    return len(a), len(b), len(groups), links, hashlib.sha256(shown.encode()).hexdigest()


def expected(pair, texts):
    found = [plain(pair, t or "") for t in texts]
    held = Counter(p for f in found if f for p in set(f[3]))
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    return [(0,) * 6 + ("",) if f is None else (f[0], f[1], f[2], len(f[3]), sum(held[p] == top[p[0]] for p in f[3]),
                                                sum(held[p] for p in f[3]), f[4]) for f in found]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query_equals_plain(spark, pair):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in op11_token_align(spark, SF).collect()}
    assert len(got) == len(docs)
    assert [got[d.doc_id] for d in docs] == expected(pair, [d.text for d in docs])


def test_encoding_in_units_is_whole_text_encoding(pair):
    rng = random.Random(3)
    bits = ["a", "the", "ing", " ", " ", " ", "\n", "\t", "é", "日", "'s", "12", ".", "  ", "X", "\r", "\xa0", "<|endoftext|>", "▁"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(1500)]
    for lo in range(0, len(texts), 100):
        for t, got in zip(texts[lo:lo + 100], pair(texts[lo:lo + 100])):
            want = plain(pair, t)
            assert (got is None) == (want is None), t
            if got:
                assert tuple(len(x) // 4 for x in got) == want[:2], t
                assert got[0] == memoryview(T.np.asarray(pair.a.encode(f" {t}", add_special_tokens=False).ids, T.np.int32)).tobytes(), t
                assert got[1] == memoryview(T.np.asarray(pair.b.encode(t), T.np.int32)).tobytes(), t


def test_defined_cases(spark, pair):
    long = "lorem ipsum\ndolor sit " * 20_000
    texts = [None, *ODD, long, "the same text", "the same text"]
    rows = [(None if i % 7 == 0 else i // 2, t, i, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs int, block string").repartition(3)
    for block_bytes in (1, 16 << 20):
        found = T.blocks(docs, A, B, block_bytes=block_bytes)
        got = T.measure(found, T.pair_counts(found, pair.n_b)).collect()
        want = expected(pair, texts)
        assert sorted((str(r.key), *(r[c] for c in COLUMNS)) for r in got) == sorted(
            (str(k), *w) for (k, *_), w in zip(rows, want))
    assert T.alignments(docs.where("false"), A, B).count() == 0


def test_pair_counts_are_documents(spark, pair):
    docs = spark.createDataFrame([(1, "hello hello hello"), (2, "hello"), (3, "unbelievable hello")], "doc_id long, text string")
    found = T.blocks(docs.repartition(3), A, B)
    counts = {r.pair: r["count"] for r in T.pair_counts(found, pair.n_b).collect()}
    a, b = pair.a.encode(" hello", add_special_tokens=False).ids[0], pair.b.encode("hello")[0]
    assert counts[a * pair.n_b + b] == 3
