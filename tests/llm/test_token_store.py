"""Binary token shards and their minimal perfect hash index."""

from __future__ import annotations

import random
import zlib
from functools import cache

import numpy as np
import pytest

from usertrail.llm import token_store as S
from usertrail.llm.common import scratch

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "plain words, plain words.", "two  blanks\n\n\tand tabs \n", "it's 12,345 – naïve 東京 🙂 don't",
         "a<|endoftext|>b", "\x1c odd \x85 space　end ", "x" * 5000 + " y" * 3000]


@cache
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def plain(text):
    return library().encode(text or "", add_special_tokens=False).ids + [2]


def test_encoder_equals_library():
    enc = S.Encoder(PATH)
    for _ in range(2):  # with new and with known words
        assert [np.frombuffer(x, enc.dtype).tolist() + [2] for x in enc(TEXTS)] == [plain(t) for t in TEXTS]


def test_encoder_equals_library_on_random_texts():
    rng = random.Random(5)
    signs = "ab Zé.,!?'\n\t\xa0 \u20281½²Ⅷ東🙂_#  "
    batch = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(800)]
    got = S.Encoder(PATH)(batch)
    assert [np.frombuffer(x, "<u2").tolist() + [2] for x in got] == [plain(t) for t in batch]


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_mph_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    h1, h2 = (rng.integers(0, 2**63, n, dtype=np.uint64) for _ in range(2))
    levels, rank = S.build_mph(h1, h2)
    assert sorted(rank.tolist()) == list(range(n))
    assert (S.find_mph(levels, h1, h2) == rank).all()


def test_round_trip_with_nulls_copies_and_strangers(spark):
    rows = [(5, t, "x") for t in TEXTS] + [(None, "no key", "x"), (9, None, "x"), (5, "plain words, plain words.", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    path = scratch(spark, "t")
    found = S.write_store(docs, path, PATH)
    n = S.build_index(found, path)
    assert found.count() == len(rows)
    asked = found.select("key", "copy")
    strangers = spark.createDataFrame([(77, 0), (5, 99)], "key long, copy long")
    places = S.lookup(asked.unionByName(strangers), path, n)
    assert places.where("shard is null").count() == 2
    got = S.read_payloads(places, path).collect()
    assert sorted(map(tuple, (r.ids for r in got))) == sorted(tuple(plain(t)) for _, t, _ in rows)
    assert all(r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) for r in got)
    assert sorted(r["copy"] for r in got if r["key"] == 5) == list(range(8))
    store = S.TokenStore(path, n)
    want = {(r["key"], r["copy"]): r.ids for r in got}
    for r in S.key_hashes(asked).collect():
        assert store.get(r.h1, r.h2).tolist() == want[r["key"], r["copy"]]
    assert all(store.get(r.h1, r.h2) is None for r in S.key_hashes(strangers).collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = scratch(spark, "t")
    found = S.write_store(docs, path, PATH)
    assert found.count() == 0 and S.build_index(found, path) == 1


def test_query_equals_plain(spark):
    from usertrail.llm.queries import op1_token_store
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op1_token_store(spark, sf).collect()}
    at, want = 0, {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = plain(r.text)
        want[r.doc_id] = (at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want
