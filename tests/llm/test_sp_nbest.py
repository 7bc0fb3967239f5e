"""N-best segmentations against enumeration of all paths, and exact round trips."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from usertrail.llm import sp_nbest as S

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")


def all_paths(lattice, text):
    text = lattice.lead + text.replace(" ", S.BLANK)

    def go(at):
        if at == len(text):
            yield 0.0, ()
            return
        for end, ids, score in lattice.arcs(text, at):
            for s, rest in go(end):
                yield score + s, (*ids, *rest)
    return sorted(go(0), key=lambda p: -p[0])


@pytest.mark.parametrize("text", ["a", "the cat", "in  on", "über", "a\nb", "東 é", "a, b.c", "m².", "thethe in", "​x", "ab ab ab"])
@pytest.mark.parametrize("n", [1, 2, 5, 12])
def test_n_best_equals_enumeration(text, n):
    lattice = S.lattice(PATH)
    want = all_paths(lattice, text)
    score, got = lattice.encode(text, n)
    assert score == want[0][0]
    assert [x for x, _ in got] == [want[0][0] - s for s, _ in want[:n]]
    every = {ids: s for s, ids in want}
    found = [tuple(np.frombuffer(p, "<u4").tolist()) for _, p in got]
    assert len(set(found)) == len(found)
    assert all(score - every[f] == loss for f, (loss, _) in zip(found, got))


def test_round_trip_random():
    rng, lattice = random.Random(2), S.lattice(PATH)
    for _ in range(300):
        text = "".join(rng.choice("ab  \n\té東🙂.,x1") for _ in range(rng.randrange(40)))
        assert lattice.decode(lattice.encode(text, 3)[1][0][1]) == text


def test_words_part_where_no_piece_joins():
    rng, lattice = random.Random(1), S.lattice(PATH)
    pairs = {p[i:i + 2] for p in lattice.pieces for i in range(len(p) - 1)}
    for _ in range(3000):
        text = "".join(rng.choice("abcom .,;:²!?\"')\n1é_🙂") for _ in range(40)).replace(" ", S.BLANK)
        found = lattice.cut.findall(lattice.lead + text)
        assert "".join(found) == lattice.lead + text
        assert not any(a[-1] + b[0] in pairs for a, b in zip(found, found[1:]))


def test_words_together_as_alone():
    rng, together, alone = random.Random(4), S.Lattice(PATH), S.Lattice(PATH)
    words = {"".join(rng.choice("▁abcdethein東🙂é.") for _ in range(rng.randrange(1, 14))) for _ in range(4000)}
    together.learn_all(words)
    for w in words:
        assert together.known[w] == alone.learn(w)


def test_frames(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "null id", 0), (4, "same", 0), (4, "same", 0), (5, "x" * 30_000, 0),
            (6, f"a{S.BLANK}b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    enc = S.encode(docs, PATH)
    got = {r["key"]: r for r in enc.collect()}
    assert got[1].n_pieces == got[2].n_pieces == 0 and got[1].losses == [0.0] and got[1].round_trip
    assert not got[6].round_trip and got[5].round_trip and enc.count() == len(rows)
    back = sorted((str(r["key"]), r.text) for r in S.decode(enc, PATH).collect())
    assert back == sorted((str(k), (t or "").replace(S.BLANK, " ")) for k, t, _ in rows)
    assert S.encode(docs.where("false"), PATH).count() == 0


@pytest.mark.parametrize("n", [1, 4, 12])
def test_replacements_spell_the_alternatives(spark, n):
    texts = [None, "", "a", "東", "the cat, in  on", "x" * 30_000, "über a\nb " * 200]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, alternatives long")
    rows = S.encode(docs, PATH, n_best=n).withColumn("alternatives", S.expanded()).collect()
    for r in rows:
        _, want = S.lattice(PATH).encode(texts[r["key"]] or "", n)
        assert [np.asarray(ids, "<u4").tobytes() for ids in [r.ids, *r.alternatives]] == [p for _, p in want]


def test_query_round_trips(spark):
    from usertrail.llm.queries import op4_sp_nbest
    rows = op4_sp_nbest(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.round_trip and r.losses[0] == 0 and r.losses == sorted(r.losses) for r in rows)


def test_query_returns_all_segmentations(spark):
    from usertrail.llm.queries import op4_sp_nbest
    sf, crc = "/root/testdata/sf0.001", lambda ids: zlib.crc32(np.asarray(ids, "<u4").tobytes())
    found = op4_sp_nbest(spark, sf).withColumn("alternatives", S.expanded())
    rows = found.collect()
    assert any(r.alternatives for r in rows)
    for r in rows:
        every = [r.ids, *r.alternatives]
        assert len(r.ids) == r.n_pieces and list(map(crc, every)) == r.ids_crc32 and len(set(map(tuple, every))) == len(every)
    text = {r.doc_id: (r.text or "").replace(S.BLANK, " ") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["key"]: r.text for r in S.decode(found, PATH, key="doc_id").collect()} == text
    second = found.where("size(alternatives) > 0").selectExpr("doc_id", "element_at(alternatives, -1) AS last")
    assert all(text[r["key"]] == r.text for r in S.decode(second, PATH, key="doc_id", ids="last").collect())
