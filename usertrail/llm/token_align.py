"""Alignment of two tokenizers over the same texts, in Arrow tables.

Each text is encoded by a byte-level BPE (A, over a blank and the text) and by a
SentencePiece model (B, over the text; it adds the blank itself).  Per piece of
at most ``slices`` bytes of texts, the ids lie in Arrow lists: flattened ids with
their parents' indices, byte lengths by ``take``, ends by a cumulative sum that
starts again with each document.  A full outer hash join (Acero) of A's and B's
(document, end) keys gives the alignment: a key that both sides know closes a
group, and every key closes one link, as the stretch up to it lies in exactly one
token of each side.  ``Table.group_by`` counts the links of a block's documents
by (document, id pair) and then by id pair.

A block is what one row of the landed table holds: some documents, the id pairs
that occur in them with the number of its documents that hold each (partial
counts), and the documents' pairs as places in that list.  Spark sums the partial
counts over all blocks, finds the highest count of each A id and hands every block the
counts of its own pairs; so only pairs by block are shuffled, never links.  A block ends at
``block_bytes`` of text or with one longer document.

Encoding cuts a text where neither tokenizer joins across: before a blank behind
something else than white space, and around a line end between two such.  What
stands between is encoded once and remembered, up to ``most`` of them.

Defined cases: a text that is null or empty, or whose tokens' bytes on either side
differ from a blank and the text (U+2581 in the text), has no tokens: zeros and ''.
Rows with null or repeated keys are documents like others; columns other than key
and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usertrail.llm.common import bounded_batches, column, give_back, landed, slices, text_of, texts

_ODD = re.compile("[^\\S \n]|[ \n][ \n]|[ \n]\\Z|▁")
_CUT = re.compile(r"(?<=\S)(?= \s*\S)")
_SHORT = 80  # code points of a unit that is worth remembering


def _byte_table() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(hidden)}}


class Pair:
    """Both encoders, with the bytes of every token."""

    def __init__(self, path_a: str, path_b: str, most: int = 300_000):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.most, self.known, self.before = most, {}, {}
        of = _byte_table()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, number in vocabulary.items():
            self.bytes_a[number] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a = np.asarray([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.asarray([len(x) for x in self.bytes_b], np.int64)
        self.names_a = pa.array([str(i) for i in range(len(self.bytes_a))])
        self.names_b = pa.array([str(i) for i in range(len(self.bytes_b))])
        self.n_b = len(self.bytes_b)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _whole(self, unit: str) -> tuple[bytes, bytes] | None:
        """Ids of a stretch that starts with a blank, as packed int32; None if its bytes are not the tokens'."""
        a = self.a.encode(unit, add_special_tokens=False).ids
        b = self.b.encode(unit[1:])
        raw = unit.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        return np.asarray(a, np.int32).tobytes(), np.asarray(b, np.int32).tobytes()

    def _together(self, units: list[str]) -> None:
        """Units of one kind of text ("word" stands behind a blank, "\\nword" behind a line end), as one text."""
        parts = [u if u[0] == "\n" else f" {u}" for u in units]
        if parts[0][0] == "\n":
            parts.insert(0, " x")
            units = ["x", *units]
        text = "".join(parts)
        raw = [p.encode() for p in parts]
        whole, ends = b"".join(raw), np.cumsum([len(r) for r in raw])
        out = []
        for ids, sizes, of in ((self.a.encode(text, add_special_tokens=False).ids, self.size_a, self.bytes_a),
                               (self.b.encode(text[1:]), self.size_b, self.bytes_b)):
            if b"".join(map(of.__getitem__, ids)) != whole:
                raise ValueError("a tokenizer's ids do not hold the bytes of plain words")
            ids = np.asarray(ids, np.int32)
            at = np.cumsum(sizes[ids])
            cut = np.searchsorted(at, ends)
            if (at[cut] != ends).any():
                raise ValueError("a tokenizer joins across words")
            packed, cut = ids.tobytes(), ((cut + 1) * 4).tolist()
            out.append([packed[x:y] for x, y in zip([0, *cut], cut)])
        self.known.update(zip(units, zip(*out)))

    def _learn(self, new: set[str]) -> None:
        for u in list(new):
            if (x := self.before.get(u)) is not None:
                self.known[u] = x
                new.discard(u)
        todo, size = [], 0
        for u in sorted(new):  # a text at a time of moderate length
            todo.append(u)
            size += len(u)
            if size > 30_000:
                self._together(todo)
                todo, size = [], 0
        if todo:
            self._together(todo)

    def __call__(self, batch: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Per text the packed ids of both sides, or None without tokens."""
        if len(self.known) > self.most:
            self.known, self.before = {}, self.known
        out, held, new = [None] * len(batch), [], set()
        known = self.known
        for i, t in enumerate(batch):
            if not t:
                continue
            if t[0] in " \n" or _ODD.search(t):
                units = [u if u[1] in " \n" or _ODD.search(u, 1) else u[1:] for u in _CUT.split(f" {t}")]
            else:
                units = t.replace("\n", " \n").split(" ")
            held.append((i, units))
            new.update(u for u in units if u not in known)
        passing: dict[str, tuple[bytes, bytes] | None] = {u: None for u in new if u[:1] == " " or len(u) > _SHORT}
        if passing:
            new.difference_update(passing)
            for u in passing:
                if u[0] == "\n":  # behind a blank of its own, which is then taken away
                    one = self._whole(f" x{u}")
                    passing[u] = None if one is None else tuple(x[len(y):] for x, y in zip(one, self._whole(" x")))
                else:
                    passing[u] = self._whole(u if u[0] == " " else f" {u}")
        if new:
            self._learn(new)
        for i, units in held:
            got = [known[u] if u in known else passing[u] for u in units]
            if None not in got:
                out[i] = tuple(b"".join(side) for side in zip(*got))
        return out


@lru_cache(maxsize=1)
def _pair(path_a: str, path_b: str) -> Pair:
    """One a Python worker, so that later tasks find the words known."""
    return Pair(path_a, path_b)


def _side(found: list[bytes], sizes: np.ndarray, name: str) -> tuple[pa.ListArray, pa.Table]:
    """The ids as a list a document, and a table of (document, end) keys with the token's place."""
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))
    ids, doc = lists.flatten(), pc.list_parent_indices(lists)
    total = pc.cumulative_sum(pc.take(pa.array(sizes), ids))
    before = np.concatenate([[0], total.to_numpy()])[offsets[:-1]]
    ends = pc.subtract(total, pc.take(pa.array(before), doc))
    key = pc.add(pc.shift_left(pc.cast(doc, pa.int64()), 40), ends)
    return lists, pa.table({"key": key, name: pa.array(np.arange(len(ids), dtype=np.int32))})


def align(pair: Pair, found: list[tuple[bytes, bytes]]) -> dict[str, pa.Array | np.ndarray]:
    """Groups and links of documents that have tokens: one entry a document and one a link."""
    lists_a, ends_a = _side([x for x, _ in found], pair.size_a, "a")
    lists_b, ends_b = _side([x for _, x in found], pair.size_b, "b")
    both = ends_a.join(ends_b, "key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
    key = both["key"].to_numpy()
    is_a, is_b = (pc.is_valid(both[c]).to_numpy() for c in "ab")
    # the token that a link lies in is the first to end there or later
    at_a, at_b = np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b
    ids_a, ids_b = lists_a.flatten(), lists_b.flatten()
    doc = key >> 40
    shared = np.flatnonzero(is_a & is_b)
    groups = [pc.binary_join(pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], at[shared] + 1]).astype(np.int32)), pc.take(names, ids)), ",")
        for at, names, ids in ((at_a, pair.names_a, ids_a), (at_b, pair.names_b, ids_b))]
    n_groups = np.bincount(doc[shared], minlength=len(found))
    joined = pc.binary_join_element_wise(*groups, "|")
    shown = pc.binary_join(pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(n_groups)]).astype(np.int32)), joined), ";")
    code = ids_a.to_numpy()[at_a].astype(np.int64) * pair.n_b + ids_b.to_numpy()[at_b]
    return {"n_a": np.asarray(pc.list_value_length(lists_a)), "n_b": np.asarray(pc.list_value_length(lists_b)),
            "n_groups": n_groups, "n_links": np.bincount(doc, minlength=len(found)), "groups": shown,
            "link_doc": doc, "link_pair": code}


def _packed(values: np.ndarray) -> bytes:
    """Unsigned integers of the least sufficient width."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{max(len(raw) // max(n, 1), 1)}").astype(np.int64)


class _Block:
    """Documents gathered for one row."""

    def __init__(self) -> None:
        self.docs: dict[str, list] = {c: [] for c in ("key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        self.links: list[pa.Table] = []
        self.size = self.n = 0

    def add(self, pair: Pair, keys: pa.Array, batch: list[str], size: int) -> None:
        got = pair(batch)
        at = [i for i, g in enumerate(got) if g is not None]
        counts = {c: np.zeros(len(batch), np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
        digests = [""] * len(batch)
        if at:
            found = align(pair, [got[i] for i in at])
            for c in counts:
                counts[c][at] = found[c]
            for i, shown in zip(at, found["groups"].to_pylist()):
                digests[i] = hashlib.sha256(shown.encode()).hexdigest()
            place = np.asarray(at, np.int64) + self.n
            # pairs a document, with how often each is linked
            self.links.append(pa.table({"doc": place[found["link_doc"]].astype(np.int32), "pair": found["link_pair"]})
                              .group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]))
        self.docs["key"].append(keys)
        self.docs["groups_sha256"].append(pa.array(digests, pa.string()))
        for c, v in counts.items():
            self.docs[c].append(pa.array(v))
        self.n += len(batch)
        self.size += size

    def row(self, block: int) -> pa.RecordBatch:
        docs = {c: pa.concat_arrays(v) for c, v in self.docs.items()}
        links = pa.concat_tables(self.links) if self.links else pa.table(
            {"doc": pa.array([], pa.int32()), "pair": pa.array([], pa.int64()), "count_all": pa.array([], pa.int64())})
        counted = links.group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
        pairs = counted["pair"].combine_chunks()
        slot = np.searchsorted(pairs.to_numpy(), links["pair"].to_numpy())
        doc = links["doc"].to_numpy()
        order = np.lexsort((slot, doc))
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), one(pa.StructArray.from_arrays(list(docs.values()), list(docs))),
             one(pairs), one(counted["count_all"].combine_chunks()),
             pa.array([_packed(np.bincount(doc, minlength=self.n))], pa.binary()),
             pa.array([_packed(slot[order])], pa.binary()),
             pa.array([_packed(links["count_all"].to_numpy()[order])], pa.binary())],
            ["block", "docs", "pairs", "held_by", "sizes", "slots", "times"])


def blocks(docs: DataFrame, path_a: str, path_b: str, *, key: str = "doc_id", text: str = "text",
           block_bytes: int = 16 << 20) -> DataFrame:
    """Encode and align all texts; one landed row a block."""
    kind = docs.schema[key].dataType.simpleString()
    rows = bounded_batches(docs).select(F.col(key).alias("key"), text_of(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held, done = _pair(path_a, path_b), _Block(), 0
        first = TaskContext.get().partitionId() << 32
        for batch in slices(batches, max_bytes=2 << 20):
            size = pc.sum(pc.binary_length(column(batch, "text"))).as_py()
            if held.n and held.size + size > block_bytes:
                yield held.row(first + done)
                held, done = _Block(), done + 1
            held.add(pair, column(batch, "key"), texts(batch), size)
        if held.n:
            yield held.row(first + done)
        give_back()

    doc = f"struct<key:{kind},n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>"
    return landed(rows.mapInArrow(run, f"block long, docs array<{doc}>, pairs array<bigint>, held_by array<bigint>, "
                                       "sizes binary, slots binary, times binary"), "alignment", "zstd")


def pair_counts(found: DataFrame, n_b: int) -> DataFrame:
    """pair, count (documents that hold it linked) and best (no pair of the same A id has more)."""
    part = found.select(F.explode(F.arrays_zip("pairs", "held_by")).alias("p")).select("p.pairs", "p.held_by")
    total = part.groupBy(F.col("pairs").alias("pair")).agg(F.sum("held_by").alias("count"))
    # an A id meets at most n_b others, so its group is bounded by the vocabulary
    top = F.max("count").over(Window.partitionBy(F.expr(f"pair div {int(n_b)}")))
    return total.select("pair", "count", (F.col("count") == top).alias("best"))


def measure(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Per document its counts and digest, with n_best and count_sum over its links."""
    kind = found.schema["docs"].dataType.elementType["key"].dataType.simpleString()
    asked = found.select("block", F.posexplode("pairs").alias("slot", "pair"))
    told = asked.join(counts, "pair").groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("slot", "count", "best"))).alias("told"))
    rows = found.select("block", "docs", "sizes", "slots", "times").join(told, "block", "left").select(
        "docs", "sizes", "slots", "times", F.col("told.count").alias("count"), F.col("told.best").alias("best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {c: column(batch, c)[i] for c in batch.schema.names}
                docs = one["docs"].values
                fields = dict(zip([f.name for f in docs.type], docs.flatten()))
                count, best = (np.asarray(one[c].values) if one[c].is_valid else np.empty(0, np.int64) for c in ("count", "best"))
                sizes = _unpacked(one["sizes"].as_py(), len(docs))
                slots = _unpacked(one["slots"].as_py(), n := int(sizes.sum()))
                times = _unpacked(one["times"].as_py(), n)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                sums = []
                for value in (best, count):
                    run_of = np.concatenate([[0], np.cumsum(value.astype(np.int64)[slots] * times)])
                    sums.append(pa.array(run_of[ends[1:]] - run_of[ends[:-1]], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [fields["key"], *[fields[c] for c in ("n_a", "n_b", "n_groups", "n_links")], *sums, fields["groups_sha256"]],
                    ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
        give_back()

    return rows.mapInArrow(run, f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                                "count_sum long, groups_sha256 string")


def alignments(docs: DataFrame, path_a: str, path_b: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Alignment of every text, one row a document; ``pair_counts`` over ``blocks`` gives the id pairs themselves."""
    found = blocks(docs, path_a, path_b, key=key, text=text)
    return measure(found, pair_counts(found, _pair(path_a, path_b).n_b))
