"""Document fingerprints from prefix polynomial hashes.

``Prefix`` keeps, for one text, the running sums of code point times power of a
base, modulo two primes.  Two lookups give the hash of any span, so spans of
equal content are recognised wherever they stand (``same_span``), and the
longest common extension of two positions is found by binary search
(``common_extension``).

A fingerprint samples the prefix array at the multiples of a power of two that
cuts the text into 17 to 32 blocks, and at its end; and at up to 32 cuts that the
content defines: ``length:step:samples:level:cuts`` with 62 bits a sample.  A cut is
where the hash of the next 16 code points ends in ``level`` zero bits, so cuts move
with the text, and those of a higher level are among those of a lower one.

``likeness`` is the larger of two shares.  For the first it finds the common beginning of two fingerprints by
binary search over the samples, then compares the blocks behind it by their
span hashes; the share is that of the longer text's characters in equal blocks.
Texts whose steps differ meet at the coarser one, whose multiples both have
sampled.  The second share is that of the characters in equal blocks between cuts,
wherever these stand, each block as often as both texts have it: inserted or deleted
text costs only the blocks it touches.

Defined cases: a null text is empty; two empty texts are alike (1.0), an empty
and another text are not (0.0).  Rows without an id come first; equal ids are
ordered by the hash of their texts, then by the texts.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usertrail.llm.common import bounded_batches, column, landed, mix64, partitions, slices, text_of, texts

PRIMES = np.asarray([[2147483647], [2147483629]], np.uint64)
BASES = (911382323, 972663749)
BLOCKS = 32
WINDOW, LEAST_LEVEL = 16, 4
_POWERS = {sign: np.ones((2, 1), np.uint64) for sign in (1, -1)}


def powers(n: int, sign: int = 1) -> np.ndarray:
    """Powers 0 to n - 1 of both bases (or of their inverses), extended by doubling."""
    while (known := _POWERS[sign]).shape[1] < n:
        have = known.shape[1]
        step = np.asarray([[pow(b, sign * have, int(p[0]))] for b, p in zip(BASES, PRIMES)], np.uint64)
        _POWERS[sign] = np.concatenate([known, known * step % PRIMES], axis=1)
    return _POWERS[sign][:, :n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


class Prefix:
    """Prefix hashes of a sequence of code points; ``values[:, i]`` covers the first i."""

    def __init__(self, codes: np.ndarray, kept: np.ndarray | None = None):
        """``kept``: prefix hashes that another text with the same beginning already has."""
        kept = np.zeros((2, 1), np.uint64) if kept is None else kept
        at = kept.shape[1] - 1
        terms = powers(at + len(codes))[:, at:] * (codes.astype(np.uint64) + np.uint64(1)) % PRIMES
        more = (kept[:, -1:] + np.cumsum(terms, axis=1, dtype=np.uint64)) % PRIMES
        self.values = np.concatenate([kept, more], axis=1)

    def __len__(self) -> int:
        return self.values.shape[1] - 1

    def span(self, start: int, end: int) -> np.ndarray:
        """The span's hash times the power of its start."""
        return (self.values[:, end] + PRIMES[:, 0] - self.values[:, start]) % PRIMES[:, 0]


def same_span(a: Prefix, i: int, b: Prefix, j: int, length: int) -> bool:
    """Whether ``length`` code points from i in a and from j in b are equal."""
    if min(i, j) < 0 or i + length > len(a) or j + length > len(b):
        return False
    p = powers(max(i, j) + 1)
    return bool((a.span(i, i + length) * p[:, j] % PRIMES[:, 0] == b.span(j, j + length) * p[:, i] % PRIMES[:, 0]).all())


def common_extension(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """How many code points from i in a and from j in b agree."""
    low, high = 0, min(len(a) - i, len(b) - j)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if same_span(a, i, b, j, mid) else (low, mid - 1)
    return low


def step_of(n: int) -> int:
    step = 1
    while n > BLOCKS * step:
        step *= 2
    return step


def cuts(prefix: Prefix) -> tuple[int, np.ndarray, np.ndarray]:
    """The least level with at most ``BLOCKS`` cuts, their places and their levels."""
    v, size = prefix.values[0], max(len(prefix) - WINDOW, 0)
    ahead = (v[WINDOW + 1:WINDOW + size] + PRIMES[0] - v[1:size]) % PRIMES[0] * powers(size, -1)[0, 1:] % PRIMES[0]
    mixed = mix64(ahead)
    at = np.flatnonzero((mixed & np.uint64(2**LEAST_LEVEL - 1)) == 0)
    low = mixed[at] | np.uint64(1 << 62)
    levels = np.log2((low & (~low + np.uint64(1))).astype(np.float64)).astype(np.uint8)
    level = LEAST_LEVEL
    while (levels >= level).sum() > BLOCKS:
        level += 1
    return level, at[levels >= level] + 1, levels[levels >= level]


def packed(prefix: Prefix) -> tuple[int, int, bytes, int, bytes]:
    """A fingerprint's parts: length, step, samples at the steps, level of the cuts, and the cuts."""
    n = len(prefix)
    step = step_of(n)
    level, places, levels = cuts(prefix)

    def samples(at: np.ndarray) -> bytes:
        return (prefix.values[0, at] << np.uint64(31) | prefix.values[1, at]).astype("<u8").tobytes()

    return (n, step, samples(np.append(np.arange(step, n + 1, step), n)), level,
            samples(places) + places.astype("<u4").tobytes() + levels.tobytes())


def fingerprint(prefix: Prefix) -> str:
    n, step, fixed, level, moving = packed(prefix)
    return f"{n:x}:{step:x}:{base64.b64encode(fixed).decode()}:{level:x}:{base64.b64encode(moving).decode()}"


def _spelled(n: Column, step: Column, fixed: Column, level: Column, moving: Column) -> Column:
    """``fingerprint`` of the parts."""
    n, step, level = (F.lower(F.hex(c)) for c in (n, step, level))
    fixed, moving = (F.translate(F.base64(c), "\r\n", "") for c in (fixed, moving))  # base64 may break lines
    return F.concat_ws(":", n, step, fixed, level, moving)


def _parsed(print_: str) -> tuple[int, int, np.ndarray, tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    n, step, samples, level, moving = print_.split(":")
    return _unpacked(int(n, 16), int(step, 16), base64.b64decode(samples), int(level, 16), base64.b64decode(moving))


def _unpacked(n: int, step: int, samples: bytes, level: int, moving: bytes) -> tuple:
    zero, k = np.zeros((2, 1), np.uint64), len(moving) // 13

    def both(raw: bytes) -> np.ndarray:
        raw = np.frombuffer(raw, "<u8")
        return np.stack([raw >> np.uint64(31), raw & np.uint64(2**31 - 1)])

    fixed = np.concatenate([zero, both(samples)], axis=1)
    own = level, both(moving[:8 * k]), np.frombuffer(moving[8 * k:12 * k], "<u4"), np.frombuffer(moving[12 * k:], "u1")
    return n, step, fixed, own


def _blocks(n: int, end: np.ndarray, own: tuple, level: int) -> Counter:
    """How many characters lie in each block, by hash and length, between cuts of that level."""
    _, samples, places, levels = own
    on = levels >= level
    at = np.concatenate([[0], places[on], [n]]).astype(np.int64)
    values = np.concatenate([np.zeros((2, 1), np.uint64), samples[:, on], end], axis=1)
    spans = (values[:, 1:] + PRIMES - values[:, :-1]) % PRIMES * powers(n + 1, -1)[:, at[:-1]] % PRIMES
    out: Counter = Counter()
    for x, y, size in zip(*spans.tolist(), np.diff(at).tolist()):
        out[x, y, size] += size
    return out


def likeness(one: str, other: str) -> float:
    """The share of the longer text, 0 to 1, that lies in equal blocks."""
    return _likeness(_parsed(one), _parsed(other))


def _likeness(one: tuple, other: tuple) -> float:
    (n, s, a, own), (m, t, b, others) = one, other
    if not n or not m:
        return float(n == m)
    level = max(own[0], others[0])
    moved = (_blocks(n, a[:, -1:], own, level) & _blocks(m, b[:, -1:], others, level)).total()
    step = max(s, t)
    blocks = min(n, m) // step
    x, y = a[:, :-1][:, ::step // s][:, :blocks + 1], b[:, :-1][:, ::step // t][:, :blocks + 1]
    low, high = 0, blocks
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if (x[:, mid] == y[:, mid]).all() else (low, mid - 1)
    spans = [(v[:, low + 1:] + PRIMES - v[:, low:-1]) % PRIMES for v in (x, y)]
    equal = step * (low + int((spans[0] == spans[1]).all(axis=0).sum()))
    if n == m and n % step:
        last = [(v[:, -1] + PRIMES[:, 0] - w[:, blocks]) % PRIMES[:, 0] for v, w in ((a, x), (b, y))]
        equal += n % step * bool((last[0] == last[1]).all())
    return max(equal, moved) / max(n, m)


# ------------------------------------------------------------------ documents and their edits

class _Doc:
    def __init__(self, doc_id, text: str):
        self.doc_id, self.text = doc_id, text
        self.prefix = Prefix(code_points(text))
        self.packed = packed(self.prefix)
        self.print = _unpacked(*self.packed)

    def row(self, following: "_Doc") -> tuple:
        """The result of this document, edited with the beginning of the following one."""
        n = len(self.prefix)
        cut = n // 4
        head = following.text[:cut]
        edited = packed(Prefix(code_points(head), self.prefix.values[:, :n - cut + 1]))
        sha = hashlib.sha256((self.text[:n - cut] + head).encode()).digest()
        # an edited text begins like its text, so their samples stand together for the writer to compress
        pair = self.packed, edited
        return (self.doc_id, sha, *([p[k] for p in pair] for k in (0, 1, 3)), *([len(p[k]) for p in pair] for k in (2, 4)),
                b"".join(p[2] for p in pair), b"".join(p[4] for p in pair),
                _likeness(self.print, _unpacked(*edited)), _likeness(self.print, following.print))


NAMES = ["doc_id", "edited_sha", "n", "step", "level", "n_fixed", "n_moving", "fixed", "moving", "near_edited", "near_next"]
_TYPES = [pa.binary(), *[pa.list_(pa.int64())] * 3, *[pa.list_(pa.int32())] * 2, pa.binary(), pa.binary(), pa.float64(), pa.float64()]
_SCHEMA = ("doc_id {}, edited_sha binary, n array<long>, step array<long>, level array<long>, n_fixed array<int>, "
           "n_moving array<int>, fixed binary, moving binary, near_edited double, near_next double")


def _arrays(rows: list[tuple], id_type: pa.DataType) -> list[pa.Array]:
    cols = list(zip(*rows)) or [[]] * len(NAMES)
    return [pa.array(c, t) for c, t in zip(cols, [id_type, *_TYPES])]


def _results(rows: DataFrame) -> DataFrame:
    """The packed results of ``_Doc.row`` spelled out."""
    def part(name: str, which: int) -> Column:
        first = F.get(f"n_{name}", F.lit(0))
        return F.substring(name, F.lit(1), first) if which == 0 else F.substring(name, first + 1, F.get(f"n_{name}", F.lit(1)))

    def print_(which: int) -> Column:
        n, step, level = (F.get(c, F.lit(which)) for c in ("n", "step", "level"))
        return _spelled(n, step, part("fixed", which), level, part("moving", which))

    return rows.select("doc_id", F.get("n", F.lit(0)).alias("n_chars"), F.lower(F.hex("edited_sha")).alias("edited_sha256"),
                       print_(0).alias("fingerprint"), print_(1).alias("edited_fingerprint"), "near_edited", "near_next")


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit with the next document's beginning.

    One shuffle puts the documents in order, a range of ids a task.  A task knows
    the follower of all its rows but the last; it hands out its first and last
    text, and these pairs (as many as there are tasks) meet in a join.
    """
    spark = docs.sparkSession
    id_type = docs.schema[key].dataType.simpleString()
    rows = bounded_batches(docs).select(F.col(key).alias("doc_id"), text_of(text).alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    rows = rows.repartitionByRange(partitions(spark), *order[:2]).sortWithinPartitions(*order)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, done, kind = TaskContext.get().partitionId(), None, [], None

        def out(rows: list[tuple], side: str | None = None, text: str | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*_arrays(rows, kind), pa.array([part] * len(rows), pa.int64()), pa.array([side] * len(rows), pa.string()),
                 pa.array([text] * len(rows), pa.string())], [*NAMES, "part", "side", "whole"])

        def edge(doc: _Doc, side: str) -> pa.RecordBatch:
            return out([(doc.doc_id, *[None] * len(_TYPES))], side, doc.text)

        for batch in slices(batches):
            kind = column(batch, "doc_id").type
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), texts(batch)):
                doc = _Doc(doc_id, text)
                if held is None:
                    yield edge(doc, "first")
                else:
                    done.append(held.row(doc))
                held = doc
            if len(done) >= 2000:
                yield out(done)
                done = []
        if held is not None:
            yield out(done)
            yield edge(held, "last")

    schema = _SCHEMA.format(id_type) + ", part long, side string, whole string"
    found = landed(rows.mapInArrow(follow, schema), "fingerprints", "zstd")

    first, last = (found.where(F.col("side") == s).select("part", "doc_id", "whole") for s in ("first", "last"))
    ranks = first.select("part", F.row_number().over(Window.orderBy("part")).alias("rank"), F.count(F.lit(1)).over(
        Window.partitionBy()).alias("n"))  # narrow, one row a task
    after = first.join(ranks, "part").select((F.col("rank") % F.col("n")).alias("slot"), F.col("doc_id").alias("next_id"),
                                             F.col("whole").alias("next_whole"))
    # the follower of rank r has rank r + 1, and the first follows the last
    pairs = (last.join(ranks, "part").withColumn("slot", (F.col("rank") + 1) % F.col("n")).join(after, "slot")
             .select("doc_id", F.col("whole").alias("text"), "next_id", "next_whole"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kind = column(batch, "doc_id").type
            cols = (column(batch, c).to_pylist() for c in ("doc_id", "text", "next_id", "next_whole"))
            yield pa.RecordBatch.from_arrays(_arrays([_Doc(i, t).row(_Doc(j, u)) for i, t, j, u in zip(*cols)], kind), NAMES)

    return _results(found.where("side is null").select(*NAMES).unionByName(pairs.mapInArrow(close, _SCHEMA.format(id_type))))
