"""Benchmark decontamination over a positional inverted index of the corpus.

``build_index`` cuts the documents into blocks of a few megabytes and stores, per
block, the sorted terms and for each the sorted list of its positions
(delta-coded); a gap between documents keeps matches inside one.  ``find`` looks
up test phrases block by block: a phrase's lists are taken from the rarest term
in the block on, each shifted by the term's offset, and intersected; what is left
are its exact occurrences.  ``proximity`` intersects with a tolerance instead.

Test phrases are written in chunks of bounded size to the shared folder and read
by the tasks one at a time, so a test set of any size needs no broadcast and no
shuffle of the index; every block meets every chunk (a stated query set in blocks).

Defined cases: a null or wordless text has no words and no hits; an item without
words has no window; an item of fewer words than a window is one window of its
own; items of equal id are one item, and a null item id counts as an empty string;
repeated documents are reported row by row.
"""

from __future__ import annotations

import hashlib
import io
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usertrail.llm.common import SharedFiles, ascii_lower, bounded_batches, column, give_back, landed, partitions, scratch, slices, text_of, texts
from usertrail.llm.common import words as words_of

#: Positions left free between documents: more than any phrase or proximity window is long.
GAP = 1 << 12
BLOCK_BYTES, CHUNK_BYTES = 2 << 20, 4 << 20
CHUNK = "{:06d}.npz"


def _block_row(keys: pa.Array, whole: list[str]) -> pa.RecordBatch:
    """The index row of these documents (a function of its own, so that its words are freed before the next)."""
    found = [words_of(t) for t in whole]
    sizes = np.asarray([len(f) for f in found], np.int64)
    starts = np.cumsum(sizes + GAP) - sizes - GAP
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    coded = pa.array([w for f in found for w in f], pa.string()).dictionary_encode()
    del found
    order = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[np.asarray(order)] = np.arange(len(order))
    ids = rank[np.asarray(coded.indices)] if len(at) else np.empty(0, np.int64)
    lists = at[np.argsort(ids, kind="stable")]
    counts = np.bincount(ids, minlength=len(order))
    ends = np.cumsum(counts)
    deltas = np.diff(lists, prepend=0)
    deltas[ends - counts] = lists[ends - counts]
    return pa.RecordBatch.from_arrays(
        [pa.array([keys.to_pylist()], pa.list_(keys.type)), pa.array([sizes.astype("<i8").tobytes()], pa.binary()),
         pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), coded.dictionary.take(order)),
         pa.array([ends.astype("<i8").tobytes()], pa.binary()), pa.array([deltas.astype("<u4").tobytes()], pa.binary())],
        ["keys", "sizes", "terms", "ends", "postings"])


def build_index(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per block: terms, the ends of their posting lists, the lists, and the block's documents."""
    rows = bounded_batches(docs).select(F.col(key).alias("key"), text_of(text).alias("text"))
    key_type = docs.schema[key].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=BLOCK_BYTES):
            yield _block_row(column(batch, "key"), texts(batch))
        give_back()

    return landed(rows.mapInArrow(
        index, f"keys array<{key_type}>, sizes binary, terms array<string>, ends binary, postings binary"), "postings")


class Block:
    """One block's posting lists; a term is named by its number in the block."""

    def __init__(self, terms: pa.Array, sizes: bytes, ends: bytes, postings: bytes):
        self.terms, self.sizes = terms, np.frombuffer(sizes, "<i8")
        self.starts = np.cumsum(self.sizes + GAP) - self.sizes - GAP
        self.ends = np.frombuffer(ends, "<i8")
        self.heads = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if len(self.ends) else self.ends
        total = np.cumsum(np.frombuffer(postings, "<u4").astype(np.int64))
        before = np.where(self.heads > 0, total[np.maximum(self.heads - 1, 0)], 0) if len(total) else total
        self.positions = total - np.repeat(before, self.ends - self.heads)
        self.span = int(self.starts[-1] + self.sizes[-1] + 2 * GAP) if len(self.sizes) else 2 * GAP
        # a (term, position) pair as one number; sorted, as terms and lists are
        self.pairs = np.repeat(np.arange(len(self.ends), dtype=np.int64), self.ends - self.heads) * self.span + self.positions

    def numbers(self, terms: pa.Array) -> np.ndarray:
        """Numbers of the given terms, -1 where the block has none."""
        return np.asarray(pc.fill_null(pc.index_in(terms, value_set=self.terms), -1)).astype(np.int64)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        pair = term * self.span + position
        at = np.minimum(np.searchsorted(self.pairs, pair), max(len(self.pairs) - 1, 0))
        return self.pairs[at] == pair if len(self.pairs) else np.zeros(len(pair), bool)

    def phrases(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase's row, start) of all occurrences; phrases are rows of term numbers, -2 behind their ends."""
        lengths = (phrases != -2).sum(axis=1)
        live = np.flatnonzero((phrases != -1).all(axis=1) & (lengths > 0))
        if not len(live):
            return live, live
        rows = phrases[live]
        counts = np.where(rows >= 0, (self.ends - self.heads)[np.maximum(rows, 0)], np.iinfo(np.int64).max)
        order = np.argsort(counts, axis=1, kind="stable")  # the rarest first
        rarest = rows[np.arange(len(rows)), order[:, 0]]
        n = (self.ends - self.heads)[rarest]
        of = np.repeat(np.arange(len(rows)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = self.positions[self.heads[rarest][of] + within] - order[of, 0]
        keep = start >= 0
        of, start = of[keep], start[keep]
        for level in range(1, rows.shape[1]):
            column_ = order[of, level]
            term = rows[of, column_]
            keep = (term < 0) | self.has(np.maximum(term, 0), start + column_)
            of, start = of[keep], start[keep]
        return live[of], start

    def near(self, terms: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest of the terms that have all others within ``slop`` words."""
        if not len(terms) or (terms < 0).any():
            return np.empty(0, np.int64)
        order = terms[np.argsort((self.ends - self.heads)[terms], kind="stable")]
        lists = [self.positions[self.heads[t]:self.ends[t]] for t in order]
        at = lists[0]
        for other in lists[1:]:
            k = np.searchsorted(other, at - slop)
            at = at[(k < len(other)) & (other[np.minimum(k, len(other) - 1)] <= at + slop)]
        return at

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, side="right") - 1


def windows(found: list[str], size: int) -> list[list[str]]:
    return [found[i:i + size] for i in range(max(len(found) - size, 0) + 1)] if found else []


def write_phrases(items: DataFrame, *, key: str = "item_id", text: str = "text", size: int = 10) -> tuple[str, int]:
    """Write all windows of all items in chunks; return the folder and the number of chunks."""
    if size >= GAP:
        raise ValueError(f"windows must be shorter than {GAP} words")
    spark, path = items.sparkSession, scratch(items.sparkSession, "phrases")
    rows = bounded_batches(items).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), text_of(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // CHUNK_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, chunks = SharedFiles(path), defaultdict(lambda: (dict(), [], []))
        for batch in batches:
            for chunk, item, t in zip(column(batch, "chunk").to_pylist(), column(batch, "item").to_pylist(), texts(batch)):
                numbers, phrases, owners = chunks[chunk]
                for window in windows(words_of(t), size):
                    row = [numbers.setdefault(w, len(numbers)) for w in window]
                    phrases.append(row + [-2] * (size - len(row)))
                    owners.append(item)
        for chunk, (numbers, phrases, owners) in chunks.items():
            out, terms = io.BytesIO(), pa.array(numbers, pa.string())
            raw = pa.BufferOutputStream()
            with pa.ipc.new_stream(raw, pa.schema([("terms", pa.string())])) as w:
                w.write_batch(pa.RecordBatch.from_arrays([terms], ["terms"]))
            owner = pa.array(owners, pa.string())
            raw2 = pa.BufferOutputStream()
            with pa.ipc.new_stream(raw2, pa.schema([("items", pa.string())])) as w:
                w.write_batch(pa.RecordBatch.from_arrays([owner], ["items"]))
            np.savez(out, phrases=np.asarray(phrases, np.int32).reshape(-1, size),
                     terms=np.frombuffer(raw.getvalue(), np.uint8), items=np.frombuffer(raw2.getvalue(), np.uint8))
            files.write(CHUNK.format(chunk), [out.getvalue()], str(TaskContext.get().taskAttemptId()))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(chunks), pa.int64())], ["chunk"])

    chunked = rows.withColumn("chunk", F.expr(f"pmod(xxhash64(item), {n})"))
    done = chunked.repartition(min(n, partitions(spark)), "chunk").mapInArrow(write, "chunk long")
    have = [r["chunk"] for r in done.collect()]  # a number a chunk
    return path, sorted(have)


def _chunks(path: str, numbers: list[int]) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array]]:
    files = SharedFiles(path)
    for k in numbers:
        with files.open(CHUNK.format(k)) as f:
            got = np.load(io.BytesIO(f.read()))
            yield (pa.ipc.open_stream(got["terms"].tobytes()).read_all().column(0).combine_chunks(), got["phrases"],
                   pa.ipc.open_stream(got["items"].tobytes()).read_all().column(0).combine_chunks())


def find(index: DataFrame, items: DataFrame, *, item_key: str = "item_id", item_text: str = "text",
         size: int = 10) -> DataFrame:
    """A row per document: words, words hit by any window, and the items whose windows occur."""
    path, chunks = write_phrases(items, key=item_key, text=item_text, size=size)
    key_type = index.schema["keys"].dataType.elementType.simpleString()

    def hits(keys: pa.Array, block: Block, chunks_: Iterable) -> pa.RecordBatch:
        marks, found = np.zeros(block.span + 1, np.int32), [set() for _ in range(len(keys))]
        for terms, phrases, owners in chunks_:
            numbers = np.append(block.numbers(terms), -2)  # the last stands for no term
            of, start = block.phrases(numbers[np.where(phrases < 0, len(numbers) - 1, phrases)])
            if not len(of):
                continue
            np.add.at(marks, start, 1)
            np.add.at(marks, start + (phrases[of] >= 0).sum(axis=1), -1)
            for doc, item in set(zip(block.document(start).tolist(), owners.take(pa.array(of)).to_pylist())):
                found[doc].add(item)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(marks) > 0)])
        hit = covered[block.starts + block.sizes] - covered[block.starts]
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(block.sizes), pa.array(hit.astype(np.int64)),
             pa.array([sorted(s) for s in found], pa.list_(pa.string()))], ["key", "n_words", "n_hit", "items"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = list(_chunks(path, chunks)) if len(chunks) == 1 else None
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(column(batch, "terms")[i].values,
                              *(column(batch, c)[i].as_py() for c in ("sizes", "ends", "postings")))
                yield hits(column(batch, "keys")[i].values, block, only or _chunks(path, chunks))

    return index.mapInArrow(match, f"key {key_type}, n_words long, n_hit long, items array<string>")


def proximity(index: DataFrame, terms: list[str], slop: int) -> DataFrame:
    """key and position (in words) of the rarest term wherever all terms lie within ``slop`` words of it."""
    if slop >= GAP:
        raise ValueError(f"slop must be under {GAP} words")
    asked = pa.array([ascii_lower(t) for t in terms], pa.string())
    key_type = index.schema["keys"].dataType.elementType.simpleString()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(column(batch, "terms")[i].values,
                              *(column(batch, c)[i].as_py() for c in ("sizes", "ends", "postings")))
                at = block.near(block.numbers(asked), slop)
                doc = block.document(at)
                yield pa.RecordBatch.from_arrays([column(batch, "keys")[i].values.take(pa.array(doc)),
                                                  pa.array(at - block.starts[doc])], ["key", "position"])

    return index.mapInArrow(match, f"key {key_type}, position long")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``find``'s rows."""
    return found.select(
        F.col("key").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def item_digest(items: list[str]) -> str:
    """What ``digest`` gives for these items, for checks by hand."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
