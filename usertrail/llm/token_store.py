"""Token ids in raw binary shards, with a minimal perfect hash index over the document keys.

``write_store`` sorts the documents by key into ranges, encodes each text and
writes one file a range: ``shards/000000.bin`` holds the ids as little-endian
unsigned integers, and nothing else: of 16 bits where the vocabulary has no
higher id, else of 32 (``id_bytes`` of the entries).  ``build_index`` maps each key to
(shard, offset, length): keys fall into buckets by hash, and every bucket file
``index/000000.bin`` holds a minimal perfect hash function of its keys (bit
arrays level by level, each key in the first level where it is alone; Limasset
et al., 2017), a 32-bit fingerprint a key and the payload's place.  A key costs
one read of a bucket, one probe a level and one ranged read, whatever the corpus
holds; a stranger is told by its fingerprint (one in 2**32 passes).

Defined cases: a null text is empty, so its document holds the end id alone; a
null key is a key like others; a repeated key has one entry a copy, numbered
from 0 in the order of the texts' hashes.  An empty table writes no shard.
Columns other than key and text are ignored.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usertrail.llm.common import SharedFiles, bounded_batches, column, mix64, partitions, slices, text_of, texts

BUCKET_KEYS = 20_000
LEVELS_AT_MOST = 64
FILE = "{:06d}.bin"
#: Unicode white space, as the pre-tokenizer's pattern means it.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


class Encoder:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library, as packed integers.

    The pre-tokenizer never joins text over the units cut here (white space goes
    by itself, one blank goes with what follows), so a unit's ids do not depend
    on its neighbours and are remembered, up to ``most`` of them.  Words that are
    not yet known go to the library together, as one text of words behind blanks:
    only the first id of a word can start with the blank, which tells them apart.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.lib, self.most = Tokenizer.from_file(path), most
        self.units, self.words = {"": b""}, {}  # ids of a unit as it stands, and of a word behind a blank
        self.before: dict[str, bytes] = {}  # words before those of late; used ones come over
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        vocabulary = self.lib.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values(), default=0) < 1 << 16 else "<u4")
        self.starts = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, number in vocabulary.items():
            self.starts[number] = token.startswith("\u0120")
        self.cut = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
        self.odd = ["  ", " \n", "\n ", "\n\n", *(c for c in _SPACE if c not in " \n")]

    def _encode_units(self, units: list[str]) -> None:
        if units:
            got = self.lib.encode(units, is_pretokenized=True, add_special_tokens=False)
            raw = np.asarray(got.ids, self.dtype).tobytes()
            ends = np.searchsorted(np.asarray(got.word_ids), np.arange(len(units) + 1)) * self.dtype.itemsize
            for u, a, b in zip(units, ends[:-1].tolist(), ends[1:].tolist()):
                self.units[u] = raw[a:b]

    def _encode_words(self, words: list[str]) -> None:
        """Words without white space, each behind one blank; 1000 to a text."""
        parts = [words[k:k + 1000] for k in range(0, len(words), 1000)]
        for part, got in zip(parts, self.lib.encode_batch_fast([" " + " ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.asarray(got.ids, self.dtype)
            at = np.append(np.flatnonzero(self.starts[ids]), len(ids))
            if len(at) != len(part) + 1:
                raise ValueError("the tokenizer's ids do not show where words start")
            raw, at = ids.tobytes(), (at * self.dtype.itemsize).tolist()
            for w, a, b in zip(part, at[:-1], at[1:]):
                self.words[w] = raw[a:b]

    def _learn(self, new: set[str]) -> None:
        """Ids of new words: behind a blank, or behind the line end that they show."""
        old = {w: x for w in new if (x := self.before.get(w)) is not None}
        self.words.update(old)
        new = {w for w in new if w not in old}
        self._encode_words([w for w in new if w[0] != "\n"])
        heads = [w for w in new if w[0] == "\n"]
        self._encode_units([u for u in {w[1:] for w in heads} | {"\n"} if u not in self.units])
        for w in heads:
            self.words[w] = self.units["\n"] + self.units[w[1:]]

    def _unit_by_unit(self, text: str) -> bytes:
        found = self.cut.findall(text)
        self._encode_units([u for u in set(found) if u not in self.units])
        return b"".join(map(self.units.__getitem__, found))

    def __call__(self, batch: list[str]) -> list[bytes]:
        if len(self.units) > self.most:
            self.units = {"": b""}
        if len(self.words) > self.most:
            self.words, self.before = {}, self.words
        out, get, held, new = [b""] * len(batch), self.words.get, [], set()
        for i, t in enumerate(batch):
            if any(s in t for s in self.special):
                out[i] = np.asarray(self.lib.encode(t, add_special_tokens=False).ids, self.dtype).tobytes()
            elif t[-1:] == " " or any(s in t for s in self.odd):
                out[i] = self._unit_by_unit(t)
            elif t:
                # single blanks and line ends alone part the words; the first stands behind a line end of its own
                found = f"\n{t}".replace("\n", " \n").split(" ")[1:]
                ids = list(map(get, found))
                gaps = [k for k, x in enumerate(ids) if x is None]
                missing = [found[k] for k in gaps]
                new.update(missing)
                held.append((i, ids, gaps, missing))
        if new:
            self._learn(new)
        if held:
            self._encode_units(["\n"] if "\n" not in self.units else [])
            line_end = len(self.units["\n"])
        for i, ids, gaps, missing in held:
            for k, w in zip(gaps, missing):
                ids[k] = self.words[w]
            out[i] = b"".join(ids)[line_end:]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a Python worker, so that later tasks find the words known."""
    return Encoder(path)


def write_store(docs: DataFrame, path: str, tokenizer: str, *, key: str = "doc_id", text: str = "text",
                end_id: int = 2) -> DataFrame:
    """Write the shards; return the entries (shard, place, key, copy, offset, n_tokens), read back."""
    spark = docs.sparkSession
    key_type = docs.schema[key].dataType
    rows = bounded_batches(docs).select(F.col(key).alias("key"), text_of(text).alias("text"))
    order = ["key", F.xxhash64("text"), "text"]
    # one range of keys a shard; ties are settled, so a task that runs again writes the same bytes
    rows = rows.repartitionByRange(partitions(spark), *order[:2]).sortWithinPartitions(*order)
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx, files, encode_batch = TaskContext.get(), SharedFiles(f"{path}/shards"), encoder(tokenizer)
        shard, kept, width = ctx.partitionId(), {"keys": [], "sizes": []}, encode_batch.dtype.itemsize
        end = np.asarray([end_id], encode_batch.dtype).tobytes()

        def payload() -> Iterator[bytes]:
            for batch in slices(batches):
                ids = encode_batch(texts(batch))
                kept["keys"].append(column(batch, "key"))
                kept["sizes"] += [len(x) // width + 1 for x in ids]
                yield end.join([*ids, b""])

        chunks = payload()
        first = next(chunks, None)
        if first is None:
            return
        files.write(FILE.format(shard), (c for part in ((first,), chunks) for c in part),
                    str(ctx.taskAttemptId()))
        keys, sizes = pa.chunked_array(kept["keys"]).combine_chunks(), np.asarray(kept["sizes"], np.int64)
        values, copy, last = keys.to_pylist(), np.zeros(len(sizes), np.int64), object()
        for i, value in enumerate(values):
            copy[i] = copy[i - 1] + 1 if i and value == last else 0
            last = value
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(sizes), shard, np.int64)), pa.array(np.arange(len(sizes))), keys,
             pa.array(copy), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes),
             pa.array(np.full(len(sizes), width, np.int32))],
            ["shard", "place", "key", "copy", "offset", "n_tokens", "id_bytes"])

    schema = f"shard long, place long, key {key_type.simpleString()}, copy long, offset long, n_tokens long, id_bytes int"
    rows.mapInArrow(encode, schema).write.parquet(f"{path}/entries")
    return entries(spark, path, schema)


def entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries, copies of one key numbered on over the shards they span.

    Only the first key of a shard can go on from the shard before, so what is
    broadcast here has at most two rows a shard.
    """
    raw = spark.read.schema(schema).parquet(f"{path}/entries")
    spanning = raw.where("place = 0").select(F.col("key").alias("k")).distinct()
    counts = (raw.join(F.broadcast(spanning), raw["key"].eqNullSafe(F.col("k")), "left_semi")
              .groupBy("key", "shard").agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("key").alias("k"), F.col("shard").alias("s"),
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).where("base > 0")
    joined = raw.join(F.broadcast(base), raw["key"].eqNullSafe(F.col("k")) & (raw["shard"] == F.col("s")), "left")
    return joined.select("shard", "place", "key", (F.col("copy") + F.coalesce("base", F.lit(0))).alias("copy"),
                         "offset", "n_tokens", "id_bytes")


# ------------------------------------------------------------------ minimal perfect hash

def _slot(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(h1 + np.uint64(level) * h2) % np.uint64(size)).astype(np.int64)


def build_mph(h1: np.ndarray, h2: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays a level, and each key's rank: the ranks are 0 to n - 1, once each."""
    h2 = h2 | np.uint64(1)
    left, levels, rank, before = np.arange(len(h1)), [], np.zeros(len(h1), np.int64), 0
    while len(left):
        if len(levels) == LEVELS_AT_MOST:
            raise ValueError("two keys of one bucket share a 128-bit hash")
        size = max(64, int(1.6 * len(left)))
        slot = _slot(h1[left], h2[left], len(levels), size)
        alone = np.bincount(slot, minlength=size) == 1
        placed = alone[slot]
        ranks = np.cumsum(alone) - 1 + before
        rank[left[placed]] = ranks[slot[placed]]
        levels.append(alone)
        before, left = before + int(alone.sum()), left[~placed]
    return levels, rank


def find_mph(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The rank of every known key; of a stranger, -1 or the rank of some key."""
    h2 = h2 | np.uint64(1)
    out, left, before = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
    for k, alone in enumerate(levels):
        if not len(left):
            break
        slot = _slot(h1[left], h2[left], k, len(alone))
        hit = alone[slot]
        out[left[hit]] = (np.cumsum(alone) - 1 + before)[slot[hit]]
        before, left = before + int(alone.sum()), left[~hit]
    return out


_PLACE = np.dtype([("fingerprint", "<u4"), ("shard", "<i4"), ("offset", "<i8"), ("n_tokens", "<i8"),
                   ("id_bytes", "<i4")])
_PLACE_NAMES = ["shard", "offset", "n_tokens", "id_bytes"]


def _bucket_file(levels: list[np.ndarray], places: np.ndarray) -> bytes:
    out = io.BytesIO()
    out.write(struct.pack("<4sII", b"UTM1", len(levels), len(places)))
    out.write(np.asarray([len(x) for x in levels], "<u4").tobytes())
    for x in levels:
        out.write(np.packbits(x, bitorder="little").tobytes())
    out.write(places.tobytes())
    return out.getvalue()


def _read_bucket(files: SharedFiles, bucket: int) -> tuple[list[np.ndarray], np.ndarray]:
    with files.open(FILE.format(bucket)) as f:
        raw = f.read()
    _, n_levels, n = struct.unpack_from("<4sII", raw)
    at = 12 + 4 * n_levels
    levels = []
    for size in np.frombuffer(raw, "<u4", n_levels, 12).tolist():
        packed = np.frombuffer(raw, np.uint8, -(-size // 8), at)
        levels.append(np.unpackbits(packed, count=size, bitorder="little").astype(bool))
        at += -(-size // 8)
    return levels, np.frombuffer(raw, _PLACE, n, at)


def _hashes(*cols: str) -> list:
    parts = [F.col(c) for c in cols] + [F.isnull(c) for c in cols]
    return [F.xxhash64(F.lit(7), *parts).alias("h1"), F.xxhash64(F.lit(11), *parts).alias("h2")]


def _u64(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(column(batch, name)).view(np.uint64)


def _fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (mix64(h1 ^ (h2 << np.uint64(1))) >> np.uint64(32)).astype("<u4")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows sorted by bucket, one bucket at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        b = np.asarray(column(batch, "bucket"))
        edges = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if lo == hi:
                continue
            part = batch.slice(lo, hi - lo)
            if held and column(held[0], "bucket")[0] != column(part, "bucket")[0]:
                yield column(held[0], "bucket")[0].as_py(), pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(part)
    if held:
        yield column(held[0], "bucket")[0].as_py(), pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def build_index(found: DataFrame, path: str) -> int:
    """Write the index over (key, copy) of all entries; return its number of buckets."""
    n_buckets = max(1, -(-found.count() // BUCKET_KEYS))
    spark = found.sparkSession
    keyed = found.select(*_hashes("key", "copy"), *_PLACE_NAMES).withColumn(
        "bucket", F.expr(f"pmod(h1, {n_buckets})"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, done = SharedFiles(f"{path}/index"), []
        for bucket, rows in _by_bucket(batches):
            h1, h2 = _u64(rows, "h1"), _u64(rows, "h2")
            levels, rank = build_mph(h1, h2)
            places = np.zeros(len(rank), _PLACE)
            places["fingerprint"][rank] = _fingerprint(h1, h2)
            for name in _PLACE_NAMES:
                places[name][rank] = np.asarray(column(rows, name))
            files.write(FILE.format(bucket), [_bucket_file(levels, places)], str(TaskContext.get().taskAttemptId()))
            done.append(len(rank))
        yield pa.RecordBatch.from_arrays([pa.array([sum(done)], pa.int64())], ["n"])

    (keyed.repartition(min(n_buckets, partitions(spark)), "bucket").sortWithinPartitions("bucket", "h1", "h2")
     .mapInArrow(build, "n long").write.parquet(f"{path}/index-counts"))
    return n_buckets


def lookup(keys: DataFrame, path: str, n_buckets: int) -> DataFrame:
    """(key, copy) -> shard, offset, n_tokens through the index; nulls for a stranger."""
    spark = keys.sparkSession
    key_type = keys.schema["key"].dataType.simpleString()
    rows = keys.select("key", F.col("copy").cast("long").alias("copy")).select("key", "copy", *_hashes("key", "copy"))
    rows = rows.withColumn("bucket", F.expr(f"pmod(h1, {n_buckets})"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held = SharedFiles(f"{path}/index"), (None, None, None)
        for batch in batches:
            b = np.asarray(column(batch, "bucket"))
            edges = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if held[0] != b[lo]:
                    held = (b[lo], *_read_bucket(files, int(b[lo])))
                h1, h2 = _u64(part, "h1"), _u64(part, "h2")
                rank = find_mph(held[1], h1, h2)
                place = held[2][np.maximum(rank, 0)] if len(held[2]) else np.zeros(len(rank), _PLACE)
                miss = (rank < 0) | (place["fingerprint"] != _fingerprint(h1, h2))
                yield pa.RecordBatch.from_arrays(
                    [column(part, "key"), column(part, "copy"),
                     *(pa.array(place[c].astype(np.int64), mask=miss) for c in _PLACE_NAMES)],
                    ["key", "copy", *_PLACE_NAMES])

    return (rows.repartition(min(n_buckets, partitions(spark)), "bucket").sortWithinPartitions("bucket")
            .mapInArrow(probe, f"key {key_type}, copy long, shard long, offset long, n_tokens long, id_bytes long"))


def read_payloads(places: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """Read each found place from its shard: its ids, their number and their crc32 as 32-bit integers."""
    key_type = places.schema["key"].dataType.simpleString()
    names = ["key", "copy", "shard", "offset", "n_tokens", "ids_crc32"] + ["ids"] * ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held = SharedFiles(f"{path}/shards"), (None, None)
        for batch in batches:
            out, crcs, sizes = [], [], []
            for shard, offset, n, width in zip(*(column(batch, c).to_pylist() for c in _PLACE_NAMES)):
                if held[0] != shard:
                    if held[1]:
                        held[1].close()
                    held = (shard, files.open(FILE.format(shard)))
                got = np.frombuffer(held[1].read_at(width * n, width * offset), f"<u{width}").astype("<u4")
                crcs.append(zlib.crc32(got))
                sizes.append(len(got))
                if ids:
                    out.append(got.astype(np.int64))
            arrays = [*(column(batch, c) for c in ("key", "copy", "shard", "offset")),
                      pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(out, pa.list_(pa.int64()))] * ids, names)

    schema = f"key {key_type}, copy long, shard long, offset long, n_tokens long, ids_crc32 long" + \
        ", ids array<long>" * ids
    return (places.where(F.col("shard").isNotNull()).repartition(partitions(places.sparkSession), "shard")
            .sortWithinPartitions("shard", "offset").mapInArrow(read, schema))


def shard_starts(found: DataFrame) -> DataFrame:
    """The number of ids before each shard: one row a shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return found.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select(
        F.col("shard").alias("in_shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


class TokenStore:
    """Keyed access from one process, for a loader: ``TokenStore(path, n).get(h1, h2)``."""

    def __init__(self, path: str, n_buckets: int):
        self.index, self.shards, self.n = SharedFiles(f"{path}/index"), SharedFiles(f"{path}/shards"), n_buckets

    def get(self, h1: int, h2: int) -> np.ndarray | None:
        """Ids of the key whose two 64-bit hashes (``key_hashes``) are given, or None."""
        levels, places = _read_bucket(self.index, h1 % self.n)
        a, b = (np.asarray([h & (2**64 - 1)], np.uint64) for h in (h1, h2))
        rank = int(find_mph(levels, a, b)[0])
        if rank < 0 or places[rank]["fingerprint"] != _fingerprint(a, b)[0]:
            return None
        at = places[rank]
        with self.shards.open(FILE.format(int(at["shard"]))) as f:
            width = int(at["id_bytes"])
            return np.frombuffer(f.read_at(width * int(at["n_tokens"]), width * int(at["offset"])), f"<u{width}")


def key_hashes(keys: DataFrame) -> DataFrame:
    """key, copy and the two hashes that ``TokenStore.get`` takes."""
    rows = keys.select("key", F.col("copy").cast("long").alias("copy"))
    return rows.select("key", "copy", *_hashes("key", "copy"))
