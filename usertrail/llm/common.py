"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usertrail.config import ensure_checkpoint_dir

#: A word: digits, letters and everything beyond ASCII, in any run.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(df: DataFrame) -> DataFrame:
    """Texts may be long: unless the session sets another number than Spark's default of
    10000, hand Python 500 rows at a time."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, "500")
    return df


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/usertrail-llm/{name}-{uuid.uuid4().hex}"


def landed(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back: the lineage ends here."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _marked(df: DataFrame, key: Column, among: DataFrame, among_key: Column, slots: int) -> DataFrame:
    """``df`` with a column ``_maybe``: true wherever the long ``key`` is among the other's, and seldom elsewhere.

    The keys set bits of a map of ``slots`` 64-bit words; the map is broadcast, at most a few
    megabytes whatever the number of keys.
    """
    def slot(k: Column) -> Column:
        return F.pmod(k, F.lit(slots)).cast("int")

    def mask(k: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(k, 40).bitwiseAND(F.lit(63)).cast("int"))

    bits = among.select(slot(among_key).alias("_slot"), mask(among_key).alias("_bits")).groupBy("_slot").agg(
        F.bit_or("_bits").alias("_bits"))
    return (df.withColumn("_slot", slot(key)).withColumn("_mask", mask(key)).join(F.broadcast(bits), "_slot", "left")
            .withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) != 0, F.lit(False)))
            .drop("_slot", "_mask", "_bits"))


def narrowed(df: DataFrame, key: Column, among: DataFrame, among_key: Column, slots: int = 1 << 16) -> DataFrame:
    """The rows whose ``key`` may be among the other's: all that are, and some that are not."""
    return _marked(df, key, among, among_key, slots).where("_maybe").drop("_maybe")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: str) -> str:
    """A-Z lowered, everything else as it is."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def words(text: str) -> list[str]:
    return _WORDS.findall(ascii_lower(text))


# byte by byte: A-Z lowered, all ASCII outside words a space, the bytes of other characters as they are
_WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def word_bytes(raw: bytes) -> list[bytes]:
    """``words`` of a text in UTF-8, in UTF-8."""
    return raw.translate(_WORD_BYTES).split()


def slices(batches: Iterable[pa.RecordBatch], column: str = "text",
           max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``max_bytes`` of text, or of one row."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        start, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and total + size > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)


def give_back() -> None:
    """Return freed memory to the machine: a worker that waits for its next task should be small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in column(batch, name).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Hashed(dict):
    def __missing__(self, word: str | bytes) -> int:
        from xxhash import xxh64_intdigest

        self[word] = found = xxh64_intdigest(word)
        return found


class WordHashes:
    """64-bit hashes of words, or of their UTF-8, remembered up to ``most`` words and then forgotten at once."""

    def __init__(self, most: int = 500_000):
        self.most, self.known = most, _Hashed()

    def __call__(self, found: list[str] | list[bytes]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found))


def shingle_hashes(word_hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of ``size`` words; fewer words, but not none, are one run."""
    n = len(word_hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(size, n)
    out = np.full(n - width + 1, 0x9E3779B97F4A7C15 + width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + word_hashes[k:n - width + 1 + k]
        out ^= out >> np.uint64(32)
    return mix64(out)


class SharedFiles:
    """Files of a shared folder, from the driver or a task: ``path`` is a URI or a plain path."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") \
            else (fs.LocalFileSystem(), path)

    def write(self, name: str, chunks: Iterable[bytes], attempt: str) -> None:
        """All or nothing: written under a name of the attempt's own, then renamed."""
        self.fs.create_dir(self.base, recursive=True)
        own = f"{self.base}/.{name}-{attempt}"
        with self.fs.open_output_stream(own) as out:
            for chunk in chunks:
                out.write(chunk)
        self.fs.move(own, f"{self.base}/{name}")

    def open(self, name: str):
        return self.fs.open_input_file(f"{self.base}/{name}")
