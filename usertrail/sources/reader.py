"""Read an event log into a DataFrame, dispatching on the file suffix.

Supports single files, directories of part files and glob patterns.  All
formats are read lazily by Spark; nothing passes through the driver.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from usertrail.sources.json_array import read_json_array

CSV_SUFFIXES = (".csv", ".tsv")
PARQUET_SUFFIXES = (".parquet", ".pq")
JSON_SUFFIXES = (".json",)
JSONL_SUFFIXES = (".jsonl", ".ndjson")
SUPPORTED = sorted(CSV_SUFFIXES + PARQUET_SUFFIXES + JSON_SUFFIXES + JSONL_SUFFIXES)


class ReadError(ValueError):
    """Raised when the input cannot be read."""


def _range_bytes(spark: SparkSession) -> int:
    text = spark.conf.get("spark.sql.files.maxPartitionBytes")
    return spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)


def _suffix(path: str) -> str:
    base = path.rstrip("/")
    return os.path.splitext(base)[1].lower()


def _files(spark: SparkSession, path: str) -> dict[str, int]:
    """Names and largest sizes of the non-empty data files that a path, folder or pattern stands for.

    Asks the file system that Spark would read from, so a path without a scheme
    means the cluster's default file system and not the driver's disk.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(where)
    if not found:
        raise ReadError(f"nothing to read at {path}")
    names: dict[str, int] = {}
    size = 0
    for status in found:
        files = fs.listFiles(status.getPath(), True)
        while files.hasNext():
            f = files.next()
            name = f.getPath().getName()
            if not name.startswith((".", "_")):
                names[name] = max(names.get(name, 0), f.getLen())
                size += f.getLen()
    if not size:
        raise ReadError(f"no data in {path}")
    return names


def _format_of(path: str, files: Sequence[str]) -> str:
    suffix = _suffix(path)
    if suffix in CSV_SUFFIXES + PARQUET_SUFFIXES + JSON_SUFFIXES + JSONL_SUFFIXES:
        return suffix
    # directory or glob: decide from the part files
    suffixes = {_suffix(f) for f in files} - {""}
    if len(suffixes) == 1:
        return suffixes.pop()
    if not suffixes and files:
        raise ReadError(f"cannot tell the format of {path} from {suffix!r}; known are {SUPPORTED}")
    raise ReadError(f"{path} holds files of {sorted(suffixes)}; expected are files of one of {SUPPORTED}")


def read_events(spark: SparkSession, path: str, *, schema=None) -> DataFrame:
    """Dispatch on the (lower-cased) suffix.

    ``schema`` (a DDL string or StructType) skips inference; at scale always
    pass one for CSV/JSON.
    """
    path = str(path)
    files = _files(spark, path)
    fmt = _format_of(path, list(files))
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt in CSV_SUFFIXES:
        sep = "\t" if fmt == ".tsv" else ","
        opts = {"header": "true", "sep": sep, "mode": "PERMISSIVE"}
        if schema is None:
            opts.update(inferSchema="true")
        return reader.options(**opts).csv(path)
    if fmt in PARQUET_SUFFIXES:
        return reader.parquet(path)
    if fmt in JSONL_SUFFIXES:
        return reader.json(path)
    if fmt in JSON_SUFFIXES:
        # An array of objects.  A file of more than one byte range is read in ranges; Spark's own
        # reader takes a file as one document, which is the same and cheaper for small ones.
        if max(files.values()) > _range_bytes(spark):
            return read_json_array(spark, path, schema)
        return reader.option("multiLine", "true").json(path)
    raise ReadError(f"no reader for {fmt!r}; known are {SUPPORTED}")


def read_parts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Union several export parts by column name (missing columns -> null)."""
    if not paths:
        raise ReadError("an empty list of parts")
    frames = [read_events(spark, p) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
