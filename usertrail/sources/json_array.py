"""JSON arrays of objects read by many tasks.

Spark reads such a file as one document in one task.  Here the text source reads
it with "}" in place of line ends, so a file is cut into byte ranges like any text
and a row is what lies between two closing braces.  Whether a brace closes an
object depends on everything before it, but only through two things: whether one is
inside a string, and how deep the brackets are.

1. Every byte range tells what it does to both, for either start (one row a range).
2. A window over the ranges of a file gives each its true start.
3. With that, tasks cut out the objects.  What begins in one range and ends in a later one
   comes as pieces, at most two a range, which are numbered and joined.

A task takes as many byte ranges as make ``TASK_BYTES``, so tasks and the files that they write
follow the bytes, however small the ranges are.

Objects are written once, a line each, to the shared folder and read by the JSON reader, with
the caller's schema or the one that it infers from all of them.

Defined cases: a file may hold one object in place of an array; elements that are numbers,
strings or nulls are skipped (arrays as elements are not supported); an empty array gives
no rows; an object that never ends is an error that names its file.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usertrail.config import ensure_checkpoint_dir

#: Bytes that a task reads at least, if there are enough tasks for all cores.
TASK_BYTES = 16 << 20
_MAX_PARTS = "spark.sql.files.maxPartitionNum"
_ESCAPE = re.compile(r"\\.", re.S)
_MARK = re.compile(r'\\.|["{}\[\]]', re.S)


def _tasks(spark: SparkSession, path: str) -> int:
    """Tasks for the files at ``path``: as many as cores, or by bytes if that is more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = sum(fs.getContentSummary(status.getPath()).getLength() for status in fs.globStatus(where) or [])
    return max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


@contextmanager
def _at_most(spark: SparkSession, tasks: int):
    """Scans planned inside put file ranges together until there are about ``tasks`` tasks; the session's own setting comes back."""
    before = spark.conf.get(_MAX_PARTS, None)
    spark.conf.set(_MAX_PARTS, str(tasks))
    try:
        yield
    finally:
        spark.conf.unset(_MAX_PARTS) if before is None else spark.conf.set(_MAX_PARTS, before)


def _fragments(spark: SparkSession, path: str, tasks: int) -> DataFrame:
    """file, range start, and the text up to each closing brace, in the order of the file; whole ranges share a task."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value")).coalesce(tasks)


def _effect(text: str) -> tuple[int, int, int]:
    """Quotes (0 or 1 by parity), and the change of depth if the text starts outside or inside a string."""
    parts = _ESCAPE.sub("", text).split('"')
    change = [sum(p.count("{") + p.count("[") - p.count("}") - p.count("]") for p in parts[k::2]) for k in (0, 1)]
    return (len(parts) - 1) % 2, change[0], change[1]


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a byte range: what it does to both states, and whether a file's first sign is '['."""
    at, quotes, change, first = None, 0, [0, 0], None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": at[0], "start": at[1], "quotes": quotes, "outside": change[0],
                                            "inside": change[1], "first": first}], schema=pa.schema(
            [("file", pa.string()), ("start", pa.int64()), ("quotes", pa.int32()), ("outside", pa.int64()),
             ("inside", pa.int64()), ("first", pa.string())]))

    for batch in batches:
        for file, start, value in zip(*(c.to_pylist() for c in batch.columns)):
            if at != (file, start):
                if at:
                    yield row()
                at, quotes, change, first = (file, start), 0, [0, 0], None
            first = first or (value.lstrip("\ufeff \t\r\n")[:1] or None)
            own = _effect(value + "}")
            change = [change[k] + own[1 + (quotes + k) % 2] for k in (0, 1)]
            quotes = (quotes + own[0]) % 2
    if at:
        yield row()


def _starts(effects: DataFrame) -> DataFrame:
    """file, start, and the state at the start of each byte range; ``level`` is the depth between objects."""
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).alias("in_string")
    level = F.when(F.first("first", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                   == "[", 1).otherwise(0).alias("level")
    known = effects.select("file", "start", "outside", "inside", inside, level)
    change = F.when(F.col("in_string") == 1, F.col("inside")).otherwise(F.col("outside"))
    return known.withColumn("change", change).select(
        "file", "start", "in_string", "level", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects, and the pieces of those that cross a range: (file, start, piece, begins, ends, text)."""
    at, rows = None, []
    in_string = depth = level = piece = 0
    inside = begins = False
    held: list[str] = []  # the open object's text so far

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate(
                (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()))],
            ["file", "start", "piece", "begins", "ends", "text"])

    def emit(ends: bool) -> None:
        nonlocal held, begins, piece
        rows.append((*at, piece, begins, ends, "".join(held)))
        piece += 1
        held, begins = [], True

    for batch in batches:
        for file, start, s0, l0, d0, value in zip(*(c.to_pylist() for c in batch.columns)):
            if at != (file, start):
                if inside:
                    emit(False)
                at, in_string, level, depth, piece = (file, start), s0, l0, d0, 0
                inside, held = depth > level, []
                begins = not inside
            text, since = value + "}", 0
            for m in _MARK.finditer(text):
                sign = m.group()
                if sign == '"':
                    in_string ^= 1
                elif in_string or len(sign) > 1:
                    continue
                elif sign in "{[":
                    if sign == "{" and depth == level and not inside:
                        inside, since = True, m.start()
                    depth += 1
                else:
                    depth -= 1
                    if inside and depth == level:
                        held.append(text[since:m.end()])
                        emit(True)
                        inside = False
            if inside:
                held.append(text[since:])
            if len(rows) >= 1000:
                yield out()
                rows = []
    if inside:
        emit(False)
    if rows:
        yield out()


def read_json_array(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The objects of the arrays at ``path`` as rows, with ``schema`` or the one inferred from all objects."""
    from usertrail.sources.reader import ReadError

    tasks = _tasks(spark, path)
    effects = _fragments(spark, path, tasks).mapInArrow(
        _effects, "file string, start long, quotes int, outside long, inside long, first string")
    # as many rows as the files have byte ranges, like the driver's own list of them
    starts = F.broadcast(_starts(effects))
    rows = _fragments(spark, path, tasks).join(starts, ["file", "start"]).select("file", "start", "in_string", "level", "depth", "value")
    piece = "file string, start long, piece long, begins boolean, ends boolean, text string"
    whole = F.col("begins") & F.col("ends")
    lines = f"{ensure_checkpoint_dir(spark).rstrip('/')}/usertrail-json-{uuid.uuid4().hex}"
    # one pass: whole objects to one folder, pieces to another
    (rows.mapInArrow(_cut, piece).select(
        F.translate(F.when(whole, F.col("text")).otherwise(F.to_json(F.struct("*"))), "\r\n", "  ").alias("value"),
        F.when(whole, "objects").otherwise("pieces").alias("kind"))
     .write.partitionBy("kind").text(lines))
    pieces = (spark.read.text(lines).where("kind = 'pieces'")
              .select(F.from_json("value", piece).alias("r")).select("r.*"))
    order = Window.partitionBy("file").orderBy("start", "piece")
    joined = pieces.withColumn("number", F.sum(F.col("begins").cast("long")).over(order)).groupBy("file", "number").agg(
        F.max("ends").alias("ends"), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("start", "piece", "text"))), lambda p: p["text"]), "").alias("value"))
    if (broken := joined.where("not ends").select("file").first()) is not None:
        raise ReadError(f"an object without an end in {broken['file']}")
    joined.select(F.translate("value", "\r\n", "  ").alias("value")).write.mode("append").text(f"{lines}/kind=objects")
    reader = spark.read if schema is None else spark.read.schema(schema)
    with _at_most(spark, tasks):  # inferring a schema is a pass over all lines
        return reader.json(f"{lines}/kind=objects")
