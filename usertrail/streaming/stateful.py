"""Stateful streams whose answer is the batch answer, whatever the order of arrival.

Both operators hold what is still open in RocksDB state until the watermark has
passed, settle it by event-time timers, and send what they can't place (rows without
a time, rows behind the watermark) to a side output in place of dropping it.  What
is open when a stream stops is read from the state store itself, so at any moment
settled + open + side rows are all rows.

* ``stream_gap_sessions`` (T1): gap sessions.  Tasks first merge their own rows into
  stretches, so a hot user arrives as few stretches; per user the state lists the
  open sessions only.
* ``stream_column_runs`` (T3): sessions by a session column (A,B,A -> 3).  State is
  keyed by user *and* time bucket: a hot user's rows are spread over buckets and
  never make one frame.  A settled bucket is written in order with run numbers of
  its own; ``column_sessions`` adds the offsets from one row a bucket, as the
  batch path does, and numbers anew only the buckets with side or open rows.

A key of the state is not a user but one of ``user_groups`` groups of users by hash, and an
element of its list is an Arrow batch of rows: a call to the state costs milliseconds whatever
it holds, so calls follow the groups (and buckets), and rows are worked on by the frame.
Spark hands a group's rows to Python one by one, so tasks send the gap sessions' stretches
as such elements too, one a group.
A checkpoint goes on with the number of groups that it was begun with.

Timers clear the state, so no time-to-live is set (Spark offers that for processing
time only, which would drop rows of a stream that stands still).

Defined cases: rows without a user belong to nobody; a null session value is ''; a
stream without rows gives empty tables; times before 1970 lie behind any watermark and
go to the side output, which the tables count like the rest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from usertrail.functions.timefmt import NULL_TS_KEY, ts_key
from usertrail.streaming.live import event_time

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SHUFFLE = "spark.sql.shuffle.partitions"

USER_GROUPS = 256
#: A state store takes the users of about so many landed bytes, or of more if each core has one.
STORE_BYTES = 32 << 20
#: A list state's element holds at most so many rows.
ELEMENT_ROWS = 50_000
_ELEMENT = "rows binary"
#: Elements of about so many bytes are unpacked at a time.
PIECE_BYTES = 8 << 20


@contextmanager
def rocksdb_state(spark: SparkSession, stores: int | None = None):
    """Queries started inside keep their state in RocksDB, in ``stores`` parts; the session's own settings come back."""
    ours = {_PROVIDER: _ROCKSDB} | ({_SHUFFLE: str(stores)} if stores else {})
    before = {name: spark.conf.get(name) for name in ours}
    try:
        for name, value in ours.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def state_stores(spark: SparkSession, path: str) -> int:
    """In how many parts a stream over the files in ``path`` keeps its state: one a core, more for more
    bytes, never more than the shuffle partitions.

    A part costs each micro-batch a good half second (a Python worker, a commit) whatever it
    holds.  A checkpoint goes on with the number that it was begun with."""
    fs, p = _file(spark, path)
    n = max(spark.sparkContext.defaultParallelism, -(-fs.getContentSummary(p).getLength() // STORE_BYTES))
    return min(n, int(spark.conf.get(_SHUFFLE)))


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file(spark, path)
    return fs.exists(p)


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _state(spark: SparkSession, checkpoint: str, name: str, schema: str) -> DataFrame | None:
    """The rows in the list state ``name`` as committed last."""
    if not _exists(spark, f"{checkpoint}/state"):
        return None
    with rocksdb_state(spark):
        held = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    return held.select("list_element.rows").mapInArrow(_unpack, schema)


def _element(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as to:
        to.write_table(table)
    return sink.getvalue().to_pybytes()


def _packed(frame: pd.DataFrame, schema: pa.Schema) -> list[tuple[bytes]]:
    """The rows as elements of a list state."""
    return [(_element(pa.Table.from_pandas(frame.iloc[at:at + ELEMENT_ROWS], schema, preserve_index=False).replace_schema_metadata()),)
            for at in range(0, len(frame), ELEMENT_ROWS)]


def _unpacked(elements: Iterable[tuple[bytes]], schema: pa.Schema) -> pd.DataFrame:
    """The rows of ``_packed`` elements."""
    found = [pa.ipc.open_stream(rows).read_all() for rows, in elements]
    return pa.concat_tables([schema.empty_table(), *found]).replace_schema_metadata().to_pandas()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in batch.column(0).to_pylist():
            yield from pa.ipc.open_stream(rows)


def _group(user_groups: int) -> F.Column:
    return F.pmod(F.xxhash64("user_id"), F.lit(int(user_groups))).alias("user_group")


def _arriving(stream: DataFrame, watermark: str, user_col: str, ts_col: str, epoch: str | None, **more) -> DataFrame:
    """user_id and ts_key of all rows of a user, behind a watermark.

    The event time itself is dropped again: with it, Spark would drop late rows
    before the operator sees them."""
    timed = stream.withColumn("_time", event_time(stream, ts_col, epoch)).withWatermark("_time", watermark)
    return timed.where(F.col(user_col).isNotNull()).select(
        F.col(user_col).cast("string").alias("user_id"), ts_key(F.col("_time")).alias("ts_key"),
        *[c.alias(name) for name, c in more.items()])


def observed(stream: DataFrame, ts_col: str, name: str = "arrivals") -> DataFrame:
    """The stream with counts of rows and of rows without a time in each progress report."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(ts_col).isNull()).alias("untimed"))


def observations(query, name: str = "arrivals") -> dict[str, int]:
    """Sums of the metrics of ``observed`` over the reports that the query still has."""
    seen = [p["observedMetrics"][name] for p in query.recentProgress if name in (p.get("observedMetrics") or {})]
    return {k: sum(s[k] for s in seen) for k in ("rows", "untimed")}


# --- T1: gap sessions -----------------------------------------------------------

SESSION_OUT = "user_id string, start_key long, end_key long, n_events long, kind string"


_SPAN = ["start_key", "end_key", "n_events"]
_OPEN = pa.schema([("user_id", pa.string()), *((name, pa.int64()) for name in _SPAN)])
_OPEN_DDL = "user_id string, start_key long, end_key long, n_events long"


def _stretched(users: np.ndarray, rows: np.ndarray, gap_us: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches (start, end, n) in order by user number; those of a user at most a gap apart made one."""
    if not len(rows):
        return users, rows
    order = np.lexsort((rows[:, 0], users))
    users, rows = users[order].astype(np.int64), rows[order]
    # the furthest end so far of the same user: ends as ranks, which the user's number keeps apart
    ends = np.sort(rows[:, 1])
    reach = ends[np.maximum.accumulate(users * len(rows) + np.searchsorted(ends, rows[:, 1])) % len(rows)]
    new = np.flatnonzero(np.concatenate([[True], (users[1:] != users[:-1]) | (rows[1:, 0] - reach[:-1] > gap_us)]))
    return users[new], np.column_stack([rows[new, 0], np.maximum.reduceat(rows[:, 1], new), np.add.reduceat(rows[:, 2], new)])


def _merged(parts: list[np.ndarray], gap_us: int) -> np.ndarray:
    """One user's stretches (start, end, n) in order, those at most a gap apart made one."""
    rows = np.concatenate([p for p in parts if len(p)] or [np.empty((0, 3), np.int64)])
    return _stretched(np.zeros(len(rows), np.int64), rows, gap_us)[1]


def _spans(user, rows: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"user_id": user, "start_key": rows[:, 0], "end_key": rows[:, 1], "n_events": rows[:, 2]})


def _merged_frames(frames: list[pd.DataFrame], gap_us: int) -> pd.DataFrame:
    """All users' stretches, those of a user at most a gap apart made one."""
    frame = pd.concat(frames)
    numbers, users = pd.factorize(frame["user_id"])
    numbers, rows = _stretched(numbers, frame[_SPAN].to_numpy(np.int64), gap_us)
    return _spans(np.asarray(users, object)[numbers], rows)


def _stretches(gap_us: int):
    """Per Arrow batch and user: stretches of rows; untimed rows as one row with their number."""
    def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = frame["ts_key"].to_numpy(np.int64)
            known = at != NULL_TS_KEY
            yield _merged_frames([_spans(frame["user_id"][known], np.column_stack(
                [at[known], at[known], np.ones(known.sum(), np.int64)]))], gap_us)
            untimed = frame["user_id"][~known].value_counts(sort=False)
            yield _spans(untimed.index, np.column_stack(
                [np.full((len(untimed), 2), NULL_TS_KEY, np.int64), untimed.to_numpy(np.int64)]))
    return combine


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group of users and about ``ELEMENT_ROWS`` stretches of a task: one row that holds them as an element."""
    def grouped(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(some).combine_chunks()
        groups = table["user_group"].to_numpy()
        order = np.argsort(groups, kind="stable")
        stretches = table.select(_OPEN.names).cast(_OPEN).take(order)
        groups, at = np.unique(groups[order], return_index=True)
        rows = [_element(stretches.slice(a, b - a)) for a, b in zip(at, [*at[1:], len(stretches)])]
        return pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(rows, pa.binary())], ["user_group", "rows"])

    some, n = [], 0
    for batch in batches:
        some.append(batch)
        n += len(batch)
        if n >= ELEMENT_ROWS:
            yield grouped(some)
            some, n = [], 0
    if n:
        yield grouped(some)


def _opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The stretches that the elements of ``_by_group`` hold; frames of stretches as they are."""
    for frame in frames:
        if "rows" not in frame:
            yield frame
            continue
        piece, size = [], 0
        for rows in frame["rows"]:
            piece.append((rows,))
            size += len(rows)
            if size >= PIECE_BYTES:
                yield _unpacked(piece, _OPEN)
                piece, size = [], 0
        yield _unpacked(piece, _OPEN)


class _GapSessions(StatefulProcessor):
    """Per group of users: the open sessions as (user, start, end, n)."""

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _ELEMENT)

    def _emit(self, rows: pd.DataFrame, kind: str) -> Iterator[pd.DataFrame]:
        if len(rows):
            yield rows.assign(kind=kind)

    def _over(self, rows: pd.DataFrame, watermark_ms: int) -> pd.Series:
        """Which stretches no row on time can reach any more."""
        return rows["end_key"] + self.gap_us < watermark_ms * 1000

    def _keep(self, rows: pd.DataFrame) -> None:
        if not len(rows):
            self.open.clear()
            return
        self.open.put(_packed(rows, _OPEN))
        self.handle.registerTimer(max(int(rows["end_key"].min() + self.gap_us) // 1000 + 1, 0))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = _unpacked(self.open.get(), _OPEN)
        fresh, n = [], 0
        for frame in _opened(rows):
            new = frame[_OPEN.names]
            untimed = new["start_key"] == NULL_TS_KEY
            late = ~untimed & self._over(new, now)
            yield from self._emit(new[untimed], "untimed")
            yield from self._emit(new[late], "late")
            fresh.append(new[~untimed & ~late])
            n += len(fresh[-1])
            if n > max(len(held), ELEMENT_ROWS):  # each merge at most doubles what is held
                held, fresh, n = _merged_frames([held, *fresh], self.gap_us), [], 0
        self._keep(_merged_frames([held, *fresh], self.gap_us))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = _unpacked(self.open.get(), _OPEN)
        over = self._over(held, timerValues.getCurrentWatermarkInMs())
        yield from self._emit(held[over], "closed")
        if over.any():
            self._keep(held[~over])

    def close(self) -> None:
        pass


def stream_gap_sessions(stream: DataFrame, *, gap_minutes: int = 30, watermark: str = "1 hour", user_col: str = "user_id",
                        ts_col: str = "ts", epoch: str | None = None, user_groups: int = USER_GROUPS) -> DataFrame:
    """Rows of kind closed (a session), late (a stretch behind the watermark) or untimed.

    Start it inside ``rocksdb_state``, in append mode."""
    gap_us = int(gap_minutes) * 60_000_000
    if gap_us <= 0:
        raise ValueError("session gap must be positive")
    parts = _arriving(stream, watermark, user_col, ts_col, epoch).mapInPandas(_stretches(gap_us), _OPEN_DDL)
    packed = parts.withColumn("user_group", _group(user_groups)).mapInArrow(_by_group, "user_group long, rows binary")
    return packed.groupBy("user_group").transformWithStateInPandas(
        _GapSessions(gap_us), SESSION_OUT, "append", "EventTime")


def gap_sessions(spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """Everything that ``stream_gap_sessions`` wrote to ``path``, and its open sessions (kind open)."""
    found = _written(spark, path, SESSION_OUT)
    still = _state(spark, checkpoint, "open", _OPEN_DDL)
    if still is None:
        return found
    return found.unionByName(still.withColumn("kind", F.lit("open")))


# --- T3: sessions by a column ----------------------------------------------------

RUN_OUT = "user_id string, bucket long, ts_key long, ord long, sid string, run long, kind string"


_HELD = pa.schema([("user_id", pa.string()), ("bucket", pa.int64()), ("ts_key", pa.int64()), ("ord", pa.int64()), ("sid", pa.string())])
_HELD_DDL = "user_id string, bucket long, ts_key long, ord long, sid string"


def _runs(users: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Numbers from 0 for each user, one more wherever a value differs from the user's one before."""
    if not len(values):
        return np.empty(0, np.int64)
    first = np.concatenate([[True], users[1:] != users[:-1]])
    changes = np.cumsum(np.concatenate([[False], values[1:] != values[:-1]]) & ~first)
    return changes - changes[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]


class _Settler(StatefulProcessor):
    """Holds the rows of one group of users and time bucket until the watermark has passed the bucket.

    Rows that name no user are those of the one user that is the group."""

    def __init__(self, width_us: int):
        self.width_us = width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", _ELEMENT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        group, bucket = key
        ends = (bucket + 1) * self.width_us // 1000
        settled = ends <= timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            own = frame if "user_id" in frame else frame.assign(user_id=group)
            own = own.assign(bucket=bucket)[_HELD.names]
            if settled:
                yield own.assign(run=pd.array([None] * len(own), "Int64"),
                                 kind=np.where(own["ts_key"] == NULL_TS_KEY, "untimed", "late"))
            else:
                self.rows.appendList(_packed(own, _HELD))
        if not settled:
            self.handle.registerTimer(int(ends))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = _unpacked(self.rows.get(), _HELD)
        self.rows.clear()
        if len(held):
            held = held.sort_values(["user_id", "ts_key", "ord"], kind="mergesort", na_position="first")
            yield held.assign(run=_runs(held["user_id"].to_numpy(object), held["sid"].to_numpy(object)), kind="settled")

    def close(self) -> None:
        pass


def stream_column_runs(stream: DataFrame, *, watermark: str = "1 hour", bucket_seconds: int = 86_400, user_col: str = "user_id",
                       ts_col: str = "ts", session_col: str = "sid", order_col: str = "event_id",
                       epoch: str | None = None, user_groups: int = USER_GROUPS) -> DataFrame:
    """Rows in order within their bucket (kind settled), or unplaced (late, untimed).

    Start it inside ``rocksdb_state``, in append mode."""
    width = int(bucket_seconds) * 1_000_000
    rows = _arriving(stream, watermark, user_col, ts_col, epoch, ord=F.col(order_col).cast("long"),
                     sid=F.coalesce(F.col(session_col).cast("string"), F.lit("")))
    # floor division, as times may lie before 1970
    rows = rows.withColumn("bucket", F.expr(f"(ts_key - pmod(ts_key, {width}L)) div {width}L"))
    return rows.withColumn("user_group", _group(user_groups)).groupBy("user_group", "bucket").transformWithStateInPandas(
        _Settler(width), RUN_OUT, "append", "EventTime")


def column_rows(spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """Everything that ``stream_column_runs`` wrote to ``path``, and the rows it still holds (kind open)."""
    found = _written(spark, path, RUN_OUT)
    still = _state(spark, checkpoint, "rows", _HELD_DDL)
    if still is None:
        return found
    return found.unionByName(still.withColumns({"run": F.lit(None).cast("long"), "kind": F.lit("open")}))


def column_sessions(spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """user_id, ord, session_no and session_id of all rows that arrived, numbered as a batch would."""
    rows = column_rows(spark, path, checkpoint)
    unplaced = rows.where("kind <> 'settled'")
    redo = unplaced.select("user_id", "bucket").distinct()
    settled = rows.where("kind = 'settled'")
    order = Window.partitionBy("user_id", "bucket").orderBy("ts_key", "ord")
    changes = F.coalesce(F.col("sid") != F.lag("sid").over(order), F.lit(False)).cast("long")
    again = settled.join(redo, ["user_id", "bucket"], "left_semi").unionByName(unplaced).withColumn("_change", changes)
    again = again.withColumn("run", F.sum("_change").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")
    rows = settled.join(redo, ["user_id", "bucket"], "left_anti").unionByName(again)
    # one row a bucket; its first run goes on with the last of the bucket before if that has the same value
    at = F.struct("ts_key", "ord")
    buckets = rows.groupBy("user_id", "bucket").agg(F.min_by("sid", at).alias("first"), F.max_by("sid", at).alias("last"),
                                                    F.max("run").alias("changes"))
    user = Window.partitionBy("user_id").orderBy("bucket")
    before = F.lag("last").over(user)
    starts = F.when(before.isNull() | (before != F.col("first")), 1).otherwise(0)
    offsets = buckets.withColumn("_starts", starts).select(
        "user_id", "bucket", (F.sum(F.col("_starts") + F.col("changes")).over(user.rowsBetween(Window.unboundedPreceding, 0))
                              - F.col("changes")).alias("offset"))
    return rows.join(offsets, ["user_id", "bucket"]).select(
        "user_id", "ord", (F.col("offset") + F.col("run")).alias("session_no"), F.col("sid").alias("session_id"))
