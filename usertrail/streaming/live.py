"""Structured Streaming re-aim of the file-watch rebuild (S11, T1, T2, T4): Spark's own aggregates.

* T1 ``stream_sessions``: gap sessions with ``session_window`` + watermark,
  append mode: a session is emitted once the watermark passes its end, i.e.
  only *closed* sessions leave the state store.  ``stateful.stream_gap_sessions``
  also accounts for open sessions and for late and untimed rows.
* T2 ``stream_user_counts`` / T4 ``stream_profiles``: per-user aggregates in
  update mode.  Each micro-batch adds only the users whose aggregate changed to a
  ``store.ChangeLog``, which gives upsert semantics on plain Parquet.
* Profiles that need a user's whole history: ``store.ProfileStore``.

All state lives in the checkpoint location, which must be on shared storage
on a cluster (see ``usertrail.config.ensure_checkpoint_dir``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usertrail.constants import OTHER_FAMILY
from usertrail.functions.timefmt import parse_string_ts

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_time(stream: DataFrame, ts_col: str, epoch: str | None):
    """The time as TIMESTAMP (watermarks need it); unreadable strings are null, as in a batch.

    A stream can't look at its largest value first, so numbers need their unit:
    ``epoch`` is "s" or "ms"."""
    ts, dtype = F.col(ts_col), stream.schema[ts_col].dataType
    if isinstance(dtype, T.StringType):
        return parse_string_ts(ts)
    if isinstance(dtype, T.NumericType):
        if epoch not in ("s", "ms"):
            raise ValueError(f"{ts_col!r} holds numbers: say whether they are epoch='s' or epoch='ms'")
        return F.timestamp_micros((ts.cast("decimal(38,6)") * (1_000_000 if epoch == "s" else 1000)).cast("long"))
    return ts.cast("timestamp")


def _normalise(stream: DataFrame, user_col: str, ts_col: str, name_col: str, epoch: str | None = None) -> DataFrame:
    """Rows of a user, those without a time included; rows without a user belong to nobody."""
    return stream.select(
        F.col(user_col).cast("string").alias("user_id"),
        event_time(stream, ts_col, epoch).alias("ts"),
        F.col(name_col).cast("string").alias("event_name"),
    ).where(F.col("user_id").isNotNull())


def read_event_stream(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, fmt: str = "parquet",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path)


def stream_sessions(stream: DataFrame, *, gap_minutes: int = 30, watermark: str = "1 hour",
                    user_col: str = "user_id", ts_col: str = "ts", name_col: str = "event_type",
                    epoch: str | None = None) -> DataFrame:
    """Closed gap sessions (start, end = last event + gap, events).

    A session is a stretch of time, so rows without one are in none; T2 counts them."""
    ev = _normalise(stream, user_col, ts_col, name_col, epoch).where(F.col("ts").isNotNull()).withWatermark("ts", watermark)
    sw = F.session_window(F.col("ts"), f"{int(gap_minutes)} minutes")
    return ev.groupBy("user_id", sw.alias("session")).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    ).select("user_id", F.col("session.start").alias("session_start"),
             F.col("session.end").alias("session_end"), "n_events", "first_ts", "last_ts")


def stream_user_counts(stream: DataFrame, *, user_col: str = "user_id", ts_col: str = "ts",
                       name_col: str = "event_type", epoch: str | None = None) -> DataFrame:
    """Running per-user event counts and last activity (update mode)."""
    ev = _normalise(stream, user_col, ts_col, name_col, epoch)
    return ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_ts"))


def stream_profiles(stream: DataFrame, families: Sequence[str], family_of, *, user_col: str = "user_id",
                    ts_col: str = "ts", name_col: str = "event_type", epoch: str | None = None) -> DataFrame:
    """T4: incremental per-user profile aggregates (counts, first/last, family counts).

    ``families``/``family_of`` come from a batch ``FamilyPlan`` (the family
    list is fixed when the stream starts).
    """
    ev = _normalise(stream, user_col, ts_col, name_col, epoch).withColumn("family", family_of(F.col("event_name")))
    fams = list(dict.fromkeys(list(families) + [OTHER_FAMILY]))
    return ev.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        *[F.count_if(F.col("family") == F.lit(f)).alias(f"fam_{i}") for i, f in enumerate(fams)],
    ).select("user_id", "events", "first_ts", "last_ts",
             F.map_filter(F.map_from_arrays(F.array(*[F.lit(f) for f in fams]),
                                            F.array(*[F.col(f"fam_{i}") for i in range(len(fams))])),
                          lambda k, v: v > 0).alias("family_counts"))


def live_totals(newest: DataFrame) -> DataFrame:
    """T2 totals (users, events) from the newest row per user.

    Streaming aggregations cannot count distinct users exactly; the
    changelog's newest rows can.
    """
    return newest.agg(F.count(F.lit(1)).alias("users"), F.coalesce(F.sum("events"), F.lit(0)).alias("events"))


def run_available_now(df: DataFrame, *, checkpoint: str, output_mode: str, sink_path: str | None = None,
                      foreach_batch=None, fmt: str = "parquet"):
    """Run a streaming query over everything available now and wait for it."""
    w = df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if foreach_batch is not None:
        q = w.foreachBatch(foreach_batch).start()
    else:
        q = w.format(fmt).option("path", sink_path).start()
    q.awaitTermination()
    return q
