"""Per-user ordered scan (SS1-SS3, SS5 and the ordered inputs of I6, V3, V4, V10).

Hot keys are split from the rest (``hot_users``):

* ordinary users take ONE window partitioned by user (one shuffle, one
  sort) -- the cheapest plan when a user's history fits a task;
* hot users (a bot, an anonymous id, possibly a third of all rows) take a
  two-level scan keyed by ``(user_id, bucket)``, so no single user is ever one
  window partition.  Both paths are exact: which users are "hot" only
  changes speed, never results.  For gap sessions both kinds of users run in
  one plan (``_mixed``): one scan, one exchange of event rows.

The two-level scan.  ``bucket`` is a fixed-width time slice:

Gap sessions (the default).  The bucket width is at most the session gap, so
two rows of one bucket are always less than a gap apart: a session can only
start on the *first* row of a bucket.  Every session decision then depends
on per-bucket ``count / min / max / max_by`` only -- aggregates that Spark
pre-combines on the map side *before* the shuffle.  A window over these
summary rows (one per user-bucket) yields session and position offsets; the
summary is joined back on ``(user_id, bucket)`` and a window inside each
bucket finishes positions and the previous-event columns.  Event rows are
shuffled exactly once, on ``(user_id, bucket)``.

Column sessions (SS2: a new session whenever the id changes) need the order
inside a bucket, so that path runs the in-bucket window first and derives
the summary from it.

Output columns added to the events (``bucket`` is kept for the two-level
rows so downstream windows can reuse the partitioning; it is null on the
single-window rows):

``pos``          1-based position of the row in its user's history
``session_no``   1-based session number within the user
``session_id``   ``{user}_s{n}`` (gap mode) or the session column's value
``is_start``     row opens a session
``prev_name``    previous event name of the same user (null on the first)
``prev_ts_key``  previous row's time key
``prev_start_key`` on a session's first row: the previous session's start
                 (first known time; gap mode), feeding the longest-gap insight
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usertrail.functions.timefmt import NULL_TS_KEY

DEFAULT_BUCKET_SECONDS = 900


def _gap_start(cur_key, prev_key, gap_us: int):
    """New session when both times are known and strictly more than gap apart."""
    null_key = F.lit(NULL_TS_KEY)
    return (prev_key != null_key) & (cur_key != null_key) & ((cur_key - prev_key) > F.lit(gap_us))


def _bucket(width_us: int):
    """Number of the time slice that holds ``ts_key``: rounded down also before
    1970, so that every slice is equally wide.  Null times (NULL_TS_KEY) land
    in the lowest slice and so sort first."""
    return F.expr(f"ts_key div {width_us} - if(ts_key < 0 and ts_key % {width_us} <> 0, 1, 0)")


def _with_bucket(events: DataFrame, width_us: int) -> DataFrame:
    return events.where(F.col("user_id").isNotNull()).withColumn("bucket", _bucket(width_us))


def _split(events: DataFrame, hot_users):
    ev = events.where(F.col("user_id").isNotNull())
    hot = F.broadcast(ev.sparkSession.createDataFrame([(str(u),) for u in hot_users], "user_id string"))
    return ev.join(hot, "user_id", "left_anti"), ev.join(hot, "user_id", "left_semi")


def timeline(events: DataFrame, *, gap_minutes: int = 30, by_column: bool = False,
             bucket_seconds: int = DEFAULT_BUCKET_SECONDS, hot_users=None) -> DataFrame:
    """Add session / position / previous-event columns to normalised events.

    ``events`` must carry ``user_id, ts_key, ord, event_name`` (and
    ``session_id`` when ``by_column``).  Rows with a null user are dropped:
    they belong to no user history (they are still counted by the totals).
    ``hot_users``: ``None`` sends every user through the two-level scan, a
    (bounded, broadcast) list sends only those users, ``[]`` none.
    """
    if hot_users is None:
        return _bucketed(events, gap_minutes=gap_minutes, by_column=by_column, bucket_seconds=bucket_seconds)
    if not hot_users:
        return _single_window(events, gap_minutes=gap_minutes, by_column=by_column)
    if not by_column:
        return _mixed(events, hot_users, gap_minutes=gap_minutes, bucket_seconds=bucket_seconds)
    normal, hot = _split(events, hot_users)
    return _single_window(normal, gap_minutes=gap_minutes, by_column=by_column).unionByName(
        _bucketed(hot, gap_minutes=gap_minutes, by_column=by_column, bucket_seconds=bucket_seconds))


def _mixed(events: DataFrame, hot_users, *, gap_minutes: int, bucket_seconds: int) -> DataFrame:
    """Gap sessions, hot and ordinary users in ONE plan (one scan, one exchange).

    Hot rows are flagged by a broadcast join with the (bounded) hot list and
    keyed ``(user_id, bucket)``; ordinary rows get a null bucket, so
    ``(user_id, null)`` is the user's whole history.  The hot users' bucket
    summary is left-joined on ``(user_id, bucket)`` (null never matches), and
    one window over ``(user_id, bucket)`` serves both kinds of rows.
    """
    gap_us, width = _gap_width(gap_minutes, bucket_seconds)
    hot = F.broadcast(events.sparkSession.createDataFrame([(str(u), True) for u in hot_users],
                                                          "user_id string, _hot boolean"))
    ev = events.where(F.col("user_id").isNotNull()).join(hot, "user_id", "left")
    ev = ev.withColumn("bucket", F.when(F.col("_hot"), _bucket(width)))
    summ = _bucket_summary(ev.where(F.col("_hot")), gap_us).select(
        "user_id", "bucket", "_plk", "_pln", "_fst", "_sno", "_po", "_pss")
    out = ev.join(summ, ["user_id", "bucket"], "left")
    w = Window.partitionBy("user_id", "bucket").orderBy("ts_key", "ord")
    out = out.withColumns({
        "_rn": F.row_number().over(w).cast("long"),
        "_pk": F.lag("ts_key").over(w),
        "_pn": F.lag("event_name").over(w),
    })
    is_hot = F.coalesce(F.col("_hot"), F.lit(False))
    first = F.col("_rn") == 1
    plain_start = first | _gap_start(F.col("ts_key"), F.col("_pk"), gap_us)
    out = out.withColumn("_ps", plain_start)
    out = out.withColumn("_psn", F.sum(F.col("_ps").cast("long")).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = out.withColumn("_pst", _prev_start(F.col("_ps"), ~first, w))
    session_no = F.when(is_hot, F.col("_sno")).otherwise(F.col("_psn"))
    out = out.withColumns({
        "pos": F.when(is_hot, F.col("_po") + F.col("_rn")).otherwise(F.col("_rn")),
        "session_no": session_no,
        "is_start": F.when(is_hot, first & F.col("_fst")).otherwise(F.col("_ps")),
        "prev_name": F.when(is_hot & first, F.col("_pln")).otherwise(F.col("_pn")),
        "prev_ts_key": F.when(is_hot & first, F.col("_plk")).otherwise(F.col("_pk")),
        "prev_start_key": F.when(is_hot, F.when(first & (F.col("ts_key") != F.lit(NULL_TS_KEY)), F.col("_pss")))
        .otherwise(F.col("_pst")),
    }).withColumn("session_id", F.concat(F.col("user_id"), F.lit("_s"), F.col("session_no").cast("string")))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def _single_window(events: DataFrame, *, gap_minutes: int, by_column: bool) -> DataFrame:
    """Ordinary users: one window per user (one shuffle, one sort)."""
    ev = events.where(F.col("user_id").isNotNull())
    w = Window.partitionBy("user_id").orderBy("ts_key", "ord")
    ev = ev.withColumns({
        "pos": F.row_number().over(w).cast("long"),
        "prev_ts_key": F.lag("ts_key").over(w),
        "prev_name": F.lag("event_name").over(w),
    })
    if by_column:
        ev = ev.withColumn("_sv", F.coalesce(F.col("session_id").cast("string"), F.lit(""))).drop("session_id")
        ev = ev.withColumn("_ps", F.lag("_sv").over(w))
        start = (F.col("pos") == 1) | (F.col("_sv") != F.col("_ps"))
    else:
        gap_us, _ = _gap_width(gap_minutes, DEFAULT_BUCKET_SECONDS)
        start = (F.col("pos") == 1) | _gap_start(F.col("ts_key"), F.col("prev_ts_key"), gap_us)
    ev = ev.withColumn("is_start", start)
    ev = ev.withColumn("session_no", F.sum(F.col("is_start").cast("long")).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if by_column:
        ev = ev.withColumn("prev_start_key", F.lit(None).cast("long"))
    else:
        ev = ev.withColumn("prev_start_key", _prev_start(F.col("is_start"), F.col("pos") > 1, w))
    sid = F.col("_sv") if by_column else F.concat(F.col("user_id"), F.lit("_s"), F.col("session_no").cast("string"))
    ev = ev.withColumn("session_id", sid).withColumn("bucket", F.lit(None).cast("long"))
    return ev.drop(*[c for c in ev.columns if c.startswith("_")])


def _known(key):
    return F.when(key != F.lit(NULL_TS_KEY), key)


def _prev_start(is_start, not_first, w):
    """On a session's first row (not the user's first): the previous session's
    start = its first known time (D11).  Running ``last``/``first`` over the
    same ordered window: no extra shuffle or sort."""
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last_start = F.last(F.when(is_start, F.col("ts_key")), ignorenulls=True).over(before)
    first_known = F.first(_known(F.col("ts_key")), ignorenulls=True).over(before)
    prev = F.when(last_start == F.lit(NULL_TS_KEY), first_known).otherwise(last_start)
    return F.when(is_start & not_first & (F.col("ts_key") != F.lit(NULL_TS_KEY)), prev)


def _bucketed(events: DataFrame, *, gap_minutes: int, by_column: bool, bucket_seconds: int) -> DataFrame:
    if by_column:
        return _column_timeline(events, bucket_seconds)
    gap_us, width = _gap_width(gap_minutes, bucket_seconds)
    ev = _with_bucket(events, width)
    summ = _bucket_summary(ev, gap_us).select("user_id", "bucket", "_plk", "_pln", "_fst", "_sno", "_po", "_pss")

    # Stitch: the only shuffle of event rows is on (user_id, bucket).
    out = ev.join(summ, ["user_id", "bucket"], "inner")
    w = Window.partitionBy("user_id", "bucket").orderBy("ts_key", "ord")
    out = out.withColumns({
        "_rn": F.row_number().over(w),
        "_pk": F.lag("ts_key").over(w),
        "_pn": F.lag("event_name").over(w),
    })
    first = F.col("_rn") == 1
    out = out.withColumns({
        "pos": F.col("_po") + F.col("_rn"),
        "session_no": F.col("_sno"),
        "is_start": first & F.col("_fst"),
        "prev_name": F.when(first, F.col("_pln")).otherwise(F.col("_pn")),
        "prev_ts_key": F.when(first, F.col("_plk")).otherwise(F.col("_pk")),
        "prev_start_key": F.when(first & (F.col("ts_key") != F.lit(NULL_TS_KEY)), F.col("_pss")),
    }).withColumn("session_id", F.concat(F.col("user_id"), F.lit("_s"), F.col("session_no").cast("string")))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def _gap_width(gap_minutes: int, bucket_seconds: int) -> tuple[int, int]:
    gap_us = int(gap_minutes) * 60 * 1_000_000
    if gap_us <= 0:
        raise ValueError("session gap must be positive")
    return gap_us, min(int(bucket_seconds) * 1_000_000, gap_us)


def _bucket_summary(ev: DataFrame, gap_us: int) -> DataFrame:
    """Per (user, bucket): counts, first/last time, session flags and offsets.

    Level 1 is a map-side combinable aggregate; level 2 a window over the
    (few) non-empty buckets of each user.
    """
    summ = ev.groupBy("user_id", "bucket").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("ts_key").alias("_fk"),
        F.max("ts_key").alias("_lk"),
        F.min(F.when(F.col("ts_key") != F.lit(NULL_TS_KEY), F.col("ts_key"))).alias("_fkn"),
        F.max_by("event_name", F.struct("ts_key", "ord")).alias("_lnm"),
    )
    w2 = Window.partitionBy("user_id").orderBy("bucket")
    summ = summ.withColumns({
        "_plk": F.lag("_lk").over(w2),
        "_pln": F.lag("_lnm").over(w2),
        "_first": F.row_number().over(w2) == 1,
    })
    summ = summ.withColumn("_fst", F.col("_first") | _gap_start(F.col("_fk"), F.col("_plk"), gap_us))
    before = w2.rowsBetween(Window.unboundedPreceding, -1)
    last_start = F.last(F.when(F.col("_fst"), F.col("_fk")), ignorenulls=True).over(before)
    first_known = F.first(F.col("_fkn"), ignorenulls=True).over(before)
    return summ.withColumns({
        "_sno": F.sum(F.col("_fst").cast("long")).over(w2.rowsBetween(Window.unboundedPreceding, 0)),
        "_po": F.coalesce(F.sum("_n").over(before), F.lit(0)),
        "_pss": F.when(F.col("_fst") & ~F.col("_first"),
                       F.when(last_start == F.lit(NULL_TS_KEY), first_known).otherwise(last_start)),
    })


def session_summary(events: DataFrame, *, gap_minutes: int = 30,
                    bucket_seconds: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """SS3/SS5 for gap sessions straight from the bucket summary.

    Sessions only start on a bucket's first row, so a session is a run of
    consecutive buckets: start/end/size come from per-bucket aggregates and
    no event row is shuffled at all (only the map-side pre-aggregated
    summary).  Same columns as ``sessions_table``.
    """
    gap_us, width = _gap_width(gap_minutes, bucket_seconds)
    summ = _bucket_summary(_with_bucket(events, width), gap_us)
    real_last = F.when(F.col("_lk") != F.lit(NULL_TS_KEY), F.col("_lk"))
    out = summ.groupBy("user_id", F.col("_sno").alias("session_no")).agg(
        F.min("_fkn").alias("_start"),
        F.max(real_last).alias("_end"),
        F.sum("_n").alias("n_events"),
    )
    return out.select(
        "user_id", "session_no",
        F.timestamp_micros(F.col("_start")).alias("start_ts"),
        F.timestamp_micros(F.col("_end")).alias("end_ts"),
        "n_events",
        F.concat(F.col("user_id"), F.lit("_s"), F.col("session_no").cast("string")).alias("session_id"),
    )


def _column_timeline(events: DataFrame, bucket_seconds: int) -> DataFrame:
    """SS2: run-based sessions from a session column (A,B,A -> three sessions)."""
    ev = _with_bucket(events, int(bucket_seconds) * 1_000_000)
    ev = ev.withColumn("_sv", F.coalesce(F.col("session_id").cast("string"), F.lit(""))).drop("session_id")
    w = Window.partitionBy("user_id", "bucket").orderBy("ts_key", "ord")
    ev = ev.withColumns({
        "_rn": F.row_number().over(w),
        "_pk": F.lag("ts_key").over(w),
        "_pn": F.lag("event_name").over(w),
        "_ps": F.lag("_sv").over(w),
    })
    ev = ev.withColumn("_ls", (F.col("_rn") > 1) & (F.col("_sv") != F.col("_ps")))
    ev = ev.withColumn("_lsc", F.sum(F.col("_ls").cast("long")).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    summ = ev.groupBy("user_id", "bucket").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max("ts_key").alias("_lk"),
        F.max_by("event_name", "_rn").alias("_lnm"),
        F.min_by("_sv", "_rn").alias("_fs"),
        F.max_by("_sv", "_rn").alias("_lsv"),
        F.sum(F.col("_ls").cast("long")).alias("_st"),
    )
    w2 = Window.partitionBy("user_id").orderBy("bucket")
    summ = summ.withColumns({
        "_plk": F.lag("_lk").over(w2),
        "_pln": F.lag("_lnm").over(w2),
        "_pls": F.lag("_lsv").over(w2),
        "_first": F.row_number().over(w2) == 1,
    })
    summ = summ.withColumn("_fst", F.col("_first") | (F.col("_fs") != F.col("_pls")))
    before = w2.rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.withColumns({
        "_so": F.coalesce(F.sum(F.col("_fst").cast("long") + F.col("_st")).over(before), F.lit(0)),
        "_po": F.coalesce(F.sum("_n").over(before), F.lit(0)),
    }).select("user_id", "bucket", "_plk", "_pln", "_fst", "_so", "_po")
    out = ev.join(summ, ["user_id", "bucket"], "inner")
    first = F.col("_rn") == 1
    out = out.withColumns({
        "pos": F.col("_po") + F.col("_rn"),
        "session_no": F.col("_so") + F.col("_fst").cast("long") + F.col("_lsc"),
        "is_start": F.when(first, F.col("_fst")).otherwise(F.col("_ls")),
        "prev_name": F.when(first, F.col("_pln")).otherwise(F.col("_pn")),
        "prev_ts_key": F.when(first, F.col("_plk")).otherwise(F.col("_pk")),
        "session_id": F.col("_sv"),
        "prev_start_key": F.lit(None).cast("long"),
    })
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def with_runs(tl: DataFrame, paths: str = "mixed") -> DataFrame:
    """Add ``run_no``: runs of identical consecutive names, never crossing sessions.

    A run starts on a session start or when the name differs from the previous
    event (``prev_name`` is already correct across bucket edges).  Single-window
    rows (``bucket`` null) number runs with a running sum per user; two-level
    rows sum run starts per bucket, take offsets from a window over the
    bucket totals and finish with an in-bucket running sum.
    """
    t = tl.withColumn("_r", (F.col("is_start") | ~F.col("event_name").eqNullSafe(F.col("prev_name"))).cast("long"))
    # (ts_key, ord) is the timeline's own order (pos follows it), so the run
    # windows reuse the existing sort instead of re-sorting by pos
    if paths == "single":
        wp = Window.partitionBy("user_id").orderBy("ts_key", "ord").rowsBetween(Window.unboundedPreceding, 0)
        return t.withColumn("run_no", F.sum("_r").over(wp)).drop("_r")
    # one formula for both kinds of rows: (user, null bucket) is a whole
    # ordinary user (no offset); hot buckets get offsets from their totals
    summ = t.where(F.col("bucket").isNotNull()).groupBy("user_id", "bucket").agg(F.sum("_r").alias("_rt"))
    w2 = Window.partitionBy("user_id").orderBy("bucket")
    summ = summ.select("user_id", "bucket", F.coalesce(
        F.sum("_rt").over(w2.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ro"))
    out = t.join(summ, ["user_id", "bucket"], "left")
    w = Window.partitionBy("user_id", "bucket").orderBy("ts_key", "ord").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("run_no", F.coalesce(F.col("_ro"), F.lit(0)) + F.sum("_r").over(w))
    return out.drop("_r", "_ro")


def sessions(events: DataFrame, *, gap_minutes: int = 30, by_column: bool = False,
             bucket_seconds: int = DEFAULT_BUCKET_SECONDS, hot_users=None) -> DataFrame:
    """One row per session: hot users from the bucket summary (no event-row
    shuffle), ordinary users from their single-window timeline."""
    if by_column:
        return sessions_table(timeline(events, by_column=True, bucket_seconds=bucket_seconds,
                                       hot_users=hot_users), by_column=True)
    if hot_users is None:
        return session_summary(events, gap_minutes=gap_minutes, bucket_seconds=bucket_seconds)
    if not hot_users:
        return sessions_table(_single_window(events, gap_minutes=gap_minutes, by_column=False))
    normal, hot = _split(events, hot_users)
    return sessions_table(_single_window(normal, gap_minutes=gap_minutes, by_column=False)).unionByName(
        session_summary(hot, gap_minutes=gap_minutes, bucket_seconds=bucket_seconds))


def detect_hot_users(events: DataFrame, min_events: int, *, max_users: int = 100_000,
                     seed: int = 17) -> list[str]:
    """Users whose history is too large for one window partition.

    Estimated from a deterministic Bernoulli sample (about 1000 expected hits
    for a user right at ``min_events``); at most ``max_users`` come back (the
    heaviest first), so the list is bounded and safe to broadcast.  A miss or
    a false hit only moves a user to the other (equally exact) path.
    """
    fraction = min(1.0, 1000.0 / max(min_events, 1))
    sampled = (events.where(F.col("user_id").isNotNull()).select("user_id")
               .sample(withReplacement=False, fraction=fraction, seed=seed)
               .groupBy("user_id").agg(F.count(F.lit(1)).alias("n")))
    hot = sampled.where(F.col("n") >= F.lit(min_events * fraction)).orderBy(F.col("n").desc()).limit(max_users)
    return [r["user_id"] for r in hot.collect()]


def sessions_table(tl: DataFrame, by_column: bool = False) -> DataFrame:
    """SS3/SS5: one row per session (start = first known time in it, D11).

    Only fixed-width aggregates (hash aggregation); the gap-mode session id is
    rebuilt from the keys, a column-mode id is constant per session so it is a
    grouping key rather than a (sort-based) string aggregate.
    """
    keys = ["user_id", "session_no"] + (["session_id"] if by_column else [])
    out = tl.groupBy(*keys).agg(
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.count(F.lit(1)).alias("n_events"),
    )
    if not by_column:
        out = out.withColumn("session_id", F.concat(F.col("user_id"), F.lit("_s"), F.col("session_no").cast("string")))
    return out
