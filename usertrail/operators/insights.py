"""Per-user insights (I1-I7), all distributed.

``as_of`` is an explicit parameter: results never depend on the wall clock.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usertrail.constants import (
    STUCK_DEFAULT_MIN_RUN,
    STUCK_HIGH_EVENTS,
    STUCK_HIGH_MIN_RUN,
    STUCK_TOP_N,
    TOP_FAMILIES_N,
)
from usertrail.functions.text import named
from usertrail.functions.timefmt import fmt_minute, local_date
from usertrail.operators.ranking import percentile_score, with_ranks, top_n_per_key
from usertrail.operators.timeline import with_runs


def recency(profiles: DataFrame, as_of: _dt.date | str, tz: str | None = None) -> DataFrame:
    """Days since the last event; first/last seen dates ('' when unknown)."""
    as_of_col = F.lit(str(as_of)).cast("date")
    last_d = local_date(F.col("last_ts"), tz)
    first_d = local_date(F.col("first_ts"), tz)
    return profiles.select(
        "user_id",
        F.coalesce(F.datediff(as_of_col, last_d), F.lit(-1)).alias("days_since_last"),
        F.coalesce(F.date_format(first_d, "yyyy-MM-dd"), F.lit("")).alias("first_date"),
        F.coalesce(F.date_format(last_d, "yyyy-MM-dd"), F.lit("")).alias("last_date"),
    )


def longest_gap(sessions: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Max whole days between consecutive session starts (second precision).

    Session numbers are dense per user, so "previous session" is an equi-join
    on ``(user_id, session_no - 1)``: hash-partitioned on both keys, no
    per-user window, no hot partition.
    """
    s = sessions.select("user_id", "session_no",
                        F.unix_seconds(F.col("start_ts")).alias("sec"))
    p = s.select("user_id", (F.col("session_no") + 1).alias("session_no"), F.col("sec").alias("prev_sec"))
    gaps = s.join(p, ["user_id", "session_no"]).where(F.col("sec").isNotNull() & F.col("prev_sec").isNotNull())
    per_user = gaps.groupBy("user_id").agg(
        F.max(F.floor((F.col("sec") - F.col("prev_sec")) / 86400)).cast("long").alias("longest_gap_days"))
    base = (profiles.select("user_id") if profiles is not None
            else sessions.select("user_id").distinct())
    return base.join(per_user, "user_id", "left").select(
        "user_id", F.coalesce(F.col("longest_gap_days"), F.lit(0)).alias("longest_gap_days"))


def power_scores(profiles: DataFrame) -> DataFrame:
    """I4: percentile of events*sessions among all users (strictly lower share)."""
    scored = profiles.select("user_id", "events", "sessions",
                             (F.col("events") * F.col("sessions")).alias("activity"))
    return with_ranks(scored, "activity").select(
        "user_id", "events", "sessions", "activity",
        percentile_score(F.col("n_lower"), F.col("n_total")).alias("power_score"))


def top_families(profiles: DataFrame, n: int = TOP_FAMILIES_N) -> DataFrame:
    """The user's top families by count, ties by first appearance.

    Works on the per-user family array (at most 13 entries): no shuffle.
    """
    ranked = F.array_sort(
        F.col("family_stats"),
        lambda a, b: F.when(a["count"] > b["count"], F.lit(-1))
        .when(a["count"] < b["count"], F.lit(1))
        .when(a["first_pos"] < b["first_pos"], F.lit(-1))
        .when(a["first_pos"] > b["first_pos"], F.lit(1))
        .otherwise(F.lit(0)),
    )
    top = F.slice(ranked, 1, n)
    out = profiles.select("user_id", "events", F.posexplode(top).alias("i", "f"))
    return out.select(
        "user_id",
        (F.col("i") + 1).alias("rank"),
        F.col("f.family").alias("family"),
        F.col("f.count").alias("count"),
        F.when(F.col("events") > 0, F.bround(F.col("f.count") * 100.0 / F.col("events"), 0))
        .otherwise(F.lit(0)).cast("int").alias("pct"),
    )


def family_first_seen(profiles: DataFrame, tz: str | None = None) -> DataFrame:
    """I7 (true event time, D2): first time each family appears for the user."""
    out = profiles.select("user_id", F.explode("family_stats").alias("f"))
    return out.select("user_id", F.col("f.family").alias("family"),
                      fmt_minute(F.col("f.first_ts"), tz).alias("first_seen"))


def runs(tl: DataFrame) -> DataFrame:
    """Runs of identical consecutive names inside a session (map-side combined)."""
    # name and session are constant within a run: grouping keys, not string
    # aggregates, so the aggregation stays hash-based
    return tl.groupBy("user_id", "run_no", "event_name", "session_id").agg(
        F.min("pos").alias("start_pos"),
        F.count(F.lit(1)).alias("length"),
    )


def stuck_signals(tl: DataFrame, top_n: int = STUCK_TOP_N, paths: str = "mixed") -> DataFrame:
    """Longest run per (session, event) above threshold; top ``top_n`` per user.

    Ordered by run length desc, then first occurrence.  The per-user top-n is
    done in two stages (spread over sessions) so a hot user is not one window.
    """
    r = runs(with_runs(tl, paths))
    threshold = F.when(F.col("event_name").isin(*STUCK_HIGH_EVENTS), F.lit(STUCK_HIGH_MIN_RUN)) \
        .otherwise(F.lit(STUCK_DEFAULT_MIN_RUN))
    r = r.withColumn("event_name", named(F.col("event_name"))).where(F.col("length") >= threshold)
    best = r.groupBy("user_id", "session_id", "event_name").agg(
        F.max("length").alias("count"), F.min("start_pos").alias("first_pos"))
    top = top_n_per_key(best, "user_id", [F.col("count").desc(), F.col("first_pos").asc()], top_n,
                        spread="session_id")
    return top.select("user_id", "rank", F.col("session_id").alias("session"),
                      F.col("event_name").alias("event"), "count")
