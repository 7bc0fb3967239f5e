"""Flow, heatmap and composition analytics.

Transitions come from the timeline's ``prev_name`` (computed skew-safely), so
no query here needs a per-user window.  Multi-step prefixes (V9) meet in one
aggregation on ``(user_id, session, start)``: positions are dense per user, so
"the next row" is a key, and hash partitioning on it spreads a hot user.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usertrail.functions.text import named
from usertrail.functions.timefmt import local_date


def activity_heatmap(tl: DataFrame, event_name: str | None = None, tz: str | None = None,
                     families: Sequence[str] | None = None) -> DataFrame:
    """V1/V2: per user and day, event count and dominant family (ties alphabetical).

    With the (bounded, <= 13) family list the choice is a hash aggregate:
    ``count * 16 + (15 - alphabetical index)`` packs count and tie-break into
    one long, so ``max`` picks the winner.  Without it a ``min_by`` is used.
    """
    src = tl.where(F.col("event_name") == F.lit(event_name)) if event_name is not None else tl
    src = src.where(F.col("ts").isNotNull())
    per_fam = src.groupBy("user_id", local_date(F.col("ts"), tz).alias("day"), "family") \
        .agg(F.count(F.lit(1)).alias("n"))
    names = sorted(set(families)) if families is not None else None
    if names is not None and len(names) <= 15:
        index = F.create_map(*[x for i, f in enumerate(names) for x in (F.lit(f), F.lit(i))])
        packed = F.col("n") * 16 + (F.lit(15) - F.element_at(index, F.col("family")))
        best = per_fam.groupBy("user_id", "day").agg(F.sum("n").alias("events"), F.max(packed).alias("_p"))
        decode = F.element_at(F.array(*[F.lit(f) for f in names]), (F.lit(15) - F.col("_p") % 16 + 1).cast("int"))
        out = best.withColumn("dominant_family", decode)
    else:
        out = per_fam.groupBy("user_id", "day").agg(
            F.sum("n").alias("events"),
            F.min_by("family", F.struct((-F.col("n")).alias("neg_n"), F.col("family"))).alias("dominant_family"))
    return out.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "events", "dominant_family")


def transition_pairs(tl: DataFrame) -> DataFrame:
    """Consecutive (from, to) pairs inside one session."""
    return tl.where(~F.col("is_start")).select(
        "user_id", named(F.col("prev_name")).alias("from_event"), named(F.col("event_name")).alias("to_event"))


def transitions(tl: DataFrame, per_user: bool = False) -> DataFrame:
    """V3: transition counts, globally or per user."""
    keys = (["user_id"] if per_user else []) + ["from_event", "to_event"]
    return transition_pairs(tl).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def entry_events(tl: DataFrame) -> DataFrame:
    """V4: first event of each session, counted by name."""
    return tl.where(F.col("is_start")).groupBy(named(F.col("event_name")).alias("event_name")).agg(F.count(F.lit(1)).alias("sessions"))


def top_transition(tl: DataFrame, per_user: bool = True) -> DataFrame:
    """V5: the most frequent transition (ties by names), per user or overall."""
    t = transitions(tl, per_user=per_user)
    order = F.struct((-F.col("n")).alias("neg_n"), F.col("from_event"), F.col("to_event"))
    if not per_user:
        return t.orderBy(F.col("n").desc(), "from_event", "to_event").limit(1)
    best = t.groupBy("user_id").agg(F.min(order).alias("b"))
    return best.select("user_id", F.col("b.from_event").alias("from_event"),
                       F.col("b.to_event").alias("to_event"), (-F.col("b.neg_n")).alias("n"))


def path_diversity(tl: DataFrame) -> DataFrame:
    """V6: distinct transitions / all transitions, per user."""
    t = transitions(tl, per_user=True)
    return t.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("distinct_transitions"),
        F.sum("n").alias("transitions"),
    ).withColumn("diversity", F.col("distinct_transitions") / F.col("transitions"))


def next_event_step(tl: DataFrame, prefix: Sequence[str]) -> DataFrame:
    """V9: distribution of the event that follows ``prefix`` inside a session."""
    if not prefix:
        raise ValueError("prefix must name at least one event")
    # Every event reports, per step of the prefix that it matches, to the place
    # where such a prefix would begin, and as the follower to the place a whole
    # prefix before it.  Places are keys, so one exchange serves all steps.
    name, steps = named(F.col("event_name")), len(prefix)
    reports = [F.when(name == F.lit(step), F.struct((F.col("pos") - k).alias("start"), F.lit(1).alias("step"),
                                                    F.lit(None).cast("string").alias("next_event")))
               for k, step in enumerate(prefix)]
    reports.append(F.struct((F.col("pos") - steps).alias("start"), F.lit(0).alias("step"), name.alias("next_event")))
    told = tl.select("user_id", "session_no", F.inline(F.filter(F.array(*reports), F.isnotnull)))
    whole = told.groupBy("user_id", "session_no", "start").agg(
        F.sum("step").alias("steps"), F.max("next_event").alias("next_event"))
    whole = whole.where((F.col("steps") == steps) & F.col("next_event").isNotNull())
    return whole.groupBy("next_event").agg(F.count(F.lit(1)).alias("n"))


def composition(profiles: DataFrame) -> DataFrame:
    """V7: each family's share of the user's events."""
    out = profiles.select("user_id", "events", F.explode("family_counts").alias("family", "n"))
    return out.select("user_id", "family", "n", (F.col("n") / F.col("events")).alias("share"))


def cohort_index(profiles: DataFrame, n_users: int | None = None) -> DataFrame:
    """V8: user share / mean share over all users (absent family counts as 0).

    The per-family means are one row per family (at most 13), broadcast; the
    user count is one scalar.
    """
    comp = composition(profiles)
    n = n_users if n_users is not None else profiles.count()
    means = comp.groupBy("family").agg((F.sum("share") / F.lit(max(n, 1))).alias("mean_share"))
    return comp.join(F.broadcast(means), "family").select(
        "user_id", "family", "share", "mean_share", (F.col("share") / F.col("mean_share")).alias("index"))


def timeline_cap(tl: DataFrame, n: int = 500) -> DataFrame:
    """The first ``n`` events of every user (positions are global per user)."""
    return tl.where(F.col("pos") <= n)
