"""Per-user profiles and dataset totals.

``user_profile`` is ONE ``groupBy(user_id)`` over the timeline: counts, first
and last time, session count, per-family counts / first position / first
time (conditional aggregates over the bounded family list) and attribute
values.  Everything is map-side combinable, so a hot user is pre-aggregated
in every task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usertrail.constants import DEFAULT_TOP_EVENTS, OTHER_FAMILY
from usertrail.functions.timefmt import fmt_hhmm, fmt_ts
from usertrail.operators.classify import attrs_map, first_attr_value
from usertrail.operators.normalize import extra_column


def _fam_key(i: int) -> str:
    return f"_f{i}"


def user_profile(tl: DataFrame, families: Sequence[str], tz: str | None = None,
                 with_gap: bool = False) -> DataFrame:
    """U1/U2/U4 core (+ the per-family inputs of I5 and I7), no attributes.

    ``tl`` is the timeline with a ``family`` column.  ``families`` is the
    bounded list of possible family values (kept families + ``other``).
    All aggregates have fixed-width buffers, so Spark uses hash aggregation
    with map-side partial aggregation.  ``with_gap`` adds I3
    (``longest_gap_days``) from the timeline's ``prev_start_key`` -- whole
    days between consecutive session starts at second precision -- so the
    insight needs no join of the sessions table with itself.
    """
    fams = list(dict.fromkeys(list(families) + [OTHER_FAMILY]))
    aggs: list[Column] = [
        F.count(F.lit(1)).alias("events"),
        F.max("session_no").alias("sessions"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    ]
    for i, f in enumerate(fams):
        hit = F.col("family") == F.lit(f)
        aggs += [
            F.count_if(hit).alias(f"{_fam_key(i)}_n"),
            F.min(F.when(hit, F.col("pos"))).alias(f"{_fam_key(i)}_p"),
            F.min(F.when(hit, F.col("ts"))).alias(f"{_fam_key(i)}_t"),
        ]
    if with_gap:
        gap = F.floor((F.expr("ts_key div 1000000") - F.expr("prev_start_key div 1000000")) / 86400)
        aggs.append(F.max(gap).cast("long").alias("_gap"))
    g = tl.groupBy("user_id").agg(*aggs)

    stats = F.filter(
        F.array(*[
            F.struct(F.lit(f).alias("family"), F.col(f"{_fam_key(i)}_n").alias("count"),
                     F.col(f"{_fam_key(i)}_p").alias("first_pos"), F.col(f"{_fam_key(i)}_t").alias("first_ts"))
            for i, f in enumerate(fams)
        ]),
        lambda s: s["count"] > 0,
    )
    counts = F.map_from_entries(F.transform(stats, lambda s: F.struct(s["family"], s["count"])))
    return g.select(
        "user_id", "events", "sessions", "first_ts", "last_ts",
        fmt_ts(F.col("first_ts"), tz).alias("first_seen"),
        fmt_ts(F.col("last_ts"), tz).alias("last_seen"),
        counts.alias("family_counts"),
        stats.alias("family_stats"),
        *([F.coalesce(F.col("_gap"), F.lit(0)).alias("longest_gap_days")] if with_gap else []),
    )


def user_attributes(events: DataFrame, attrs: Sequence[str], constant: Sequence[str] = ()) -> DataFrame:
    """Per-user attribute map (first non-null value in time order).

    ``constant`` names attributes proven constant per user (C4): any non-null
    value is the first, so their values become *grouping keys* of a
    map-side hash aggregation ``(user, values...) -> count``; a second, small
    aggregation over those distinct combinations picks the non-null value.
    Only attributes that may vary (prefix-named) need the time-ordered
    ``min_by``, whose string buffer makes that (separate) aggregate
    sort-based.  Both sides end hash-partitioned on ``user_id``.
    """
    ev = events.where(F.col("user_id").isNotNull())
    const = [a for a in attrs if a in set(constant)]
    varying = [a for a in attrs if a not in set(constant)]
    values: dict[str, Column] = {}
    parts: list[DataFrame] = []
    if const:
        keys = [F.col(f"`{extra_column(a)}`").cast("string").alias(f"_c{j}") for j, a in enumerate(const)]
        combos = ev.groupBy("user_id", *keys).agg(F.count(F.lit(1)).alias("_n"))
        parts.append(combos.groupBy("user_id").agg(*[F.max(f"_c{j}").alias(f"_c{j}") for j in range(len(const))]))
        values.update({a: F.col(f"_c{j}") for j, a in enumerate(const)})
    if varying:
        parts.append(ev.groupBy("user_id").agg(
            *[first_attr_value(a).alias(f"_v{j}") for j, a in enumerate(varying)]))
        values.update({a: F.col(f"_v{j}") for j, a in enumerate(varying)})
    g = parts[0] if len(parts) == 1 else parts[0].join(parts[1], "user_id", "full")
    ordered = {a: values[a] for a in attrs}
    return g.select("user_id", attrs_map(ordered).alias("attrs"))


def with_attributes(core: DataFrame, attributes: DataFrame | None) -> DataFrame:
    if attributes is None:
        return core.withColumn("attrs", F.create_map().cast("map<string,string>"))
    return core.join(attributes, "user_id", "inner")


def cap_users(events: DataFrame, max_users: int | None) -> DataFrame:
    """Keep the first ``max_users`` users by string user id.

    They are the users up to the ``max_users``-th id, so the last of these ids is
    all that other rows are compared with: a scalar subquery, whatever the number
    of users, and no join before the session window.
    """
    if max_users is None:
        return events
    keep = (events.where(F.col("user_id").isNotNull()).select("user_id").distinct()
            .orderBy("user_id").limit(int(max_users)))
    return events.where(F.col("user_id") <= keep.agg(F.max("user_id")).scalar())


def top_events(events: DataFrame, family_of, n: int = DEFAULT_TOP_EVENTS) -> DataFrame:
    """Dataset top events by count (name asc breaks ties); null name -> 'None'."""
    counts = events.groupBy("event_name").agg(F.count(F.lit(1)).alias("count"))
    named = counts.select(
        F.coalesce(F.col("event_name"), F.lit("None")).alias("name"),
        "count",
        family_of(F.col("event_name")).alias("family"),
    )
    return named.orderBy(F.col("count").desc(), F.col("name").asc()).limit(n)


def flat_timeline(tl: DataFrame, tz: str | None = None) -> DataFrame:
    """U5 (long form): one row per event with its user position and time."""
    return tl.select("user_id", "pos", fmt_ts(F.col("ts"), tz).alias("time"), "event_name")


def session_events(tl: DataFrame, tz: str | None = None) -> DataFrame:
    """SS4 (long form): event rows with session, clock time, family, properties."""
    cols = ["user_id", "session_no", "session_id", "pos",
            fmt_hhmm(F.col("ts"), tz).alias("hhmm"), "event_name", "family"]
    if "props" in tl.columns:
        cols.append("props")
    return tl.select(*cols)


def run_summary(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Totals. Events count every row (null users too); users/sessions the profiles.

    Two one-row aggregates computed as scalars and returned as one row.
    """
    ev = events.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("user_id").isNull()).alias("null_user_events"),
        F.count_if(F.col("ts").isNull()).alias("null_ts_events"),
    ).first()
    pr = profiles.agg(F.count(F.lit(1)).alias("users"),
                      F.coalesce(F.sum("sessions"), F.lit(0)).alias("sessions")).first()
    return events.sparkSession.createDataFrame(
        [(ev["events"], ev["null_user_events"], ev["null_ts_events"], pr["users"], pr["sessions"])],
        "events long, null_user_events long, null_ts_events long, users long, sessions long")
