"""Query surface (Q1-Q9, N8-N10) over an ``Analysis``.

Every function returns DataFrames (plus, where the original returns scalar
totals, a one-row DataFrame of totals).  Top-k results use ``orderBy(...).limit``
which Spark plans as TakeOrderedAndProject (per-partition top-k, then merge).
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usertrail.functions.text import named
from usertrail.functions.timefmt import fmt_ts
from usertrail.operators import insights as INS
from usertrail.operators import profiles as P
from usertrail.operators.order_stats import median
from usertrail.plans.pipeline import Analysis

SORT_KEYS = {"events": "events", "sessions": "sessions", "first_seen": "first_seen", "last_seen": "last_seen"}


class QueryError(ValueError):
    """Raised for requests that cannot be answered (unknown user, empty set...)."""


def parse_filters(filters: str | Mapping[str, object] | None) -> dict[str, str]:
    """N8 input: a dict or JSON text. Blank/invalid JSON means no filter (D8:
    a JSON value that is not an object is an error)."""
    if filters is None:
        return {}
    if isinstance(filters, Mapping):
        return {str(k): str(v) for k, v in filters.items()}
    text = str(filters)
    if not text.strip():
        return {}
    try:
        parsed = json.loads(text)
    except json.JSONDecodeError:
        return {}
    if not isinstance(parsed, dict):
        raise QueryError(f"filters must be a JSON object, got {type(parsed).__name__}")
    return {str(k): str(v) for k, v in parsed.items()}


def attr_predicate(filters: Mapping[str, str]) -> Column:
    """AND of ``coalesce(attrs[k], '') == v`` (an empty value matches a missing attr)."""
    pred = F.lit(True)
    for k, v in filters.items():
        pred = pred & (F.coalesce(F.element_at(F.col("attrs"), F.lit(k)), F.lit("")) == F.lit(str(v)))
    return pred


def event_match(pattern: str) -> Column:
    """Case-insensitive literal substring test on the event name."""
    return F.lower(F.col("event_name")).contains(pattern.lower())


def _prof(a: Analysis, flt: Mapping[str, str]) -> DataFrame:
    """Profiles with attributes only when an attribute filter needs them."""
    return a.profiles if flt else a.core_profiles


def _order(sort_by: str) -> list[Column]:
    key = SORT_KEYS.get(sort_by, "events")
    primary = F.col(key).asc() if sort_by == "first_seen" else F.col(key).desc()
    return [primary, F.col("user_id").asc()]


# ---- Q1 / Q9 -----------------------------------------------------------------
@dataclass
class UserList:
    users: DataFrame
    totals: DataFrame  # total, filtered_total


def list_users(a: Analysis, limit: int | None = 50, sort_by: str = "events",
               filters: str | Mapping[str, object] | None = None) -> UserList:
    prof = a.profiles
    scored = prof.join(a.power.select("user_id", "power_score"), "user_id")
    flt = parse_filters(filters)
    chosen = scored.where(attr_predicate(flt)) if flt else scored
    ordered = chosen.orderBy(*_order(sort_by))
    page = ordered.limit(int(limit)) if limit is not None else ordered
    users = page.select("user_id", "events", "sessions", "first_seen", "last_seen", "attrs", "power_score")
    totals = prof.agg(F.count(F.lit(1)).alias("total"),
                      F.count_if(attr_predicate(flt)).alias("filtered_total"))
    return UserList(users, totals)


def profile_all_users(a: Analysis, sort_by: str = "events") -> DataFrame:
    """Every user (no limit)."""
    return list_users(a, limit=None, sort_by=sort_by).users


# ---- Q2 / Q3 -----------------------------------------------------------------
@dataclass
class UserAnalysis:
    stats: DataFrame
    insights: DataFrame
    top_families: DataFrame
    stuck_signals: DataFrame
    family_first_seen: DataFrame
    sessions: DataFrame
    events: DataFrame
    top_events: DataFrame


def analyze_user(a: Analysis, user_id: str, as_of) -> UserAnalysis:
    """Q2: one user's stats, insights, sessions and event ranking.

    Per-user parts run on ``a.for_user(uid)``: the predicate reaches the
    Parquet scan (row-group pruning) and only that user's rows are shuffled.
    The power score still ranks against all users (gold table).
    """
    uid = str(user_id)
    one = a.for_user(uid)
    if one.events.isEmpty():
        raise QueryError(f"no events of a user {uid!r}")
    tz = a.options.timezone
    prof = one.profiles
    tl = one.timeline(with_props=True)
    power = a.power.where(F.col("user_id") == uid).select("user_id", "power_score")
    rec = INS.recency(prof, as_of, tz)
    gap = one.longest_gap()
    insights = power.join(rec, "user_id").join(gap, "user_id")
    sessions = (one.sessions
                .select("session_no", "session_id",
                        fmt_ts(F.col("start_ts"), tz).alias("start"),
                        "n_events"))
    events = P.session_events(tl, tz)
    return UserAnalysis(
        stats=prof.select("user_id", "events", "sessions", "first_seen", "last_seen", "attrs"),
        insights=insights,
        top_families=INS.top_families(prof),
        stuck_signals=INS.stuck_signals(tl, paths=one.paths),
        family_first_seen=INS.family_first_seen(prof, tz),
        sessions=sessions,
        events=events,
        top_events=user_event_ranking(a, tl).drop("user_id").orderBy(
            F.col("count").desc(), F.col("first_pos").asc()).drop("first_pos"),
    )


def user_event_ranking(a: Analysis, tl: DataFrame | None = None) -> DataFrame:
    """Q3: (user, event, family, count) with the first time key of the shared gold
    table, or from a timeline the first position."""
    if tl is None:
        return a.user_event_counts
    return tl.groupBy("user_id", named(F.col("event_name")).alias("event_name"), "family").agg(
        F.count(F.lit(1)).alias("count"), F.min("pos").alias("first_pos"))


def user_top_events(a: Analysis, user_id: str | None = None) -> DataFrame:
    """V0 (per user): event counts with family and share of the user's events."""
    gold = a.user_event_counts
    if user_id is not None:
        gold = gold.where(F.col("user_id") == str(user_id))
    prof = a.core_profiles.select("user_id", "events")
    if user_id is not None:
        prof = prof.where(F.col("user_id") == str(user_id))
    pct = F.bround(F.col("count") * 100.0 / F.col("events"), 0).cast("int")
    return gold.join(prof, "user_id").select("user_id", "event_name", "family", "count", pct.alias("pct"))


# ---- Q4 ----------------------------------------------------------------------
def taxonomy(a: Analysis, n: int = 50) -> tuple[DataFrame, DataFrame]:
    """Q4: top events with pct of all user events; families; totals."""
    totals = a.core_profiles.agg(F.coalesce(F.sum("events"), F.lit(0)).alias("total_events"),
                                 F.count(F.lit(1)).alias("total_users"))
    total_events = totals.first()["total_events"]  # one scalar back to the driver
    pct = (F.bround(F.col("count") * 100.0 / F.lit(total_events), 0) if total_events
           else F.lit(0)).cast("int")
    return a.top_events(n).select("name", "count", "family", pct.alias("pct")), totals


def taxonomy_record(a: Analysis, n: int = 50) -> dict[str, DataFrame]:
    """Q4 in full: top events, totals, the schema's roles and the families with label and colours."""
    top, totals = taxonomy(a, n)
    record = a.meta(n)
    return {"top_events": top, "totals": totals, "schema": record["schema"], "families": record["families"]}


# ---- Q5 ----------------------------------------------------------------------
@dataclass
class Cohort:
    summary: DataFrame
    top_events: DataFrame
    family_distribution: DataFrame
    power_users: DataFrame


def cohort(a: Analysis, filters: str | Mapping[str, object] | None = None,
           top_events_n: int = 20, power_n: int = 10) -> Cohort:
    flt = parse_filters(filters)
    prof = _prof(a, flt)
    members = prof.where(attr_predicate(flt)) if flt else prof
    # one pass over the profiles: conditional aggregates instead of a join
    inside = attr_predicate(flt)
    summary = prof.agg(
        F.count(F.lit(1)).alias("total_users"),
        F.count_if(inside).alias("filtered_users"),
        F.coalesce(F.sum(F.when(inside, F.col("events"))), F.lit(0)).alias("total_events"),
        F.coalesce(F.avg(F.when(inside, F.col("events"))), F.lit(0.0)).alias("avg_events_per_user"),
    ).withColumn("median_sessions", F.lit(median(prof, F.when(inside, F.col("sessions"))) or 0.0))
    gold = user_event_ranking(a)
    if flt:
        gold = gold.join(members.select("user_id"), "user_id", "left_semi")
    top = (gold.groupBy("event_name").agg(F.sum("count").alias("count"))
           .orderBy(F.col("count").desc(), F.col("event_name").asc()).limit(top_events_n)
           .select(F.col("event_name").alias("name"), "count"))
    fams = gold.groupBy("family").agg(F.sum("count").alias("count"))
    power = (a.power.join(members.select("user_id"), "user_id", "left_semi")
             .orderBy(F.col("activity").desc(), F.col("user_id").asc()).limit(power_n)
             .select("user_id", "events", "sessions", "power_score"))
    return Cohort(summary, top, fams, power)


# ---- Q6 ----------------------------------------------------------------------
def find_users_by_event(a: Analysis, pattern: str, min_occurrences: int = 1,
                        limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """Q6: users with >= min matching events; returns (page, total_matched)."""
    # from the user x event gold table (every user has a row), not from events
    gold = a.user_event_counts
    occ = gold.groupBy("user_id").agg(
        F.coalesce(F.sum(F.when(event_match(pattern), F.col("count"))), F.lit(0)).alias("occurrences"))
    matched = occ.where(F.col("occurrences") >= int(min_occurrences))
    order = [F.col("occurrences").desc(), F.col("user_id").asc()]
    # only the page's users are looked up; every user of the gold table has a profile
    page = matched.orderBy(*order).limit(int(limit)).join(a.profiles.select("user_id", "attrs"), "user_id").orderBy(*order)
    total = matched.agg(F.count(F.lit(1)).alias("total_matched"))
    return page, total


# ---- Q7 / S10 ----------------------------------------------------------------
def export_subset(a: Analysis, user_ids: Sequence[str] | DataFrame | None = None,
                  filters: str | Mapping[str, object] | None = None) -> tuple[DataFrame, DataFrame]:
    """Q7: (selected profiles, missing requested ids).  The caller decides how
    to react to missing ids / an empty selection (see ``check_export``)."""
    flt = parse_filters(filters)
    prof = a.profiles
    chosen = prof.where(attr_predicate(flt)) if flt else prof
    spark = a.spark
    if user_ids is None or (not isinstance(user_ids, DataFrame) and not list(user_ids)):
        # no list, or an empty one: no restriction
        missing = spark.createDataFrame([], "user_id string")
        return chosen, missing
    req = (user_ids.select(F.col(user_ids.columns[0]).cast("string").alias("user_id"))
           if isinstance(user_ids, DataFrame)
           else spark.createDataFrame([(str(u),) for u in dict.fromkeys(user_ids)], "user_id string"))
    req = req.distinct()
    chosen = chosen.join(req, "user_id", "left_semi")
    missing = req.join(chosen.select("user_id"), "user_id", "left_anti")
    return chosen, missing


class MissingUsers(QueryError):
    """Requested ids without a user; ``missing`` is the table of all of them."""

    def __init__(self, count: int, first: str, missing: DataFrame):
        super().__init__(f"{count} requested id(s) have no events, the first is {first!r}; .missing has all")
        self.count, self.missing = count, missing


def check_export(chosen: DataFrame, missing: DataFrame) -> None:
    """Raise if an id is unknown or nobody is chosen (one row comes back)."""
    lacking = missing.agg(F.count(F.lit(1)).alias("n"), F.min("user_id").alias("first")).first()
    if lacking["n"]:
        raise MissingUsers(lacking["n"], lacking["first"], missing)
    if chosen.isEmpty():
        raise QueryError("the ids and filters leave no user to export")


def export_record(a: Analysis, path: str, user_ids: Sequence[str] | DataFrame | None = None,
                  filters: str | Mapping[str, object] | None = None) -> tuple[DataFrame, DataFrame]:
    """S10/Q7 in one call: check, write, and return (users_included, total_events) and the ids written."""
    from usertrail.sources.sinks import export_users

    chosen, missing = export_subset(a, user_ids, filters)
    check_export(chosen, missing)
    export_users(chosen, P.session_events(a.timeline(with_props=True), a.options.timezone), path)
    record = chosen.agg(F.count(F.lit(1)).alias("users_included"), F.coalesce(F.sum("events"), F.lit(0)).alias("total_events"))
    return record, chosen.select("user_id")


# ---- Q8 ----------------------------------------------------------------------
def quick_report(a: Analysis, filters: str | Mapping[str, object] | None = None,
                 n: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Q8: (top users by events, top events, totals) for the filtered users."""
    flt = parse_filters(filters)
    prof = _prof(a, flt)
    chosen = prof.where(attr_predicate(flt)) if flt else prof
    top_users = chosen.orderBy(F.col("events").desc(), F.col("user_id").asc()).limit(n) \
        .select("user_id", "events", "sessions")
    if chosen.isEmpty():
        raise QueryError("the filters leave no user to report on")
    gold = user_event_ranking(a)
    if flt:
        gold = gold.join(chosen.select("user_id"), "user_id", "left_semi")
    top_events = (gold.groupBy("event_name").agg(F.sum("count").alias("count"))
                  .orderBy(F.col("count").desc(), F.col("event_name").asc()).limit(n)
                  .select(F.col("event_name").alias("name"), "count"))
    totals = chosen.agg(F.count(F.lit(1)).alias("users_included"),
                        F.coalesce(F.sum("events"), F.lit(0)).alias("total_events"))
    return top_users, top_events, totals
