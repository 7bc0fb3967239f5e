"""The tables of an analysis for Spark SQL (2.11): temporary views and table functions.

``register_views`` puts the lazy tables under their names, so that any query the
session can parse joins, filters and aggregates them; Catalyst sees through a
view, so filters and columns reach the scans.  The parameterised queries are SQL
table functions over those views, which are inlined like a view.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from usertrail.functions.text import named
from usertrail.operators import profiles as P
from usertrail.plans.pipeline import Analysis

#: name -> parameters, columns, body over the views
_FUNCTIONS = {
    "user_sessions": ("uid STRING", "session_id STRING, session_no BIGINT, start_ts TIMESTAMP, end_ts TIMESTAMP, n_events BIGINT",
                      "SELECT session_id, session_no, start_ts, end_ts, n_events FROM {sessions} WHERE user_id = uid"),
    "user_timeline": ("uid STRING", "session_no BIGINT, pos BIGINT, ts TIMESTAMP, event_name STRING, family STRING",
                      "SELECT session_no, pos, ts, event_name, family FROM {timeline} WHERE user_id = uid"),
    "users_with": ("key STRING, value STRING", "user_id STRING, events BIGINT, sessions BIGINT",
                   "SELECT p.user_id, p.events, p.sessions FROM {user_profile} p WHERE p.attrs[users_with.key] = users_with.value"),
    "users_by_event": ("pattern STRING, least BIGINT", "user_id STRING, occurrences BIGINT",
                       "SELECT user_id, sum(count) AS occurrences FROM {user_event_counts} "
                       "WHERE contains(lower(event_name), lower(pattern)) GROUP BY user_id HAVING sum(count) >= least"),
    "event_followers": ("name STRING", "event_name STRING, n BIGINT",
                        "SELECT event_name, count(*) AS n FROM {timeline} "
                        "WHERE prev_name = name AND NOT is_start GROUP BY event_name"),
}


def register_views(a: Analysis, prefix: str = "") -> dict[str, str]:
    """Register views and functions; name -> registered name (the name behind ``prefix``).

    Views: events, timeline, sessions, user_profile, user_attributes (key, value), power_scores,
    user_event_counts, top_events, event_families.  Registering again replaces them."""
    tl = a.tl.withColumns({"event_name": named(F.col("event_name")), "prev_name": F.col("prev_name")})
    tables = {
        "events": a.events.drop("ord"),
        "timeline": tl.select("user_id", "session_no", "session_id", "pos", "ts", "event_name", "family", "prev_name", "is_start"),
        "sessions": a.sessions,
        "user_profile": a.profiles.drop("family_stats"),
        "user_attributes": a.profiles.select("user_id", F.explode("attrs").alias("key", "value")),
        "power_scores": a.power,
        "user_event_counts": a.user_event_counts,
        "top_events": a.top_events(P.DEFAULT_TOP_EVENTS),
        "event_families": a.event_family_dim(),
    }
    names = {}
    for name, table in tables.items():
        names[name] = prefix + name
        table.createOrReplaceTempView(names[name])
    for name, (takes, gives, body) in _FUNCTIONS.items():
        names[name] = prefix + name
        body = body.replace(f"{name}.", f"{names[name]}.").format(**names)
        a.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {names[name]}({takes}) RETURNS TABLE({gives}) RETURN {body}")
    return names
