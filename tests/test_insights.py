"""Insights: recency, power score, longest gap, top families, stuck runs."""

from __future__ import annotations

from usertrail import Options, analyze
from usertrail.operators import insights as INS


def _map(df, key, val):
    return {r[key]: r[val] for r in df.collect()}


def test_power_score_tiny(spark, tiny):
    a = analyze(spark, tiny)
    assert _map(a.power, "user_id", "power_score") == {"101": 67, "102": 33, "103": 0}


def test_longest_gap_tiny(spark, tiny):
    a = analyze(spark, tiny)
    assert _map(INS.longest_gap(a.sessions, a.core_profiles), "user_id", "longest_gap_days") == \
        {"101": 1, "102": 1, "103": 0}


def test_recency_uses_as_of(spark):
    df = spark.createDataFrame([("u1", "2024-03-01 12:00:00", "x")], "user_id string, timestamp string, event_name string")
    a = analyze(spark, df)
    r = INS.recency(a.core_profiles, "2024-03-11").first()
    assert r["days_since_last"] == 10 and r["last_date"] == "2024-03-01"


def test_recency_unknown_time_is_minus_one(spark):
    df = spark.createDataFrame([("u1", "not a time", "x")], "user_id string, timestamp string, event_name string")
    a = analyze(spark, df)
    assert INS.recency(a.core_profiles, "2024-03-11").first()["days_since_last"] == -1


def test_top_families_ties_by_first_appearance(spark, tiny):
    a = analyze(spark, tiny)
    tf = [(r["rank"], r["family"], r["count"], r["pct"])
          for r in INS.top_families(a.core_profiles).where("user_id = '102'").orderBy("rank").collect()]
    # view 3; submit 2; then click/start/error/other tie at 1 -> click appears first
    assert tf == [(1, "view", 3, 33), (2, "submit", 2, 22), (3, "click", 1, 11)]


def test_family_first_seen(spark, tiny):
    a = analyze(spark, tiny)
    got = {(r["user_id"], r["family"]): r["first_seen"] for r in INS.family_first_seen(a.core_profiles).collect()}
    assert got[("101", "close")] == "2026-04-02 14:15"
    assert got[("102", "error")] == "2026-04-03 08:03"


def test_stuck_signals_thresholds(spark):
    rows = []
    minute = 0
    def add(name, n):
        nonlocal minute
        for _ in range(n):
            rows.append(("u1", f"2026-04-01 10:{minute:02d}:00", name))
            minute += 1
    add("search_clicked", 4)     # run of 4 -> signal
    add("page_viewed", 2)        # too short
    add("message_sent", 4)       # needs 5
    add("response_received", 5)  # exactly 5 -> signal
    add("search_clicked", 3)     # second run, shorter; max kept
    df = spark.createDataFrame(rows, "user_id string, timestamp string, event_name string")
    a = analyze(spark, df)
    got = [(r["event"], r["count"], r["rank"]) for r in INS.stuck_signals(a.tl).orderBy("rank").collect()]
    assert got == [("response_received", 5, 1), ("search_clicked", 4, 2)]


def test_runs_do_not_cross_sessions(spark):
    rows = [("u1", "2026-04-01 10:00:00", "a"), ("u1", "2026-04-01 10:01:00", "a"),
            ("u1", "2026-04-01 12:00:00", "a"), ("u1", "2026-04-01 12:01:00", "a")]
    df = spark.createDataFrame(rows, "user_id string, timestamp string, event_name string")
    a = analyze(spark, df, Options())
    assert INS.stuck_signals(a.tl).count() == 0
