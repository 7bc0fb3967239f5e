"""Sessionization: thresholds, ids, column sessions, and the skew-safe scan
checked against a brute-force per-user loop on randomized histories."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from usertrail import Options, analyze
from usertrail.operators.timeline import with_runs


def _events(spark, rows):
    return spark.createDataFrame(rows, "user_id string, timestamp string, event_name string")


def _sessions(spark, rows, gap=30, **kw):
    a = analyze(spark, _events(spark, rows), Options(session_gap_minutes=gap, **kw))
    return a


@pytest.mark.parametrize("gap", [1, 30, 45])
def test_only_more_than_the_gap_opens_a_session(spark, gap):
    """Pauses from a second to twice the gap, each counted by hand."""
    second = timedelta(seconds=1)
    pauses = [second, gap * 60 * second, gap * 60 * second + second, 90 * second, 2 * gap * 60 * second]
    at, rows = datetime(2025, 11, 30, 23, 50), []
    for k, pause in enumerate([timedelta(0), *pauses]):
        at += pause
        rows.append(("w", at.strftime("%Y-%m-%d %H:%M:%S"), f"step_{k}"))
    wanted, number = [1], 1
    for pause in pauses:
        number += pause > gap * 60 * second
        wanted.append(number)
    tl = _sessions(spark, rows, gap).tl.orderBy("pos").collect()
    assert [r["session_no"] for r in tl] == wanted
    assert [r["session_id"] for r in tl] == [f"w_s{n}" for n in wanted]


def test_clock_times_are_padded(spark):
    from usertrail.operators.profiles import session_events
    a = _sessions(spark, [("w", "2025-11-30 00:07:59", "lamp_lit"), ("w", "2025-11-30 23:00:00", "lamp_out")])
    assert [r["hhmm"] for r in session_events(a.tl).orderBy("pos").collect()] == ["00:07", "23:00"]


def test_null_timestamps_sort_first_and_do_not_open_sessions(spark):
    a = _sessions(spark, [("u1", None, "a"), ("u1", "bogus", "b"), ("u1", "2026-04-01 10:00:00", "c"),
                          ("u1", "2026-04-01 12:00:00", "d")])
    tl = a.tl.orderBy("pos").collect()
    assert [r["session_no"] for r in tl] == [1, 1, 1, 2]
    assert [r["is_start"] for r in tl] == [True, False, False, True]


def test_session_column_runs(spark):
    df = spark.createDataFrame(
        [("u1", f"2026-04-01 10:0{i}:00", "e", sid) for i, sid in enumerate(["A", "A", "B", "A", None])],
        "user_id string, timestamp string, event_name string, session_id string")
    a = analyze(spark, df)
    tl = a.tl.orderBy("pos").collect()
    assert [r["session_no"] for r in tl] == [1, 1, 2, 3, 4]
    assert [r["session_id"] for r in tl] == ["A", "A", "B", "A", ""]


def test_session_column_alias_is_honoured(spark):
    df = spark.createDataFrame(
        [("u1", "2026-04-01 10:00:00", "e", "x"), ("u1", "2026-04-01 10:01:00", "e", "y")],
        "user_id string, timestamp string, event_name string, sid string")
    a = analyze(spark, df)
    assert a.schema.session_id == "sid"
    assert a.sessions.count() == 2


# --- brute force -----------------------------------------------------------

def _brute(rows, gap_min):
    """Per-user loop: (user, idx) -> (session_no, pos, run_no, prev_name)."""
    out = {}
    by_user = {}
    for i, (u, ts, name) in enumerate(rows):
        by_user.setdefault(u, []).append((ts, i, name))
    for u, evs in by_user.items():
        evs.sort(key=lambda e: (e[0] is not None, e[0] or datetime.min, e[1]))
        sno, run, prev_ts, prev_name = 0, 0, None, None
        for pos, (ts, i, name) in enumerate(evs, 1):
            start = pos == 1 or (ts is not None and prev_ts is not None
                                 and (ts - prev_ts) > timedelta(minutes=gap_min))
            sno += start
            run += start or name != prev_name
            out[i] = (sno, pos, run, prev_name)
            prev_ts, prev_name = ts, name
    return out


@pytest.mark.parametrize("seed,gap,bucket,skew", [
    (1, 30, 900, "bucketed"), (2, 30, 60, "bucketed"), (3, 1440, 900, "bucketed"), (4, 5, 3600, "bucketed"),
    (5, 30, 900, "single"), (6, 30, 900, "auto"), (7, 1440, 600, "auto")])
def test_skew_safe_scan_matches_brute_force(spark, seed, gap, bucket, skew):
    rnd = random.Random(seed)
    base = datetime(2026, 1, 1)
    rows = []
    # one hot user spanning many buckets plus a few ordinary users
    for u, n in (("hot", 400), ("a", 30), ("b", 20), ("c", 1)):
        t = base
        for _ in range(n):
            t = t + timedelta(seconds=rnd.choice([0, 5, 60, 600, 1799, 1800, 1801, 7200, 90000]))
            ts = None if rnd.random() < 0.02 else t
            rows.append((u, ts, rnd.choice(["x", "y", "y", "z"])))
    data = [(i, u, ts, n) for i, (u, ts, n) in enumerate(rows)]
    df = spark.createDataFrame(data, "event_id long, user_id string, ts timestamp, event_name string")
    a = analyze(spark, df, Options(order_by="event_id", session_gap_minutes=gap, bucket_seconds=bucket,
                                   skew=skew, hot_user_events=100))
    if skew == "auto":
        assert a.hot_users == ["hot"] and a.paths == "mixed"
    got = {r["event_id"]: (r["session_no"], r["pos"], r["run_no"], r["prev_name"])
           for r in with_runs(a.timeline(with_family=False), a.paths).collect()}
    assert got == _brute(rows, gap)
    # the sessions table (bucket summary for hot users) agrees with the rows
    per_session = {}
    for (u, ts, _n), i in zip(rows, range(len(rows))):
        per_session.setdefault((u, got[i][0]), []).append(ts)
    sess = {(r["user_id"], r["session_no"]): r["n_events"] for r in a.sessions.collect()}
    assert sess == {k: len(v) for k, v in per_session.items()}
    # I3 from the profile: whole days between consecutive session starts
    # (first known time of each session, second precision)
    starts = {}
    for (u, sno), tss in per_session.items():
        known = [t for t in tss if t is not None]
        if known:
            starts.setdefault(u, []).append((sno, min(known)))
    want = {}
    for u in {r[0] for r in rows}:
        seq = [int(t.timestamp()) for _, t in sorted(starts.get(u, []))]
        want[u] = max([(b - a) // 86400 for a, b in zip(seq, seq[1:])], default=0)
    got_gap = {r["user_id"]: r["longest_gap_days"] for r in a.longest_gap().collect()}
    assert got_gap == want


def test_column_mode_matches_brute_force(spark):
    rnd = random.Random(7)
    base = datetime(2026, 1, 1)
    data, expect = [], {}
    t = base
    prev = None
    sno = 0
    for i in range(300):
        t = t + timedelta(seconds=rnd.choice([1, 100, 5000]))
        sid = rnd.choice(["s1", "s2"])
        sno += (i == 0) or sid != prev
        prev = sid
        data.append((i, "u", t, "e", sid))
        expect[i] = sno
    df = spark.createDataFrame(data, "event_id long, user_id string, ts timestamp, event_name string, session string")
    for skew in ("bucketed", "single"):
        a = analyze(spark, df, Options(order_by="event_id", bucket_seconds=600, skew=skew))
        got = {r["event_id"]: r["session_no"] for r in a.timeline(with_family=False).collect()}
        assert got == expect, skew


def test_single_big_exchange_of_events(spark):
    """Gap sessions shuffle event rows once; the bucket summary is pre-aggregated."""
    a = analyze(spark, spark.read.parquet("/root/testdata/sf0.001/events.parquet"),
                Options(order_by="event_id", skew="bucketed"))
    plan = a.timeline(with_family=False).select("user_id", "session_no", "pos")._jdf.queryExecution() \
        .executedPlan().toString()
    # summary side: partial aggregation happens before its exchange
    assert "partial_count" in plan and "partial_min" in plan
    assert F is not None


def test_hot_user_holding_a_third_of_rows(spark):
    """A third of all events reassigned to one user: every mode agrees."""
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    skewed = ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")))
    results = {}
    for skew in ("single", "bucketed", "auto"):
        a = analyze(spark, skewed, Options(order_by="event_id", skew=skew, hot_user_events=1000,
                                           materialize=False))
        if skew == "auto":
            assert a.hot_users == ["-1"]
        prof = {(r["user_id"], r["events"], r["sessions"]) for r in a.core_profiles.collect()}
        sess = {(r["user_id"], r["session_no"], r["n_events"]) for r in a.sessions.collect()}
        results[skew] = (prof, sess)
    assert results["single"] == results["bucketed"] == results["auto"]
    hot = [p for p in results["auto"][0] if p[0] == "-1"][0]
    assert hot[1] == ev.where(F.col("event_id") % 3 == 0).count()
