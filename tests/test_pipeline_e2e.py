"""End-to-end goldens on the small fixtures (re-typed inline)."""

from __future__ import annotations

from pyspark.sql import functions as F

from usertrail import Options, analyze


def _by_user(df):
    return {r["user_id"]: r for r in df.collect()}


def test_tiny_counts_and_times(spark, tiny):
    a = analyze(spark, tiny)
    assert a.n_events == 20
    prof = _by_user(a.profiles)
    assert set(prof) == {"101", "102", "103"}
    assert [prof[u]["events"] for u in ("101", "102", "103")] == [7, 9, 4]
    assert prof["101"]["first_seen"] == "2026-04-01 09:00:00"
    assert prof["101"]["last_seen"] == "2026-04-02 14:15:12"
    assert [prof[u]["sessions"] for u in ("101", "102", "103")] == [3, 2, 1]


def test_tiny_family_counts(spark, tiny):
    prof = _by_user(analyze(spark, tiny).profiles)
    assert dict(prof["101"]["family_counts"]) == {"view": 4, "click": 1, "submit": 1, "close": 1}
    assert dict(prof["102"]["family_counts"]) == {
        "view": 3, "submit": 2, "click": 1, "start": 1, "error": 1, "other": 1}
    assert dict(prof["103"]["family_counts"]) == {"view": 3, "close": 1}


def test_tiny_session_sizes_and_order(spark, tiny):
    a = analyze(spark, tiny)
    sizes = {(r["user_id"], r["session_no"]): r["n_events"] for r in a.sessions.collect()}
    assert [sizes[("101", i)] for i in (1, 2, 3)] == [4, 1, 2]
    assert [sizes[("102", i)] for i in (1, 2)] == [4, 5]
    assert sizes[("103", 1)] == 4
    tl = a.tl.where(F.col("user_id") == "102").orderBy("pos").collect()
    assert tl[0]["event_name"] == "page_viewed" and tl[-1]["event_name"] == "checkout_completed"
    assert tl[0]["family"] == "view"


def test_aliased_columns_resolve(spark, aliased):
    a = analyze(spark, aliased)
    assert (a.schema.user_id, a.schema.timestamp, a.schema.event_name) == ("uid", "ts", "event")
    assert a.profiles.count() == 2 and a.n_events == 5


def test_with_attrs_detects_user_attributes(spark, with_attrs):
    a = analyze(spark, with_attrs)
    assert set(a.classification.attrs) == {"user_country", "user_plan"}
    prof = _by_user(a.profiles)
    assert dict(prof["201"]["attrs"]) == {"user_country": "PL", "user_plan": "premium"}
    assert dict(prof["202"]["attrs"]) == {"user_country": "UA", "user_plan": "free"}
    assert prof["201"]["sessions"] == 1 and prof["202"]["sessions"] == 2


def test_redaction(spark, with_attrs):
    a = analyze(spark, with_attrs, Options(redact=("user_country", "nonexistent")))
    prof = _by_user(a.profiles)
    assert prof["201"]["attrs"]["user_country"] == "<redacted>"
    assert prof["202"]["attrs"]["user_country"] == "<redacted>"
    assert prof["201"]["attrs"]["user_plan"] == "premium"


def test_timezone_changes_display_only(spark, tiny):
    utc = _by_user(analyze(spark, tiny).profiles)
    lis = _by_user(analyze(spark, tiny, Options(timezone="Europe/Lisbon")).profiles)
    same = _by_user(analyze(spark, tiny, Options(timezone="UTC")).profiles)
    assert lis["101"]["first_seen"] == "2026-04-01 10:00:00"  # UTC+1 in summer
    assert same["101"]["first_seen"] == utc["101"]["first_seen"]
    assert lis["101"]["sessions"] == utc["101"]["sessions"]


def test_null_user_rows_counted_not_profiled(spark):
    df = spark.createDataFrame(
        [("u1", "2026-04-01 10:00:00", "a_viewed"), (None, "2026-04-01 10:00:00", "a_viewed")],
        "user_id string, timestamp string, event_name string")
    a = analyze(spark, df)
    assert a.n_events == 2
    assert [r["user_id"] for r in a.profiles.collect()] == ["u1"]


def test_max_users_cap_is_lexicographic(spark):
    df = spark.createDataFrame(
        [(u, "2026-04-01 10:00:00", "x_viewed") for u in ("10", "2", "3", "1")],
        "user_id string, timestamp string, event_name string")
    a = analyze(spark, df, Options(max_users=2))
    assert sorted(r["user_id"] for r in a.profiles.collect()) == ["1", "10"]


MESSY = [
    ("u1", "2024-01-05T09:00:00", "page_viewed", "hello"),
    ("u1", "2024-01-05T09:02:00", "page_viewed", "hello"),
    ("u1", "2024-01-05T09:02:00", "page_viewed", "hello"),
    ("u1", "1704448800", "button_clicked", "world"),
    ("u2", "2024-01-06 14:30:00", "form_submitted", None),
    ("u2", "2024-01-06T14:31:00Z", "form_submitted", None),
    ("u2", "2024-01-06T14:35:00", "page_viewed", "ok"),
    ("u1", "2024-03-01T08:00:00", "page_viewed", None),
]


def test_messy_timestamps(spark):
    df = spark.createDataFrame(MESSY, "user_id string, timestamp string, event_name string, extra string")
    a = analyze(spark, df)
    summary = {r["null_ts_events"] for r in __import__("usertrail.operators.profiles", fromlist=["x"])
               .run_summary(a.events, a.core_profiles).collect()}
    assert summary == {1}  # the bare epoch string is not a timestamp
    prof = _by_user(a.core_profiles)
    assert (prof["u1"]["sessions"], prof["u2"]["sessions"]) == (2, 1)
    assert a.classification.props == ("extra",)
    assert prof["u2"]["first_seen"] == "2024-01-06 14:30:00"


def test_timeline_props_and_tz_display(spark):
    amounts = [1.5, None, 2.5, 1.5, 2.5, 1.5, 2.5, 1.5, 2.5, 1.5]
    tags = [None, "k", "j", "k", "j", "k", "j", "k", "j", "k"]
    rows = [("u1", f"2026-01-01 10:0{i}:00", "a_viewed", amounts[i], tags[i], "x") for i in range(10)]
    df = spark.createDataFrame(
        rows, "user_id string, timestamp string, event_name string, amount double, tag string, plan string")
    a = analyze(spark, df)
    assert a.classification.props == ("amount", "tag") and a.classification.attrs == ("plan",)
    tl = a.timeline(with_props=True).orderBy("pos").collect()
    assert dict(tl[0]["props"]) == {"amount": "1.5"} and dict(tl[1]["props"]) == {"tag": "k"}


def test_release_deletes_gold_tables(spark, tiny):
    import os

    a = analyze(spark, tiny)
    before = a.core_profiles.count()
    paths = list(a._cache["gold_paths"])
    assert paths and all(os.path.exists(p.replace("file:", "")) for p in paths)
    a.release()
    assert not any(os.path.exists(p.replace("file:", "")) for p in paths)
    assert a.core_profiles.count() == before  # recomputed on demand


def test_map_extras_and_default_order(spark):
    df = spark.createDataFrame(
        [("u1", "2026-01-01 10:00:00", "a_viewed", {"k": 1}), ("u1", "2026-01-01 10:00:00", "b_viewed", {"k": 2})],
        "user_id string, timestamp string, event_name string, m map<string,int>")
    a = analyze(spark, df)
    assert [r["event_name"] for r in a.tl.orderBy("pos").collect()] == ["a_viewed", "b_viewed"]


def test_varying_prefixed_attribute_takes_first_value_in_time(spark):
    rows = [("u1", "2026-01-01 10:05:00", "x_viewed", "late", "PL"),
            ("u1", "2026-01-01 10:06:00", "x_viewed", "late", "PL"),
            ("u1", "2026-01-01 10:07:00", "x_viewed", "late", "PL"),
            ("u1", "2026-01-01 10:00:00", "x_viewed", None, "PL"),
            ("u1", "2026-01-01 10:01:00", "x_viewed", "early", "PL")] + \
           [("u2", f"2026-01-01 10:0{i}:00", "x_viewed", "only", None) for i in range(5)]
    df = spark.createDataFrame(rows, "user_id string, timestamp string, event_name string, "
                                     "user_tier string, user_country string")
    a = analyze(spark, df)
    assert set(a.classification.attrs) == {"user_tier", "user_country"}
    assert not a.classification.constant_per_user["user_tier"]
    prof = _by_user(a.profiles)
    assert dict(prof["u1"]["attrs"]) == {"user_tier": "early", "user_country": "PL"}
    assert dict(prof["u2"]["attrs"]) == {"user_tier": "only"}
