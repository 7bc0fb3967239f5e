"""Query surface (list / analyze / taxonomy / cohort / find / export / report)."""

from __future__ import annotations

import pytest

from usertrail import analyze
from usertrail.plans import queries as Q


@pytest.fixture
def a_tiny(spark, tiny):
    return analyze(spark, tiny)


@pytest.fixture
def a_attrs(spark, with_attrs):
    return analyze(spark, with_attrs)


def test_list_users_sorting(a_tiny):
    ids = lambda s: [r["user_id"] for r in Q.list_users(a_tiny, 50, s).users.collect()]
    assert ids("events") == ["102", "101", "103"]
    assert ids("sessions") == ["101", "102", "103"]
    assert ids("first_seen") == ["101", "102", "103"]
    assert ids("last_seen") == ["102", "103", "101"]
    assert ids("bogus") == ids("events")
    page = Q.list_users(a_tiny, 1, "events")
    assert page.users.count() == 1
    t = page.totals.first()
    assert (t["total"], t["filtered_total"]) == (3, 3)


def test_list_users_filters(a_attrs):
    res = Q.list_users(a_attrs, 50, "events", '{"user_country": "PL"}')
    assert [r["user_id"] for r in res.users.collect()] == ["201"]
    assert res.totals.first()["filtered_total"] == 1
    # blank / invalid JSON means no filter; empty value matches a missing attribute
    assert Q.list_users(a_attrs, 50, "events", "not json").users.count() == 2
    assert Q.list_users(a_attrs, 50, "events", '{"nope": ""}').users.count() == 2
    with pytest.raises(Q.QueryError):
        Q.parse_filters("[1, 2]")


def test_analyze_user(a_tiny):
    res = Q.analyze_user(a_tiny, "102", "2026-04-10")
    ins = res.insights.first()
    assert (ins["power_score"], ins["days_since_last"], ins["longest_gap_days"]) == (33, 7, 1)
    assert res.sessions.count() == 2
    top = [(r["event_name"], r["count"]) for r in res.top_events.collect()]
    assert top[0] == ("page_viewed", 2)
    with pytest.raises(Q.QueryError):
        Q.analyze_user(a_tiny, "nobody", "2026-04-10")


def test_taxonomy(a_tiny):
    top, totals = Q.taxonomy(a_tiny)
    t = totals.first()
    assert (t["total_events"], t["total_users"]) == (20, 3)
    first = top.orderBy(top["count"].desc(), "name").first()
    assert (first["name"], first["count"], first["family"], first["pct"]) == ("page_viewed", 6, "view", 30)


def test_cohort(a_attrs):
    c = Q.cohort(a_attrs, {"user_country": "UA"})
    s = c.summary.first()
    assert (s["total_users"], s["filtered_users"], s["total_events"]) == (2, 1, 4)
    assert s["median_sessions"] == 2.0
    assert [r["user_id"] for r in c.power_users.collect()] == ["202"]
    empty = Q.cohort(a_attrs, {"user_country": "XX"}).summary.first()
    assert (empty["filtered_users"], empty["total_events"], empty["avg_events_per_user"]) == (0, 0, 0.0)


def test_find_users_by_event(a_tiny):
    page, total = Q.find_users_by_event(a_tiny, "VIEWED", 2, 20)
    assert [(r["user_id"], r["occurrences"]) for r in page.collect()] == [("101", 3), ("102", 3), ("103", 2)]
    assert total.first()["total_matched"] == 3
    page0, _ = Q.find_users_by_event(a_tiny, "zzz", 0, 20)
    assert page0.count() == 3


def test_export_subset_and_missing(spark, a_tiny):
    chosen, missing = Q.export_subset(a_tiny, ["101", "999"])
    assert [r["user_id"] for r in chosen.collect()] == ["101"]
    assert [r["user_id"] for r in missing.collect()] == ["999"]
    with pytest.raises(Q.QueryError, match="999"):
        Q.check_export(chosen, missing)


def test_quick_report(a_tiny):
    users, events, totals = Q.quick_report(a_tiny)
    assert [r["user_id"] for r in users.collect()] == ["102", "101", "103"]
    assert events.first()["name"] == "page_viewed"
    assert totals.first()["total_events"] == 20


def test_for_user_view_matches_full_analysis(spark, a_tiny):
    full = {r["user_id"]: r for r in a_tiny.core_profiles.collect()}
    for uid in ("101", "102", "103"):
        one = a_tiny.for_user(uid).core_profiles.collect()
        assert len(one) == 1
        r = one[0]
        f = full[uid]
        assert (r["events"], r["sessions"], r["first_seen"], r["last_seen"], dict(r["family_counts"]),
                r["longest_gap_days"]) == (f["events"], f["sessions"], f["first_seen"], f["last_seen"],
                                           dict(f["family_counts"]), f["longest_gap_days"])
    assert a_tiny.for_user("nobody").core_profiles.count() == 0
