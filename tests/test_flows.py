"""Flow / heatmap / composition analytics on the tiny fixture."""

from __future__ import annotations

from usertrail import Options, analyze
from usertrail.operators import flows as FL


def test_transitions_and_entries(spark, tiny):
    a = analyze(spark, tiny)
    tr = {(r["from_event"], r["to_event"]): r["n"] for r in FL.transitions(a.tl).collect()}
    assert tr[("page_viewed", "signup_clicked")] == 1
    assert ("welcome_viewed", "page_viewed") not in tr  # crosses a session boundary
    entries = {r["event_name"]: r["sessions"] for r in FL.entry_events(a.tl).collect()}
    assert entries == {"page_viewed": 5, "settings_opened": 1}


def test_next_event_step(spark, tiny):
    a = analyze(spark, tiny)
    got = {r["next_event"]: r["n"] for r in FL.next_event_step(a.tl, ["page_viewed", "search_submitted"]).collect()}
    assert got == {"result_clicked": 1}


def test_heatmap_and_composition(spark, tiny):
    a = analyze(spark, tiny)
    for fams in (None, a.families):
        hm = {(r["user_id"], r["day"]): (r["events"], r["dominant_family"])
              for r in FL.activity_heatmap(a.tl, families=fams).collect()}
        assert hm[("101", "2026-04-01")] == (5, "view")
        assert hm[("101", "2026-04-02")] == (2, "close")  # tie view/close -> alphabetical
    comp = {(r["user_id"], r["family"]): r["share"] for r in FL.composition(a.core_profiles).collect()}
    assert abs(comp[("103", "view")] - 0.75) < 1e-12
    idx = {(r["user_id"], r["family"]): r["index"] for r in FL.cohort_index(a.core_profiles).collect()}
    assert abs(idx[("103", "close")] - (0.25 / ((1 / 7 + 0.25) / 3))) < 1e-9


def test_timeline_cap(spark, tiny):
    a = analyze(spark, tiny)
    assert FL.timeline_cap(a.tl, 2).count() == 6


def test_a_prefix_longer_than_a_machine_word(spark):
    import datetime as dt

    t = dt.datetime(2026, 1, 1)
    rows = [("u", t + dt.timedelta(seconds=i), "a") for i in range(75)] + [("u", t + dt.timedelta(seconds=75), "end")]
    a = analyze(spark, spark.createDataFrame(rows, "user_id string, ts timestamp, event_name string"), Options(materialize=False))
    got = {r.next_event: r.n for r in FL.next_event_step(a.timeline(with_family=False), ["a"] * 70).collect()}
    assert got == {"a": 5, "end": 1}
