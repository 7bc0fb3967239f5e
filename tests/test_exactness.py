"""Paths that must agree, and rows and columns that must survive."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from usertrail import Options, analyze
from usertrail.config import ensure_checkpoint_dir
from usertrail.operators import flows as FL
from usertrail.operators import insights as INS
from usertrail.operators.families import plan_families
from usertrail.operators.normalize import RESERVED, extra_column
from usertrail.operators.resolve import SchemaError
from usertrail.plans import queries as Q
from usertrail.streaming import live as L
from usertrail.streaming.store import ChangeLog

SCHEMA = "user_id string, ts timestamp, event_name string, n long"


def events(spark, seed, names=("a", "b", "c")):
    rng, rows = random.Random(seed), []
    for u in range(6):
        t = dt.datetime(1969, 12, 31, 18) + dt.timedelta(minutes=rng.randrange(300))
        for _ in range(rng.choice([1, 5, 40])):
            rows.append((f"u{u}", t, rng.choice(names), len(rows)))
            t += dt.timedelta(minutes=rng.choice([1, 5, 14, 15, 16, 20, 40]))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_skew_modes_agree_on_both_sides_of_the_epoch(spark, seed):
    ev, found = events(spark, seed, ("a", "b", None)), []
    for opts in (dict(skew="single"), dict(skew="bucketed"), dict(skew="auto", hot_user_events=6)):
        a = analyze(spark, ev, Options(session_gap_minutes=15, order_by="n", materialize=False, **opts))
        tl = a.timeline(with_family=False)
        found.append([sorted(map(str, df.collect())) for df in (
            tl.select("n", "pos", "session_no", "is_start", "prev_name"), a.sessions.select("session_id", "n_events"),
            INS.stuck_signals(tl, paths=a.paths), FL.transitions(tl), FL.next_event_step(tl, ["a", "b"]))])
    assert found[0] == found[1] == found[2]


def test_two_events_nineteen_minutes_apart_at_the_epoch(spark):
    rows = [("u", dt.datetime(1969, 12, 31, 23, 50), "a", 1), ("u", dt.datetime(1970, 1, 1, 0, 9), "a", 2)]
    for skew in ("single", "bucketed"):
        a = analyze(spark, spark.createDataFrame(rows, SCHEMA), Options(session_gap_minutes=15, order_by="n", skew=skew))
        assert a.sessions.count() == 2


def test_extras_with_the_librarys_names(spark):
    names = sorted(RESERVED - {"user_id", "ts", "event_name"}) + ["_id", "_ps", "extra__x"]
    ev = events(spark, 4).select("user_id", "ts", "event_name", "n", *[
        F.concat(F.lit(c), (F.col("n") % 5).cast("string")).alias(c) for c in names])
    for skew in ("single", "bucketed"):
        a = analyze(spark, ev, Options(order_by="n", skew=skew, materialize=False, use_session_column=False))
        got = a.timeline(with_props=True).select(extra_column("n"), F.col("props").alias("p")).collect()
        assert got
        for r in got:
            for c in names:
                assert c == "session_id" or r.p[c] == f"{c}{r.n % 5}"


def test_null_names_are_listed(spark):
    rows = [("u", dt.datetime(2026, 1, 1, 10, i), None, i) for i in range(4)]
    a = analyze(spark, spark.createDataFrame(rows, SCHEMA), Options(order_by="n"))
    assert [(r.event, r["count"]) for r in INS.stuck_signals(a.tl, paths=a.paths).collect()] == [("None", 4)]
    assert [(r.from_event, r.to_event, r.n) for r in FL.transitions(a.tl).collect()] == [("None", "None", 3)]
    assert [r.event_name for r in a.user_event_counts.collect()] == ["None"]


def test_redacted_roles(spark):
    ev = events(spark, 5)
    with pytest.raises(SchemaError, match="redact_key"):
        analyze(spark, ev, Options(order_by="n", redact=("user_id",))).events
    a = analyze(spark, ev, Options(order_by="n", redact=("user_id", "event_name"), redact_key=b"secret"))
    import hashlib
    import hmac

    want = {"redacted-" + hmac.new(b"secret", f"u{k}".encode(), hashlib.sha256).hexdigest()[:32] for k in range(6)}
    assert {r.user_id for r in a.core_profiles.collect()} == want
    got = a.core_profiles.collect()
    assert len(got) == 6 and all(r.user_id.startswith("redacted-") for r in got)
    assert {r["name"] for r in a.top_events().collect()} == {"<redacted>"}
    with pytest.raises(SchemaError, match="time"):
        analyze(spark, ev, Options(redact=("ts",))).events


def test_other_prefix_is_the_catch_all(spark):
    rows = [(f"{p}_x{k}",) for p in [f"p{i:02d}" for i in range(12)] + ["other"] for k in range(3)]
    plan = plan_families(spark.createDataFrame(rows, "event_name string"))
    assert len(plan.kept) == 12 and "other" not in plan.kept
    assert [r[0] for r in plan.registry_rows()].count("other") == 1


def test_empty_id_list_and_missing_ids(spark):
    a = analyze(spark, events(spark, 6), Options(order_by="n"))
    assert Q.export_subset(a, [])[0].count() == 6
    with pytest.raises(Q.MissingUsers) as e:
        Q.check_export(*Q.export_subset(a, [f"x{i}" for i in range(1500)]))
    assert e.value.count == 1500 and e.value.missing.count() == 1500
    with pytest.raises(Q.QueryError):
        Q.quick_report(a, {"plan": "none"})


def test_one_user_in_another_zone(spark):
    a = analyze(spark, events(spark, 7), Options(order_by="n", timezone="America/New_York"))
    one = Q.analyze_user(a, "u1", "1970-02-01")
    assert one.sessions.orderBy("session_no").first()["start"] == one.stats.first()["first_seen"]
    assert "props" in one.events.columns


def test_stream_times(spark, tmp_path):
    rows = [("u", "2026-01-01 10:00:00", "a"), ("u", "garbage", "b"), ("u", None, "c"), (None, "2026-01-01 10:00:00", "d")]
    spark.createDataFrame(rows, "user_id string, ts string, event_type string").write.json(str(tmp_path / "in"))
    stream = L.read_event_stream(spark, str(tmp_path / "in"), "user_id string, ts string, event_type string", "json")
    log = ChangeLog(spark, str(tmp_path / "log"))
    L.run_available_now(L.stream_user_counts(stream), checkpoint=str(tmp_path / "c"), output_mode="update", foreach_batch=log.writer())
    got = log.latest().collect()
    assert [(r.user_id, r.events) for r in got] == [("u", 3)]
    numbers = L.read_event_stream(spark, str(tmp_path / "in"), "user_id string, ts long, event_type string", "json")
    with pytest.raises(ValueError, match="epoch"):
        L.stream_user_counts(numbers)


class _Cluster:
    class conf:  # noqa: N801
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="share"):
        ensure_checkpoint_dir(_Cluster)
