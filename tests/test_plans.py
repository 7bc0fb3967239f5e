"""Plan-shape guards: the scale properties the design relies on."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from usertrail import Options, analyze
from usertrail.operators import profiles as P


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def events(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # plan as for large data
    yield spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_profile_shuffles_event_rows_once(spark, events):
    a = analyze(spark, events, Options(order_by="event_id", materialize=False, skew="single"))
    plan = _plan(P.user_profile(a.tl, a.families))
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    # one exchange of event rows on user_id; the only other one is the name dimension
    assert sum(e.startswith("user_id") for e in exchanges) == 1, exchanges
    assert "SortAggregate" not in plan and "SinglePartition" not in plan
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_hot_users_in_one_plan(spark, events):
    a = analyze(spark, events, Options(order_by="event_id", materialize=False, skew="auto", hot_user_events=50))
    assert a.paths == "mixed"
    plan = _plan(a.timeline(with_family=False).select("user_id", "session_no", "pos", "value"))
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    wide = [e for e in exchanges if e.startswith("user_id") and "bucket" in e]
    # event rows: exactly one exchange keyed (user_id, bucket); the summary's
    # exchanges carry pre-aggregated rows (partial aggregation before them)
    assert "partial_count" in plan
    assert len(re.findall(r"FileScan parquet \[[^\]]*value", plan)) == 1
    assert wide


def test_sessions_for_hot_users_from_summary(spark, events):
    a = analyze(spark, events, Options(order_by="event_id", materialize=False, skew="bucketed"))
    plan = _plan(a.sessions)
    # no event-level window: only the bucket summary is windowed
    assert "partial_count" in plan and "row_number" in plan
    assert "lag(event_name" not in plan


def test_single_user_predicate_reaches_the_scan(spark, events):
    a = analyze(spark, events, Options(order_by="event_id", materialize=False))
    plan = _plan(a.for_user("7").sessions)
    assert "EqualTo(user_id,7)" in plan, plan
    assert a.for_user("7").core_profiles.first()["user_id"] == "7"


def test_bucketed_gold_tables_join_without_a_shuffle(spark, events):
    from usertrail.plans import queries as Q

    src = events.withColumn("plan", F.concat(F.lit("p"), F.col("user_id") % 5)).drop("value", "props")
    plain = analyze(spark, src, Options(order_by="event_id"))
    a = analyze(spark, src, Options(order_by="event_id", gold_buckets=4))
    wanted = lambda x: sorted(map(str, Q.list_users(x, limit=None).users.select("user_id", "events", "attrs", "power_score").collect()))
    assert wanted(a) == wanted(plain) and len(wanted(a)) == 150
    counts = a.user_event_counts.groupBy("user_id").agg(F.sum("count").alias("n"))
    for df in (a.profiles, a.profiles.join(a.power, "user_id"), Q.list_users(a).users, a.core_profiles.join(counts, "user_id")):
        plan = _plan(df)
        assert "Exchange hashpartitioning(user_id" not in plan and "SortMergeJoin" in plan, plan
    tables = list(a._cache["gold_tables"])
    assert all(spark.catalog.tableExists(t) for t in tables)
    a.release()
    assert not any(spark.catalog.tableExists(t) for t in tables)
