"""Streams give the batch tables, whatever the order of arrival, and account for every row."""

from __future__ import annotations

import json
import random
import re
import uuid
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from usertrail import Options, analyze
from usertrail.config import ensure_checkpoint_dir
from usertrail.streaming import live as L
from usertrail.streaming import stateful as S
from usertrail.streaming.store import ChangeLog, ProfileStore


def test_stream_sessions_match_batch(spark):
    base = ensure_checkpoint_dir(spark) + f"/t-{uuid.uuid4().hex}"
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(base + "/in")
    stream = L.read_event_stream(spark, base + "/in")
    out = L.stream_sessions(stream, gap_minutes=360, watermark="1 hour")
    L.run_available_now(out, checkpoint=base + "/ck", output_mode="append", sink_path=base + "/out")
    got = {(r["user_id"], r["first_ts"]): r["n_events"] for r in spark.read.parquet(base + "/out").collect()}

    a = analyze(spark, src, Options(order_by="event_id", session_gap_minutes=360))
    wm = src.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    closed = a.sessions.where(F.col("end_ts") + F.expr("INTERVAL 360 MINUTES") <= F.lit(wm) - F.expr("INTERVAL 1 HOUR"))
    want = {(r["user_id"], r["start_ts"]): r["n_events"] for r in closed.collect()}
    assert got == want and len(got) > 500


SCHEMA = "event_id long, ts timestamp, user_id string, sid string"
DAY = datetime(2026, 1, 1)


def _base(spark):
    return ensure_checkpoint_dir(spark) + f"/t-{uuid.uuid4().hex}"


def _rows(n=600, seed=5, users=("u", "v", "hot", None)):
    """Rows over four days, some without time, user or session value, with ties in time."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = DAY + timedelta(minutes=rng.randrange(4 * 1440)) if rng.random() > 0.05 else None
        user = "hot" if rng.random() < 0.5 else rng.choice(users)
        out.append((i, at, user, rng.choice(["A", "A", "B", None])))
    return out


def _land(spark, base, batches):
    """One file a batch, in this order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{base}/in/part={k}")
    return L.read_event_stream(spark, f"{base}/in/*", schema=SCHEMA, max_files_per_trigger=1)


def _column_sessions(rows):
    """event_id -> (session number, value), numbered user by user."""
    out = {}
    for user in {r[2] for r in rows} - {None}:
        own = sorted((r for r in rows if r[2] == user), key=lambda r: (r[1] is not None, r[1] or DAY, r[0]))
        number, last = 0, object()
        for i, _, _, sid in own:
            number += (sid or "") != last
            last = sid or ""
            out[i] = (number, last)
    return out


@pytest.mark.parametrize("watermark", ["1 hour", "30 days"])
def test_column_sessions_in_any_order(spark, watermark):
    base, rows = _base(spark), _rows()
    random.Random(1).shuffle(rows)
    batches = [rows[k::4] for k in range(4)]
    batches[3].append((9000, datetime(1960, 5, 5), "u", "C"))
    out = S.stream_column_runs(_land(spark, base, batches), watermark=watermark, bucket_seconds=3600)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with S.rocksdb_state(spark):
        L.run_available_now(out, checkpoint=base + "/ck", output_mode="append", sink_path=base + "/out")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    got = {r["ord"]: (r["session_no"], r["session_id"]) for r in S.column_sessions(spark, base + "/out", base + "/ck").collect()}
    assert got == _column_sessions([r for b in batches for r in b])
    kinds = {r["kind"] for r in S.column_rows(spark, base + "/out", base + "/ck").select("kind").distinct().collect()}
    assert kinds == ({"settled", "late", "open", "untimed"} if watermark == "1 hour" else {"open", "late", "untimed"})


def test_column_sessions_go_on_after_a_restart(spark):
    """Rows in order of time settle batch by batch; a second start goes on from the state."""
    base = _base(spark)
    rows = sorted((r for r in _rows(300) if r[1] and r[2]), key=lambda r: r[1])
    parts = [rows[:100], rows[100:200], rows[200:]]
    for k in (2, 3):
        for i, part in enumerate(parts[:k]):
            if k == 2 or i == 2:
                spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{base}/in/part={i}")
        stream = L.read_event_stream(spark, f"{base}/in/*", schema=SCHEMA, max_files_per_trigger=1)
        with S.rocksdb_state(spark):
            L.run_available_now(S.stream_column_runs(stream, watermark="0 seconds", bucket_seconds=3600), checkpoint=base + "/ck",
                                output_mode="append", sink_path=base + "/out")
        got = {r["ord"]: (r["session_no"], r["session_id"]) for r in S.column_sessions(spark, base + "/out", base + "/ck").collect()}
        assert got == _column_sessions([r for p in parts[:k] for r in p])


def test_a_hot_users_batch_is_many_frames():
    """A bucket's rows reach the state frame by frame, and a bucket is the most that is sorted at once."""
    import pandas as pd

    class List(list):
        def get(self):
            return iter(self)

        def appendList(self, rows):
            self.extend(rows)

    class Handle:
        def __init__(self):
            self.lists, self.timers = {}, []

        def getListState(self, name, schema):
            return self.lists.setdefault(name, List())

        def registerTimer(self, at):
            self.timers.append(at)

    class Now:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

    op, handle = S._Settler(1_000_000), Handle()
    op.init(handle)
    frames = [pd.DataFrame({"ts_key": [5, 3], "ord": [k, k], "sid": ["A", "B"]}) for k in range(10)]
    assert list(op.handleInputRows(("u", 0), iter(frames), Now(0))) == [] and handle.timers == [1000]
    out, = op.handleExpiredTimer(("u", 0), Now(1000), None)
    assert out["ts_key"].tolist() == [3] * 10 + [5] * 10 and out["run"].tolist() == [0] * 10 + [1] * 10
    assert handle.lists["rows"] == [] and list(op.handleExpiredTimer(("u", 0), Now(1000), None)) == []
    late, = op.handleInputRows(("u", 0), iter(frames[:1]), Now(1000))
    assert late["kind"].tolist() == ["late"] * 2 and handle.lists["rows"] == []


def _gap_sessions(rows, minutes):
    out = []
    for user in {r[2] for r in rows} - {None}:
        last = None
        for at in sorted(r[1] for r in rows if r[2] == user and r[1]):
            if last is None or at - last > timedelta(minutes=minutes):
                out.append([user, at, at, 0])
            out[-1][2], out[-1][3], last = at, out[-1][3] + 1, at
    return sorted(map(tuple, out))


def _sessions_of(frame):
    key = lambda c: F.timestamp_micros(c).alias(c)
    return sorted((r.user_id, r.start_key, r.end_key, r.n_events) for r in frame.select("user_id", key("start_key"), key("end_key"), "n_events").collect())


def test_gap_sessions_in_any_order(spark):
    base, rows = _base(spark), _rows()
    random.Random(2).shuffle(rows)
    stream = S.observed(_land(spark, base, [rows[k::4] for k in range(4)]), "ts")
    with S.rocksdb_state(spark):
        q = L.run_available_now(S.stream_gap_sessions(stream, gap_minutes=45, watermark="30 days"), checkpoint=base + "/ck",
                                output_mode="append", sink_path=base + "/out")
    assert S.observations(q) == {"rows": len(rows), "untimed": sum(r[1] is None for r in rows)}
    found = S.gap_sessions(spark, base + "/out", base + "/ck")
    assert _sessions_of(found.where("kind in ('open', 'closed')")) == _gap_sessions(rows, 45)
    by = {r["kind"]: r["n"] for r in found.groupBy("kind").agg(F.sum("n_events").alias("n")).collect()}
    assert by["untimed"] == sum(r[1] is None and r[2] is not None for r in rows) and "late" not in by


def test_gap_sessions_close_behind_the_watermark_and_count_late_rows(spark):
    base = _base(spark)
    rows = sorted((r for r in _rows(400) if r[1] and r[2]), key=lambda r: r[1])
    late = (7000, DAY - timedelta(days=3), "u", None)
    batches = [rows[:200], rows[200:], [late]]
    with S.rocksdb_state(spark):
        L.run_available_now(S.stream_gap_sessions(_land(spark, base, batches), watermark="2 hours"), checkpoint=base + "/ck",
                            output_mode="append", sink_path=base + "/out")
    found = S.gap_sessions(spark, base + "/out", base + "/ck").cache()
    assert _sessions_of(found.where("kind in ('open', 'closed')")) == _gap_sessions(rows, 30)
    by = {r["kind"]: r["n"] for r in found.groupBy("kind").agg(F.sum("n_events").alias("n")).collect()}
    assert by["late"] == 1 and by["closed"] > by["open"] > 0 and sum(by.values()) == len(rows) + 1
    limit = max(r[1] for r in rows) - timedelta(hours=2, minutes=30)
    ends = {k: [e for *_, e, _ in _sessions_of(found.where(F.col("kind") == k))] for k in ("open", "closed")}
    assert max(ends["closed"]) < limit <= min(ends["open"])


def test_streams_without_rows(spark):
    base = _base(spark)
    spark.createDataFrame([], SCHEMA).write.parquet(base + "/in")
    stream = L.read_event_stream(spark, base + "/in", schema=SCHEMA)
    with S.rocksdb_state(spark):
        L.run_available_now(S.stream_column_runs(stream), checkpoint=base + "/c", output_mode="append", sink_path=base + "/o")
        L.run_available_now(S.stream_gap_sessions(stream), checkpoint=base + "/c2", output_mode="append", sink_path=base + "/o2")
    assert S.column_sessions(spark, base + "/o", base + "/c").count() == 0
    assert S.gap_sessions(spark, base + "/o2", base + "/c2").count() == 0
    assert S.column_sessions(spark, base + "/never", base + "/never").count() == 0


def test_merged_stretches():
    got = S._merged([np.asarray([[10, 20, 2], [100, 100, 1]]), np.asarray([[21, 30, 1], [12, 50, 3]]), np.empty((0, 3), np.int64)], 5)
    assert got.tolist() == [[10, 50, 6], [100, 100, 1]]
    assert S._merged([np.asarray([[0, 0, 1], [5, 5, 1], [11, 11, 1]])], 5).tolist() == [[0, 5, 2], [11, 11, 1]]


class _FakeState:
    """A handle with lists and timers that counts the calls to it."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], [], 0

    def getListState(self, name, schema):
        return self

    def _called(self, rows):
        self.calls, self.rows = self.calls + 1, rows

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self._called(list(rows))

    def appendList(self, rows):
        self._called(self.rows + list(rows))

    def clear(self):
        self._called([])

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.now


def test_calls_to_the_gap_state_follow_groups_and_not_users():
    import pandas as pd

    state, op = _FakeState(), S._GapSessions(5_000)
    op.init(state)
    state.now = 0
    frames = [pd.DataFrame({"user_id": [f"u{k}" for k in range(100)], "start_key": 1000 * at, "end_key": 1000 * at, "n_events": 1})
              for at in (20, 3, 40, 5)]
    assert list(op.handleInputRows((0,), iter(frames), state)) == []
    assert state.calls <= 3 and len(state.rows) == 1 and state.timers == [11]
    state.now = 12
    closed, = op.handleExpiredTimer((0,), state, None)
    assert sorted(closed["user_id"]) == sorted(frames[0]["user_id"])
    assert set(closed[S._SPAN].itertuples(index=False, name=None)) == {(3000, 5000, 2)}
    assert len(S._unpacked(state.rows, S._OPEN)) == 200 and state.timers[-1] == 26


def test_stretches_of_all_users_of_a_batch_in_two_frames():
    import pandas as pd

    rng = random.Random(8)
    frame = pd.DataFrame([(f"u{rng.randrange(30)}", rng.randrange(1000) if rng.random() > 0.1 else S.NULL_TS_KEY) for _ in range(400)],
                         columns=["user_id", "ts_key"])
    known, untimed = list(S._stretches(7)(iter([frame])))
    want = []
    for user, at in frame[frame["ts_key"] != S.NULL_TS_KEY].groupby("user_id")["ts_key"]:
        at = at.to_numpy(np.int64)
        want += [(user, *r) for r in S._merged([np.column_stack([at, at, np.ones(len(at), np.int64)])], 7).tolist()]
    assert sorted(known.itertuples(index=False, name=None)) == sorted(want)
    none = frame[frame["ts_key"] == S.NULL_TS_KEY].groupby("user_id").size()
    assert dict(zip(untimed["user_id"], untimed["n_events"])) == none.to_dict() and set(untimed["start_key"]) == {S.NULL_TS_KEY}


def test_stretches_reach_the_state_as_one_row_a_group(monkeypatch):
    import pandas as pd
    import pyarrow as pa

    monkeypatch.setattr(S, "PIECE_BYTES", 1500)
    rng = random.Random(9)
    rows = [(f"u{k}", 10 * at, 10 * at, 1, k % 4) for k, at in ((rng.randrange(40), rng.randrange(10_000)) for _ in range(3000))]
    rows += [("u1", S.NULL_TS_KEY, S.NULL_TS_KEY, 5, 1)]
    frame = pd.DataFrame(rows, columns=[*S._OPEN.names, "user_group"])
    batches = [pa.RecordBatch.from_pandas(frame[at:at + 200], preserve_index=False) for at in range(0, len(frame), 200)]
    packed = pa.Table.from_batches(list(S._by_group(iter([batches[0][:0], *batches])))).to_pandas()
    assert packed["user_group"].tolist() == [0, 1, 2, 3] and list(S._by_group(iter([batches[0][:0]]))) == []
    for group, own in packed.groupby("user_group"):
        state, op = _FakeState(), S._GapSessions(30)
        op.init(state)
        state.now = 0
        untimed = list(op.handleInputRows((group,), iter([own, own]), state))  # each comes twice
        timed = frame[(frame["user_group"] == group) & (frame["start_key"] != S.NULL_TS_KEY)]
        want = S._merged_frames([timed, timed], 30)
        assert sorted(S._unpacked(state.rows, S._OPEN).itertuples(index=False)) == sorted(want.itertuples(index=False))
        assert [x["n_events"].tolist() for x in untimed] == ([[5], [5]] if group == 1 else [])


def test_streams_land_by_many_tasks_and_hold_a_state_store_a_core(spark):
    from usertrail.plans import stream_queries as Q

    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "23")
        base, stream = Q._landed(spark, spark.range(2000).select(F.col("id").alias("event_id")))
        assert len(spark.read.parquet(base + "/landing").inputFiles()) == 24
        query = L.run_available_now(stream, checkpoint=base + "/ck", output_mode="append", sink_path=base + "/out")
        assert [p["numInputRows"] > 0 for p in query.recentProgress] == [True] * 4
        assert spark.read.parquet(base + "/out").distinct().count() == 2000
        spark.conf.set(name, "500")
        cores = spark.sparkContext.defaultParallelism
        assert S.state_stores(spark, base + "/landing") == cores
        with S.rocksdb_state(spark, 3):
            assert spark.conf.get(name) == "3" and S.state_stores(spark, base + "/landing") == min(cores, 3)
        assert spark.conf.get(name) == "500"
    finally:
        spark.conf.set(name, before)


def test_a_group_of_users_settles_at_once_with_runs_of_each_users_own():
    import pandas as pd

    state, op = _FakeState(), S._Settler(1_000_000)
    op.init(state)
    state.now = 0
    rows = [("u", 1, 1, "A"), ("v", 1, 2, "A"), ("u", 2, 3, "B"), ("v", 9, 4, "A"), ("u", 3, 5, "A"), ("v", 9, None, "C")]
    frame = pd.DataFrame(rows, columns=["user_id", "ts_key", "ord", "sid"])
    assert list(op.handleInputRows((3, 0), iter([frame[:4], frame[4:]]), state)) == []
    assert state.calls <= 3 and len(state.rows) == 2 and state.timers == [1000]
    state.now = 1000
    out, = op.handleExpiredTimer((3, 0), state, None)
    assert [(r.user_id, r.bucket, r.ts_key, r.sid, r.run) for r in out.itertuples()] == [
        ("u", 0, 1, "A", 0), ("u", 0, 2, "B", 1), ("u", 0, 3, "A", 2), ("v", 0, 1, "A", 0), ("v", 0, 9, "C", 1), ("v", 0, 9, "A", 2)]


def test_changelog_is_compacted_and_retries_change_nothing(spark):
    log = ChangeLog(spark, _base(spark), fan_in=3)
    with pytest.raises(ValueError):
        log.latest()
    want, sizes = {}, []
    for b in range(30):
        rows = [(str(k), b) for k in range(b % 5, 12, 1 + b % 3)]
        want.update(rows)
        frame = spark.createDataFrame(rows, "user_id string, n long").coalesce(1)
        log.append(frame, b)
        if b % 7 == 0:
            before = log.manifest()
            log.append(frame.withColumn("n", F.lit(-1).cast("long")), b)  # a retry
            assert log.manifest() == before
        sizes.append(len(log.manifest()["runs"]))
    now = log.manifest()
    assert max(sizes) <= 2 * 4 and now["last"] == 29
    assert {r.user_id: r.n for r in log.latest().collect()} == want
    held = [n for n in log._folder.names() if n.startswith("run-")]
    assert set(held) == {n for n, _ in now["runs"]} | set(now["old"])
    # a crash after the new runs were written but before the manifest leaves the old version in force
    spark.createDataFrame([("0", 999)], "user_id string, n long").withColumn("batch_id", F.lit(30).cast("long")).write.parquet(
        f"{log.path}/run-{30:012d}-0")
    assert {r.user_id: r.n for r in log.latest().collect()} == want
    log.append(spark.createDataFrame([("0", 31)], "user_id string, n long"), 30)
    assert {r.user_id: r.n for r in log.latest().collect()} == {**want, "0": 31}
    # another writer got there first
    name = f"manifest/{log.manifest()['version'] + 1:012d}.json"
    assert log._folder.write_once(name, json.dumps({**log.manifest(), "version": log.manifest()["version"] + 1}))
    assert not log._folder.write_once(name, "{}")


def _files(scan):
    """The files that a scan has picked."""
    parts = scan.selectedPartitions().filePartitionIterator()
    out = []
    while parts.hasNext():
        out += re.findall(r"path=([^;,]+)", parts.next().files().mkString(" "))
    return out


def _profiles(frame):
    return {r.user_id: (r.events, r.sessions, r.first_ts, r.last_ts, r.longest_gap_days, tuple(sorted(r.family_counts.items())),
                        tuple(sorted(r.attrs.items()))) for r in frame.collect()}


def test_profile_store_touches_its_buckets_only(spark):
    schema = "event_id long, ts timestamp, user_id string, event_name string, plan string"
    rng = random.Random(3)
    plans = {f"user{k}": rng.choice(["free", "pro"]) for k in range(20)}
    rows = [(i, DAY + timedelta(minutes=rng.randrange(9000)) if rng.random() > 0.05 else None, u, rng.choice(["page_viewed", "form_submitted"]), plans[u])
            for i in range(400) for u in [rng.choice(list(plans))]]
    rows.append((999, DAY, None, "page_viewed", None))
    events = spark.createDataFrame(rows, schema)
    options = Options(order_by="event_id", user_id="user_id", timestamp="ts", event_name="event_name")
    a = analyze(spark, events, options)
    store = ProfileStore(_base(spark), options, a.family_plan, a.classification, buckets=8)
    for b in range(4):
        batch = spark.createDataFrame(rows[b::4], schema)
        store.write(batch, b)
        if b in (1, 3):
            store.write(batch, b)  # a retry
    assert _profiles(store.profiles(spark)) == _profiles(a.profiles)
    assert a.classification.attrs == ("plan",)
    # a batch of one user: only files of the bucket are read, and only its profiles are written
    before = {f for f in store.profiles(spark).inputFiles()}
    at = store.profiles(spark).where("user_id = 'user7'").first()["user_bucket"]
    scan = store.history(spark, [at])._jdf.queryExecution().executedPlan()
    while scan.children().size():
        scan = scan.children().head()
    assert "user_bucket" in scan.partitionFilters().toString()
    assert {p.split("/history/")[1].split("/")[0] for p in _files(scan)} == {f"user_bucket={at}"}
    extra = [(5000 + i, DAY + timedelta(days=40, minutes=i), "user7", "page_viewed", plans["user7"]) for i in range(3)]
    store.write(spark.createDataFrame(extra, schema), 4)
    after = {f for f in store.profiles(spark).inputFiles()}
    assert all(f"user_bucket={at}/" in f for f in before ^ after) and before ^ after
    again = analyze(spark, spark.createDataFrame(rows + extra, schema), options)
    again.__dict__["family_plan"], again.__dict__["classification"] = a.family_plan, a.classification
    assert _profiles(store.profiles(spark)) == _profiles(again.profiles)
    assert store.profile_of(spark, "user7").first()["events"] == sum(r[2] == "user7" for r in rows + extra)
    store.write(spark.createDataFrame([], schema), 5)
    store.write(spark.createDataFrame([(1, DAY, None, "x", None)], schema), 6)
    assert _profiles(store.profiles(spark)) == _profiles(again.profiles)
