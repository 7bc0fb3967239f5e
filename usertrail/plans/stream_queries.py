"""Registered streaming queries.

Each one first lands the events as Parquet files (a parallel Spark write into
the shared checkpoint folder), then drives a Structured Streaming query over
them with ``availableNow`` and returns the tables it keeps as a batch DataFrame.
All but ``stream_sessions`` land events of which some have lost their time, dealt out by
hash, and read them in about four micro-batches: rows come in no order of time, and the result
must be the batch result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usertrail.config import ensure_checkpoint_dir, prepare
from usertrail.functions.timefmt import fmt_ts
from usertrail.plans import fixtures as FX
from usertrail.streaming import live as L
from usertrail.streaming import stateful as S
from usertrail.streaming.store import ChangeLog, ProfileStore

STREAM_BATCHES = 4
WATERMARK = "1 hour"
#: Longer than the tables span: no row of the shuffled batches comes too late.
ANY_ORDER = "3650 days"


def _base(spark: SparkSession) -> str:
    prepare(spark)
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/usertrail-stream-{uuid.uuid4().hex}"


def _landed(spark: SparkSession, events: DataFrame) -> tuple[str, DataFrame]:
    """Land the events in no order of time; a stream over them of about four micro-batches.

    A batch has its share of the shuffle partitions as files, which as many tasks write and read."""
    base = _base(spark)
    files = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // STREAM_BATCHES)
    events = events.repartition(STREAM_BATCHES * files, F.xxhash64("event_id"))
    events.write.parquet(base + "/landing")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    return base, L.read_event_stream(spark, base + "/landing", schema=schema, max_files_per_trigger=files)


def _untidy(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    return _landed(spark, FX.untidy_events(FX.raw_events(spark, sf)))


def q_stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    base = _base(spark)
    FX.raw_events(spark, sf).write.parquet(base + "/landing")
    # One batch over the landing zone: which sessions are closed then depends
    # only on the final watermark, not on the order files happen to be listed.
    out = L.stream_sessions(L.read_event_stream(spark, base + "/landing"), gap_minutes=30, watermark=WATERMARK)
    L.run_available_now(out, checkpoint=base + "/ckpt", output_mode="append", sink_path=base + "/out")
    res = spark.read.parquet(base + "/out")
    return res.select("user_id", fmt_ts(F.col("session_start")).alias("start"),
                      fmt_ts(F.col("session_end")).alias("end"), "n_events")


def _gap_sessions(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, int]]:
    base, stream = _untidy(spark, sf)
    out = S.stream_gap_sessions(S.observed(stream.where("user_id is not null"), "ts"), watermark=ANY_ORDER)
    with S.rocksdb_state(spark, S.state_stores(spark, base + "/landing")):
        query = L.run_available_now(out, checkpoint=base + "/ckpt", output_mode="append", sink_path=base + "/out")
    return S.gap_sessions(spark, base + "/out", base + "/ckpt"), S.observations(query)


def q_stream_sessions_all(spark: SparkSession, sf: str) -> DataFrame:
    """Closed and open sessions of a stream: those of a batch."""
    found, _ = _gap_sessions(spark, sf)
    return found.where("kind in ('closed', 'open')").select(
        "user_id", fmt_ts(F.timestamp_micros("start_key")).alias("start"), fmt_ts(F.timestamp_micros("end_key")).alias("end"),
        "n_events")


def q_stream_session_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Closed + open + side rows are all rows that the stream's own metrics have seen."""
    found, seen = _gap_sessions(spark, sf)

    def n(*kinds: str) -> F.Column:
        return F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("n_events"))), F.lit(0)).cast("long")

    return found.agg(F.lit(seen["rows"]).cast("long").alias("rows_in"), n("closed", "open").alias("in_sessions"),
                     n("untimed").alias("untimed"), n("late").alias("late"))


def _changes(spark: SparkSession, sf: str, aggregate) -> DataFrame:
    base, stream = _untidy(spark, sf)
    log = ChangeLog(spark, base + "/log", fan_in=2)
    L.run_available_now(aggregate(stream), checkpoint=base + "/ckpt", output_mode="update", foreach_batch=log.writer())
    return log.latest()


def q_stream_user_counts(spark: SparkSession, sf: str) -> DataFrame:
    res = _changes(spark, sf, L.stream_user_counts)
    return res.select("user_id", "events", fmt_ts(F.col("last_ts")).alias("last_seen"))


def q_stream_totals(spark: SparkSession, sf: str) -> DataFrame:
    return L.live_totals(_changes(spark, sf, L.stream_user_counts))


def _families(raw: DataFrame, **roles: str):
    from usertrail.operators.families import plan_families
    from usertrail.operators.normalize import normalize
    from usertrail.operators.resolve import resolve_schema

    return plan_families(normalize(raw, resolve_schema(raw, **roles).schema))


def q_stream_profile_refresh(spark: SparkSession, sf: str) -> DataFrame:
    prepare(spark)
    plan = _families(FX.raw_events(spark, sf))
    res = _changes(spark, sf, lambda stream: L.stream_profiles(stream, list(plan.kept), plan.family))
    return res.select("user_id", "events", fmt_ts(F.col("first_ts")).alias("first_seen"),
                      fmt_ts(F.col("last_ts")).alias("last_seen"),
                      F.explode("family_counts").alias("family", "count"))


def q_stream_profile_full(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles by user bucket, renewed over micro-batches in no order of time, with power scores."""
    from usertrail.plans.pipeline import Options

    base, stream = _untidy(spark, sf)
    options = Options(user_id="user_id", timestamp="ts", event_name="event_type", order_by="event_id")
    store = ProfileStore(base + "/store", options, _families(FX.raw_events(spark, sf)), buckets=8)
    L.run_available_now(stream, checkpoint=base + "/ckpt", output_mode="append", foreach_batch=store.write)
    power = store.power(spark).select("user_id", "power_score")
    return store.profiles(spark).join(power, "user_id").select(
        "user_id", "events", "sessions", "first_seen", "last_seen", "longest_gap_days", F.col("power_score").cast("long").alias("power_score"))


def q_stream_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes in the stream's profiles: those of the batch analysis."""
    from usertrail.plans.pipeline import Options, analyze

    prepare(spark)
    events = FX.customer_events(spark, sf)
    options = Options(user_id="user_id", timestamp="ts", event_name="event_name", order_by="event_id")
    a = analyze(spark, events, options)
    base, stream = _landed(spark, events)
    store = ProfileStore(base + "/store", options, a.family_plan, a.classification, buckets=8)
    L.run_available_now(stream, checkpoint=base + "/ckpt", output_mode="append", foreach_batch=store.write)
    return store.profiles(spark).select("user_id", F.explode("attrs").alias("key", "value"))


def q_stream_column_sessions(spark: SparkSession, sf: str) -> DataFrame:
    base, stream = _landed(spark, FX.untidy_events(FX.column_session_events(spark, sf)))
    out = S.stream_column_runs(stream, watermark="7 days", session_col="sid")
    with S.rocksdb_state(spark, S.state_stores(spark, base + "/landing")):
        L.run_available_now(out, checkpoint=base + "/ckpt", output_mode="append", sink_path=base + "/out")
    return S.column_sessions(spark, base + "/out", base + "/ckpt").withColumnRenamed("ord", "event_id")


STREAM_QUERIES = {name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_")}
