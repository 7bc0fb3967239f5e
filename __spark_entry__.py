"""

Every query reads the driver tables (``events``, ``customer``) or data Spark
derives from them (see ``usertrail/plans/fixtures.py``), at full size.  Each
``oracle_sql`` entry is an independent DuckDB formulation over the same
parquet views; column names and integer types match the Spark side.
"""

from __future__ import annotations

import functools
import os
import sys
import uuid
from collections.abc import Callable

# the package lives next to this file; make it importable however this file is loaded
_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usertrail import Options, analyze
from usertrail.config import ensure_checkpoint_dir, prepare
from usertrail.functions.timefmt import fmt_ts
from usertrail.operators import flows as FL
from usertrail.operators import insights as INS
from usertrail.operators import profiles as P
from usertrail.operators.classify import attribute_domain, props_map
from usertrail.operators.resolve import resolve_schema
from usertrail.plans import fixtures as FX
from usertrail.plans import queries as Q
from usertrail.plans.sql import register_views
from usertrail.sources.reader import read_events, read_parts
from usertrail.sources.sinks import write_profiles

AS_OF = "2024-03-01"
COHORT = {"c_mktsegment": "BUILDING"}
TZ = "America/New_York"

# --------------------------------------------------------------------------- helpers

_ANALYSES: dict = {}


def _norm(df: DataFrame) -> DataFrame:
    """Integral columns as BIGINT so the schema matches the oracle's."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _an(spark: SparkSession, sf: str, variant: str = "named", gap: int = 30, **opts):
    """Cached Analysis per (session, input, variant, gap, options)."""
    # the application's id: another session may get the same id() after this one has stopped
    key = (spark.sparkContext.applicationId, sf, variant, gap, tuple(sorted(opts.items())))
    if key not in _ANALYSES:
        prepare(spark)
        src = {
            "raw": FX.raw_events, "named": FX.named_events, "overflow": FX.overflow_events,
            "customer": FX.customer_events,
        }[variant](spark, sf)
        over = dict(user_id="user_id", timestamp="ts", order_by="event_id")
        if variant != "raw":
            over["event_name"] = "event_name"
        _ANALYSES[key] = analyze(spark, src, Options(session_gap_minutes=gap, **over, **opts))
    return _ANALYSES[key]


def _scratch(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark)
    if "://" not in base and not base.startswith("/"):
        base = os.path.abspath(base)
    return base.rstrip("/") + f"/usertrail-{name}-{uuid.uuid4().hex}"


# --------------------------------------------------------------------------- entry

def entry(spark: SparkSession) -> DataFrame:
    """Flagship: list users (by events) with power score on sf0.001."""
    return q_list_users_by_events(spark, "/root/testdata/sf0.001")


# --------------------------------------------------------------------------- N / R

def q_normalize_events(spark, sf):
    a = _an(spark, sf, "raw")
    return _norm(a.events.select("user_id", "event_id", fmt_ts(F.col("ts")).alias("ts"), "event_name"))


def _epoch(spark, sf, unit):
    src = FX.epoch_events(spark, sf, unit)
    a = analyze(spark, src, Options(user_id="user_id", timestamp="t_epoch", event_name="event_type",
                                    order_by="event_id"))
    return _norm(a.events.select("user_id", "event_id", fmt_ts(F.col("ts")).alias("ts")))


def q_normalize_epoch_ms(spark, sf):
    return _epoch(spark, sf, "ms")


def q_normalize_epoch_s(spark, sf):
    return _epoch(spark, sf, "s")


def q_display_timezone(spark, sf):
    a = _an(spark, sf, "named", timezone=TZ)
    return _norm(a.core_profiles.select("user_id", "first_seen", "last_seen"))


def q_resolve_schema_alias(spark, sf):
    """Roles found by header names, with the number of values read through each column."""
    raw = FX.raw_events(spark, sf)
    roles = {role: col for role, col, _ in resolve_schema(raw).notes}
    counts = raw.agg(*[F.count(F.col(f"`{c}`")).alias(r) for r, c in roles.items()])
    rows = [F.struct(F.lit(r).alias("role"), F.lit(c).alias("column"), F.col(r).alias("n_values")) for r, c in roles.items()]
    return _norm(counts.select(F.inline(F.array(*rows))))


def q_resolve_schema_sniff(spark, sf):
    raw = FX.raw_events(spark, sf).toDF("c0", "c1", "c2", "c3", "c4", "c5")
    s = resolve_schema(raw)
    return spark.createDataFrame([(r, c) for r, c, _ in s.notes], "role string, column string")


def q_resolve_schema_repeated(spark, sf):
    """Roles by content do not depend on how often rows repeat."""
    raw = FX.repeated_events(spark, sf).drop("event_id").toDF("c1", "c2", "c3", "c4", "c5")
    return spark.createDataFrame([(r, c) for r, c, _ in resolve_schema(raw).notes], "role string, column string")


# --------------------------------------------------------------------------- S (round trips)

def _round_trip(spark, sf, fmt):
    path = _scratch(spark, fmt.strip("."))
    ev = FX.raw_events(spark, sf).select("event_id", F.col("ts").cast("string").alias("ts"),
                                         "user_id", "event_type")
    if fmt in (".csv", ".tsv"):
        ev.write.option("header", "true").option("sep", "\t" if fmt == ".tsv" else ",").csv(path + fmt)
    elif fmt == ".jsonl":
        ev.write.json(path + fmt)
    if fmt == ".json":  # array-of-objects documents of a bounded number of rows
        docs = (ev.withColumn("doc", F.expr("event_id div 5000")).groupBy("doc")
                .agg(F.to_json(F.collect_list(F.struct(*ev.columns))).alias("v")))
        docs.select("v").write.option("maxRecordsPerFile", 1).text(path + "-doc.json")
        src = path + "-doc.json"
    else:
        src = path + fmt
    a = analyze(spark, read_events(spark, src), Options(order_by="event_id"))
    return _norm(a.profiles_without_attrs().select("user_id", "events", "sessions", "first_seen", "last_seen"))


def q_read_json_ranges(spark, sf):
    """One array in one file, read in byte ranges by many tasks."""
    path, name = _scratch(spark, "array"), "spark.sql.files.maxPartitionBytes"
    docs = FX.raw_events(spark, sf).select("event_id", F.col("ts").cast("string").alias("ts"), "user_id", "event_type", "props")
    # the array's text, written by Spark as one file: an object a row, with commas between and brackets around
    last = docs.agg(F.max("event_id")).first()[0]
    sign = F.when(F.col("event_id") == last, "]").otherwise(",")
    # objects become text in many tasks; the one that writes the file only puts signs between them
    (docs.select("event_id", F.to_json(F.struct(*docs.columns)).alias("object")).orderBy("event_id").coalesce(1)
     .select(F.concat(F.when(F.monotonically_increasing_id() == 0, "[").otherwise(""), "object", sign).alias("value"))
     .write.option("lineSep", " ").text(path + ".json"))
    before = spark.conf.get(name)
    spark.conf.set(name, "64k")
    try:
        events = read_events(spark, path + ".json")
    finally:
        spark.conf.set(name, before)
    return _norm(events.select("event_id", "ts", "user_id", "event_type", "props"))


def q_read_parquet(spark, sf):
    path = _scratch(spark, "parquet") + ".parquet"
    FX.raw_events(spark, sf).select("event_id", "ts", "user_id", "event_type").write.parquet(path)
    a = analyze(spark, path, Options(order_by="event_id"))
    return _norm(a.profiles_without_attrs().select("user_id", "events", "sessions", "first_seen", "last_seen"))


def q_read_parts(spark, sf):
    """Two parts whose columns stand in another order, united by name."""
    base, ev = _scratch(spark, "parts"), FX.raw_events(spark, sf)
    ev.where("event_id % 2 = 0").select("event_id", "ts", "user_id", "event_type").write.parquet(base + "-a.parquet")
    ev.where("event_id % 2 = 1").select("event_type", "user_id", "value", "ts", "event_id").write.parquet(base + "-b.parquet")
    a = analyze(spark, read_parts(spark, [base + "-a.parquet", base + "-b.parquet"]), Options(order_by="event_id"))
    return _norm(a.profiles_without_attrs().select("user_id", "events", "sessions", "first_seen", "last_seen"))


def q_write_profiles(spark, sf):
    """The all-user sink, read back."""
    path = _scratch(spark, "profiles")
    write_profiles(_an(spark, sf, "customer").profiles, path)
    back = spark.read.schema("user_id string, events long, sessions long, first_seen string, last_seen string").json(path)
    return _norm(back)


def q_write_profiles_maps(spark, sf):
    """The maps of the all-user sink, read back: a row an entry."""
    path = _scratch(spark, "profiles")
    write_profiles(_an(spark, sf, "customer").profiles, path, fmt="parquet")
    back = spark.read.parquet(path)
    families = back.select("user_id", F.lit("family").alias("kind"), F.explode("family_counts").alias("key", "value"))
    attributes = back.select("user_id", F.lit("attribute").alias("kind"), F.explode("attrs").alias("key", "value"))
    return families.withColumn("value", F.col("value").cast("string")).unionByName(attributes)


def q_export_record(spark, sf):
    """Checked export: the totals that it returns."""
    ids = FX.table(spark, sf, "customer").where("c_nationkey = 7").select("c_custkey").join(
        FX.raw_events(spark, sf).select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_semi")
    return _norm(Q.export_record(_an(spark, sf, "customer"), _scratch(spark, "export"), ids)[0])


def q_export_events(spark, sf):
    """Checked export: the event rows that it writes, read back."""
    path = _scratch(spark, "export")
    ids = FX.table(spark, sf, "customer").where("c_nationkey = 7").select("c_custkey").join(
        FX.raw_events(spark, sf).select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_semi")
    Q.export_record(_an(spark, sf, "customer"), path, ids)
    back = spark.read.schema("user_id string, session_id string, pos long, hhmm string, event_name string, family string").json(
        path + "/events")
    return _norm(back)


def q_export_properties(spark, sf):
    """The property maps of the exported event rows, read back."""
    path = _scratch(spark, "export")
    ids = FX.table(spark, sf, "customer").where("c_nationkey = 7").select("c_custkey").join(
        FX.raw_events(spark, sf).select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_semi")
    Q.export_record(_an(spark, sf, "customer"), path, ids)
    back = spark.read.schema("user_id string, pos long, props map<string,string>").json(path + "/events")
    return back.select("user_id", "pos", F.explode("props").alias("key", "value")).where("key in ('props', 'c_name')")


def q_taxonomy_record(spark, sf):
    """Families of the taxonomy record with the events and names that they cover, by its own list of all names."""
    record = Q.taxonomy_record(_an(spark, sf, "named"), n=1_000_000)
    top = record["top_events"].groupBy("family").agg(F.sum("count").alias("events"), F.count(F.lit(1)).alias("names"))
    return _norm(record["families"].select("family").join(top, "family"))


def q_meta_attributes(spark, sf):
    """The attribute part of the meta record."""
    return _an(spark, sf, "customer").meta()["attributes"]


def q_missing_role(spark, sf):
    """A table without a time is refused, and the message names what it has."""
    from usertrail.operators.resolve import SchemaError

    table = FX.table(spark, sf, "conversations")
    try:
        resolve_schema(table)
        said = ""
    except SchemaError as e:
        said = str(e)
    return table.agg(F.lit("timestamp" in said).alias("refused"),
                     F.lit(all(c in said for c in table.columns)).alias("names_columns"), F.count(F.lit(1)).alias("n_rows"))


def q_read_csv(spark, sf):
    return _round_trip(spark, sf, ".csv")


def q_read_tsv(spark, sf):
    return _round_trip(spark, sf, ".tsv")


def q_read_jsonl(spark, sf):
    return _round_trip(spark, sf, ".jsonl")


def q_read_json(spark, sf):
    return _round_trip(spark, sf, ".json")


# --------------------------------------------------------------------------- C

def q_classify_columns(spark, sf):
    a = _an(spark, sf, "customer")
    rows = [(c, k) for c, _, k in a.classification.rows()]
    return spark.createDataFrame(rows, "column string, class string")


def q_user_attributes(spark, sf):
    a = _an(spark, sf, "customer")
    return _norm(a.profiles.select("user_id", F.explode("attrs").alias("key", "value")))


def q_attribute_domain(spark, sf):
    a = _an(spark, sf, "customer")
    return attribute_domain(a.events, a.classification.attrs)


def q_event_properties(spark, sf):
    a = _an(spark, sf, "customer")
    ev = a.events.select("event_id", props_map(a.classification.props).alias("p"))
    return _norm(ev.select("event_id", F.explode("p").alias("key", "value")))


def q_event_properties_reserved(spark, sf):
    """Extras whose names are the library's own columns come out unharmed."""
    names = ["_id", "family", "pos", "bucket", "ord", "ts_key", "props", "session_no"]
    ev = FX.raw_events(spark, sf).select("event_id", "ts", "user_id", "event_type", *[
        F.concat(F.lit(n), (F.col("event_id") % (k + 3)).cast("string")).alias(n) for k, n in enumerate(names)])
    a = analyze(spark, ev, Options(order_by="event_id", materialize=False))
    tl = a.timeline(with_props=True).select("event_id", F.explode("props").alias("key", "value"))
    return _norm(tl.where(F.col("key") != "event_id"))


def q_redact_roles(spark, sf):
    """Redacted user ids keep whose rows are whose; redacted event names are one name."""
    a = analyze(spark, FX.raw_events(spark, sf), Options(
        order_by="event_id", redact=("user_id", "event_type"), redact_key="usertrail registered query", materialize=False))
    return _norm(a.events.select("event_id", "user_id", "event_name"))


def q_redact_columns(spark, sf):
    a = _an(spark, sf, "customer", redact=("c_mktsegment",))
    return _norm(a.profiles.select("user_id", F.explode("attrs").alias("key", "value")))


# --------------------------------------------------------------------------- F

def q_event_families(spark, sf):
    a = _an(spark, sf, "named")
    return _norm(a.event_family_dim())


def q_event_families_overflow(spark, sf):
    a = _an(spark, sf, "overflow")
    return _norm(a.event_family_dim())


def q_family_registry(spark, sf):
    a = _an(spark, sf, "overflow")
    return a.family_plan.registry(spark).select("family", "label")


def q_no_families(spark, sf):
    a = _an(spark, sf, "named", no_families=True)
    return _norm(a.core_profiles.select("user_id", F.explode("family_counts").alias("family", "count")))


def q_prefix_attributes(spark, sf):
    """A prefix-named column is an attribute though it varies; its first value in time counts."""
    ev = FX.raw_events(spark, sf).select("event_id", "ts", "user_id", "event_type", F.expr("event_id % 40").alias("user_mark"))
    a = analyze(spark, ev, Options(order_by="event_id"))
    return _norm(a.profiles.select("user_id", F.element_at("attrs", F.lit("user_mark")).alias("user_mark")))


def q_meta_schema(spark, sf):
    """Roles of the meta record with the number of distinct values read through each."""
    a = _an(spark, sf, "raw")
    roles = {"user_id": "user_id", "timestamp": "ts", "event_name": "event_name"}
    counts = a.events.agg(*[F.count_distinct(c).alias(r) for r, c in roles.items()])
    n = counts.select(F.explode(F.create_map(*[x for r in roles for x in (F.lit(r), F.col(r))])).alias("role", "n_values"))
    return _norm(a.meta()["schema"].join(n, "role"))


def q_family_counts(spark, sf):
    a = _an(spark, sf, "named")
    return _norm(a.core_profiles.select("user_id", F.explode("family_counts").alias("family", "count")))


# --------------------------------------------------------------------------- SS

def _sessionize(spark, sf, gap):
    a = _an(spark, sf, "raw", gap)
    return _norm(a.timeline(with_family=False).select(
        "user_id", "event_id", "session_no", "session_id", "is_start"))


def q_sessionize_gap_30(spark, sf):
    return _sessionize(spark, sf, 30)


def q_sessionize_gap_1440(spark, sf):
    return _sessionize(spark, sf, 1440)


#: Few enough events that about half of the users count as hot.
HOT = dict(hot_user_events=66)


def q_sessionize_hot(spark, sf):
    """Hot and ordinary users in one plan: the rows of ``sessionize_gap_30``."""
    a = _an(spark, sf, "raw", 30, **HOT)
    return _norm(a.timeline(with_family=False).select("user_id", "event_id", "session_no", "session_id", "is_start"))


def q_sessionize_before_1970(spark, sf):
    """Times on both sides of the epoch, every user in time slices as wide as the gap."""
    ev = FX.raw_events(spark, sf).withColumn("ts", F.expr("timestampadd(DAY, -19738, ts)"))
    a = analyze(spark, ev, Options(session_gap_minutes=15, order_by="event_id", skew="bucketed", materialize=False))
    return _norm(a.timeline(with_family=False).select("user_id", "event_id", "session_no", "session_id", "is_start"))


def q_session_table_hot(spark, sf):
    a = _an(spark, sf, "raw", 30, **HOT)
    return _norm(a.sessions.select("user_id", "session_id", fmt_ts(F.col("start_ts")).alias("start"),
                                   fmt_ts(F.col("end_ts")).alias("end"), "n_events"))


def q_stuck_signals_hot(spark, sf):
    a = _an(spark, sf, "raw", 1440, **HOT)
    return _norm(INS.stuck_signals(a.timeline(with_family=False), paths=a.paths))


def q_transitions_hot(spark, sf):
    a = _an(spark, sf, "raw", 1440, **HOT)
    return _norm(FL.transitions(a.timeline(with_family=False)))


def q_next_event_step_hot(spark, sf):
    a = _an(spark, sf, "raw", 1440, **HOT)
    return _norm(FL.next_event_step(a.timeline(with_family=False), ["view", "click"]))


def q_longest_gap_hot(spark, sf):
    return _norm(_an(spark, sf, "named", **HOT).longest_gap())


def q_sessions_by_column(spark, sf):
    src = FX.column_session_events(spark, sf)
    a = analyze(spark, src, Options(session_id="sid", order_by="event_id"))
    return _norm(a.timeline(with_family=False).select("user_id", "event_id", "session_no", "session_id"))


def q_session_table(spark, sf):
    a = _an(spark, sf, "raw", 30)
    return _norm(a.sessions.select("user_id", "session_id", fmt_ts(F.col("start_ts")).alias("start"),
                                   fmt_ts(F.col("end_ts")).alias("end"), "n_events"))


def q_session_window_agg(spark, sf):
    ev = FX.raw_events(spark, sf).select(F.col("user_id").cast("string").alias("user_id"),
                                         F.col("ts").cast("timestamp").alias("ts"))
    g = ev.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("n_events"))
    return _norm(g.select("user_id", fmt_ts(F.col("w.start")).alias("start"),
                          fmt_ts(F.col("w.end")).alias("end"), "n_events"))


def q_session_timeline(spark, sf):
    a = _an(spark, sf, "named", 30)
    return _norm(P.session_events(a.tl).select("user_id", "session_id", "pos", "hhmm", "event_name", "family"))


def q_timeline_cap(spark, sf):
    a = _an(spark, sf, "raw", 30)
    return _norm(FL.timeline_cap(a.timeline(with_family=False), 50).select("user_id", "event_id", "pos"))


# --------------------------------------------------------------------------- U

def q_user_totals(spark, sf):
    a = _an(spark, sf, "named")
    return _norm(a.core_profiles.select("user_id", "events", "sessions", "first_seen", "last_seen"))


def q_user_profile(spark, sf):
    """U4: the per-user profile, its maps exploded (one row per family and attribute)."""
    a = _an(spark, sf, "customer")
    base = a.profiles.select("user_id", "events", "sessions", "first_seen", "last_seen", "family_counts", "attrs")
    fams = base.select("user_id", "events", "sessions", "first_seen", "last_seen",
                       F.lit("family").alias("kind"), F.explode("family_counts").alias("key", "n"))
    attrs = base.select("user_id", "events", "sessions", "first_seen", "last_seen",
                        F.lit("attr").alias("kind"), F.explode("attrs").alias("key", "value"))
    return _norm(fams.select("*", F.col("n").cast("string").alias("value")).drop("n").unionByName(attrs))


def q_user_cap(spark, sf):
    a = _an(spark, sf, "named", max_users=100)
    return _norm(a.core_profiles.select("user_id", "events", "sessions"))


def q_flat_timeline(spark, sf):
    a = _an(spark, sf, "named")
    return _norm(P.flat_timeline(a.timeline(with_family=False)))


def q_run_summary(spark, sf):
    a = _an(spark, sf, "named")
    return _norm(P.run_summary(a.events, a.core_profiles).select("events", "users", "sessions"))


def q_top_events(spark, sf):
    a = _an(spark, sf, "named")
    return _norm(a.top_events(50))


# --------------------------------------------------------------------------- I

def q_recency(spark, sf):
    a = _an(spark, sf, "named")
    return _norm(INS.recency(a.core_profiles, AS_OF))


def q_longest_gap(spark, sf):
    a = _an(spark, sf, "named")
    return _norm(a.longest_gap())


def q_power_score(spark, sf):
    a = _an(spark, sf, "named")
    return _norm(a.power.select("user_id", "power_score"))


def q_top_families(spark, sf):
    a = _an(spark, sf, "named")
    return _norm(INS.top_families(a.core_profiles))


def q_stuck_signals(spark, sf):
    a = _an(spark, sf, "raw", 1440)
    return _norm(INS.stuck_signals(a.timeline(with_family=False), paths=a.paths))


def q_family_first_seen(spark, sf):
    a = _an(spark, sf, "named")
    return _norm(INS.family_first_seen(a.core_profiles))


# --------------------------------------------------------------------------- Q

def _list(spark, sf, sort_by, filters=None):
    a = _an(spark, sf, "customer")
    return _norm(Q.list_users(a, 50, sort_by, filters).users.drop("attrs"))


def q_list_users_by_events(spark, sf):
    return _list(spark, sf, "events")


def q_list_users_by_sessions(spark, sf):
    return _list(spark, sf, "sessions")


def q_list_users_by_first_seen(spark, sf):
    return _list(spark, sf, "first_seen")


def q_list_users_by_last_seen(spark, sf):
    return _list(spark, sf, "last_seen")


def q_list_users_filtered(spark, sf):
    return _list(spark, sf, "events", COHORT)


def q_analyze_user_sessions(spark, sf):
    a = _an(spark, sf, "named")
    return _norm(Q.analyze_user(a, "7", AS_OF).sessions)


def q_analyze_user_stats(spark, sf):
    a = _an(spark, sf, "named")
    return _norm(Q.analyze_user(a, "7", AS_OF).stats.select("user_id", "events", "sessions", "first_seen", "last_seen"))


def q_analyze_user_events(spark, sf):
    """One user's events with their properties."""
    a = _an(spark, sf, "named")
    ev = Q.analyze_user(a, "7", AS_OF).events
    return _norm(ev.select("session_id", "pos", "hhmm", "event_name", "family", F.element_at("props", F.lit("props")).alias("props")))


def q_analyze_user_sessions_hot(spark, sf):
    """The one user takes the two-level scan, in another display zone."""
    a = _an(spark, sf, "named", hot_user_events=10, timezone=TZ)
    return _norm(Q.analyze_user(a, "7", AS_OF).sessions)


def q_analyze_user_top_families(spark, sf):
    return _norm(Q.analyze_user(_an(spark, sf, "named"), "7", AS_OF).top_families)


def q_list_users_totals(spark, sf):
    return _norm(Q.list_users(_an(spark, sf, "customer"), 50, "events", COHORT).totals)


def q_taxonomy_totals(spark, sf):
    return _norm(Q.taxonomy(_an(spark, sf, "named"))[1])


def q_quick_report_totals(spark, sf):
    return _norm(Q.quick_report(_an(spark, sf, "named"))[2])


def q_analyze_user_top_events(spark, sf):
    a = _an(spark, sf, "named")
    return _norm(Q.analyze_user(a, "7", AS_OF).top_events)


def q_analyze_user_insights(spark, sf):
    a = _an(spark, sf, "named")
    return _norm(Q.analyze_user(a, "7", AS_OF).insights)


def q_user_top_events_pct(spark, sf):
    a = _an(spark, sf, "named")
    return _norm(Q.user_top_events(a))


def q_user_event_ranking(spark, sf):
    a = _an(spark, sf, "named")
    return _norm(Q.user_event_ranking(a).drop("first_pos", "first_key"))


def q_taxonomy(spark, sf):
    a = _an(spark, sf, "named")
    return _norm(Q.taxonomy(a)[0])


def q_cohort_summary(spark, sf):
    a = _an(spark, sf, "customer")
    return _norm(Q.cohort(a, COHORT).summary)


def q_cohort_top_events(spark, sf):
    a = _an(spark, sf, "customer")
    return _norm(Q.cohort(a, COHORT).top_events)


def q_cohort_family_distribution(spark, sf):
    a = _an(spark, sf, "customer")
    return _norm(Q.cohort(a, COHORT).family_distribution)


def q_cohort_power_users(spark, sf):
    a = _an(spark, sf, "customer")
    return _norm(Q.cohort(a, COHORT).power_users)


def q_find_users_by_event(spark, sf):
    a = _an(spark, sf, "named")
    return _norm(Q.find_users_by_event(a, "PURCHASE_", 10, 20)[0].drop("attrs"))


def q_find_users_total(spark, sf):
    a = _an(spark, sf, "named")
    return _norm(Q.find_users_by_event(a, "PURCHASE_", 10, 20)[1])


def q_export_user_subset(spark, sf):
    a = _an(spark, sf, "customer")
    ids = FX.table(spark, sf, "customer").where(F.col("c_nationkey") == 7).select("c_custkey")
    chosen, _ = Q.export_subset(a, ids, COHORT)
    return _norm(chosen.select("user_id", "events", "sessions", "first_seen", "last_seen"))


def q_missing_users(spark, sf):
    a = _an(spark, sf, "customer")
    ids = FX.table(spark, sf, "customer").where(F.col("c_nationkey") == 7).select("c_custkey")
    _, missing = Q.export_subset(a, ids)
    return missing


def q_quick_report_top_users(spark, sf):
    a = _an(spark, sf, "named")
    return _norm(Q.quick_report(a)[0])


def q_quick_report_top_events(spark, sf):
    a = _an(spark, sf, "named")
    return _norm(Q.quick_report(a)[1])


def q_profile_all_users(spark, sf):
    a = _an(spark, sf, "customer")
    return _norm(Q.profile_all_users(a).drop("attrs"))


# --------------------------------------------------------------------------- V

def q_activity_heatmap(spark, sf):
    a = _an(spark, sf, "named")
    return _norm(FL.activity_heatmap(a.tl, families=a.families))


def q_heatmap_one_event(spark, sf):
    a = _an(spark, sf, "named")
    return _norm(FL.activity_heatmap(a.tl, "purchase_viewed", families=a.families))


def q_transitions(spark, sf):
    a = _an(spark, sf, "raw", 1440)
    return _norm(FL.transitions(a.timeline(with_family=False)))


def q_entry_events(spark, sf):
    a = _an(spark, sf, "raw", 1440)
    return _norm(FL.entry_events(a.timeline(with_family=False)))


def q_top_transition(spark, sf):
    a = _an(spark, sf, "raw", 1440)
    return _norm(FL.top_transition(a.timeline(with_family=False)))


def q_path_diversity(spark, sf):
    a = _an(spark, sf, "raw", 1440)
    return _norm(FL.path_diversity(a.timeline(with_family=False)).withColumn(
        "diversity", F.bround("diversity", 9)))


def q_next_event_step(spark, sf):
    a = _an(spark, sf, "raw", 1440)
    return _norm(FL.next_event_step(a.timeline(with_family=False), ["view", "click"]))


def q_composition(spark, sf):
    a = _an(spark, sf, "named")
    return _norm(FL.composition(a.core_profiles).withColumn("share", F.bround("share", 9)))


def q_cohort_index(spark, sf):
    a = _an(spark, sf, "named")
    out = FL.cohort_index(a.core_profiles, a.n_users)
    return _norm(out.select("user_id", "family", *[F.bround(c, 6).alias(c) for c in ("share", "mean_share", "index")]))


# --------------------------------------------------------------------------- SQL surface

def _sql(spark, sf, statement):
    views = register_views(_an(spark, sf, "customer"), prefix=f"u{uuid.uuid4().hex[:8]}_")
    return _norm(spark.sql(statement.format(**views)))


def q_sql_user_profile(spark, sf):
    return _sql(spark, sf, "SELECT user_id, events, sessions, first_seen, last_seen, attrs['c_mktsegment'] AS segment FROM {user_profile} "
                           "WHERE events >= (SELECT avg(events) FROM {user_profile})")


def q_sql_segment_sessions(spark, sf):
    return _sql(spark, sf, "SELECT a.value AS segment, count(*) AS sessions, sum(s.n_events) AS events FROM {sessions} s "
                           "JOIN {user_attributes} a ON a.user_id = s.user_id AND a.key = 'c_mktsegment' GROUP BY a.value")


def q_sql_users_by_event(spark, sf):
    return _sql(spark, sf, "SELECT user_id, occurrences FROM {users_by_event}('VIEW', 5)")


def q_sql_event_followers(spark, sf):
    return _sql(spark, sf, "SELECT event_name, n FROM {event_followers}('view_viewed')")


# --------------------------------------------------------------------------- registry

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}


def _importable(query: Callable) -> Callable:
    """Python workers of this machine find the package too, wherever the driver was started."""
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        env = spark.sparkContext.environment
        known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if _HERE not in known:
            env["PYTHONPATH"] = os.pathsep.join([_HERE, *known])
        return query(spark, sf_dir)
    return run


def _corpus() -> tuple[dict, dict]:
    """Queries and SQL of the corpus operators; none where their folder or the pipeline is not there."""
    try:
        import corpus_pipeline
        from usertrail.llm import queries as corpus
    except ModuleNotFoundError as e:
        if (e.name or "").split(".")[:2] in (["corpus_pipeline"], ["usertrail", "llm"]):
            return {}, {}
        raise
    sql = dict(corpus.ORACLE)
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {**corpus.QUERIES, "pipeline": corpus_pipeline.run}, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from usertrail.plans.stream_queries import STREAM_QUERIES
    out = dict(_QUERIES)
    out.update(STREAM_QUERIES)
    out.update(_corpus()[0])
    return {name: _importable(query) for name, query in out.items()}


def oracle_sql() -> dict[str, str]:
    from usertrail.plans.oracle_queries import ORACLE
    return {**ORACLE, **_corpus()[1]}
