"""Inputs for the registered queries, derived by Spark from the given tables.

The driver tables carry five bare event types; these views derive richer
event names and per-user columns from them (all lazily, at full size):

* ``named_events``: ``event_type || '_' || suffix(k)`` where ``k`` is the
  integer inside ``props`` -- exercises verb, prefix and merged families;
* ``overflow_events``: 20 prefixes x 4 unmatched names -> family cap;
* ``customer_events``: events joined with ``customer`` on the user id, giving
  per-user attribute columns;
* ``epoch_events``: the time as integer epoch seconds / milliseconds;
* ``untidy_events``: every 97th event has lost its time;
* ``repeated_events``: every event 60 times, so that the share of distinct users is tiny;
* ``column_session_events``: a session column ``cast(value as int) % 3``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k() -> F.Column:
    return F.regexp_extract(F.col("props"), r"(\d+)", 1).cast("int")


def _suffix(k: F.Column) -> F.Column:
    return (F.when(k % 6 == 0, F.lit("viewed")).when(k % 6 == 1, F.lit("submitted"))
            .otherwise(F.concat(F.lit("m"), (k % 6).cast("string"))))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def named_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = raw_events(spark, sf_dir)
    name = F.concat(F.col("event_type"), F.lit("_"), _suffix(_k()))
    return ev.select("event_id", "ts", "user_id", name.alias("event_name"), "value", "props")


def overflow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = raw_events(spark, sf_dir)
    k = _k()
    name = F.concat(F.col("event_type"), (k % 4).cast("string"), F.lit("_"), _suffix(F.floor(k / 4).cast("int")))
    return ev.select("event_id", "ts", "user_id", name.alias("event_name"), "value", "props")


def customer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = named_events(spark, sf_dir)
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal",
                                                   "c_mktsegment")
    # customer grows with the data: a plain equi-join (AQE may broadcast it
    # at run time once its real size is known to be small).
    return ev.join(cust, ev.user_id == cust.c_custkey, "left").drop("c_custkey")


def epoch_events(spark: SparkSession, sf_dir: str, unit: str = "ms") -> DataFrame:
    ev = raw_events(spark, sf_dir)
    ts = F.col("ts").cast("timestamp")
    epoch = F.unix_millis(ts) if unit == "ms" else F.unix_seconds(ts)
    return ev.select("event_id", epoch.alias("t_epoch"), "user_id", "event_type")


def column_session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = raw_events(spark, sf_dir)
    return ev.select("event_id", "ts", "user_id", "event_type",
                     (F.col("value").cast("int") % 3).alias("sid"))


def untidy_events(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.when(F.col("event_id") % 97 != 13, F.col("ts")))


def repeated_events(spark: SparkSession, sf_dir: str, times: int = 60) -> DataFrame:
    return raw_events(spark, sf_dir).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_copy")
