"""Spark session helpers.

The library never creates a cluster session; callers pass their ``SparkSession``.
Of its settings only the session time zone is pinned (``prepare``).  ``local_session`` exists for tests and the bench.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "usertrail") -> SparkSession:
    """A local session configured the way the tests and the bench expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the semantics the library relies on: naive timestamps are UTC.

    This is the one session setting the library changes; it stays changed."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names a shared (distributed) folder and is left
    untouched.  Only in a local session (tests) is a fresh scratch folder taken
    where it is unset; on a cluster that is an error, as no executor sees
    another machine's folder.
    """
    current = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="usertrail-ckpt-", dir=os.environ.get("USERTRAIL_SCRATCH", "/tmp"))
    spark.conf.set(CHECKPOINT_CONF, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cluster_conf(shuffle_bytes: int, *, target_partition_bytes: int = 256 << 20,
                 min_partitions: int = 200) -> dict[str, str]:
    """Suggested settings for a cluster job (pass to ``SparkSession.builder.config``).

    ``shuffle_bytes`` is the expected size of the largest shuffle -- for the
    sessionisation that is roughly the bytes of the projected event columns
    (user id, time, name, order key and the extras the outputs need).
    Partitions are sized so a shuffle partition stays well inside executor
    memory; AQE coalesces small ones and splits skewed join partitions.
    """
    partitions = max(min_partitions, -(-int(shuffle_bytes) // int(target_partition_bytes)))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.session.timeZone": "UTC",
    }
