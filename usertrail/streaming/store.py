"""Tables that streams keep up to date: a compacted changelog (T2) and profiles by user bucket (T4).

``ChangeLog``: each micro-batch adds a run with its changed rows; as soon as a level
has ``fan_in`` runs they are merged into one of the next level, newest row per key.
A manifest names the runs that count; a new version is written beside the old one
and renamed into place, so a reader sees either the old runs or the new ones.  A reader
meets at most ``fan_in - 1`` runs a level, whatever the number of batches, and a
batch that the manifest has already is not written again.

``ProfileStore``: history and profiles lie in ``buckets`` folders by hash of the
user id.  A batch reads the history of the buckets it touches and nothing else, computes
the profiles of its users anew (late and untimed rows take their place), and replaces
the profiles of those buckets alone.  All of it follows from the history, in which a
retried batch replaces its own part, so a retry gives the same tables.

Defined cases: rows without a user are in the history and in no profile; a batch without
rows changes nothing; reading a log or store that nothing was written to gives an
empty table where the schema is known, else an error that says so.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "batch_id"


class _Folder:
    """A folder of the shared storage, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, below: str = "") -> list[str]:
        at = self._at(below)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_once(self, name: str, text: str) -> bool:
        """Whole or not at all; False if somebody else wrote ``name`` first."""
        own, to = self._at(f"{name}.{uuid.uuid4().hex}.tmp"), self._at(name)
        out = self.fs.create(own, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(to) or not self.fs.rename(own, to):
            self.fs.delete(own, False)
            return False
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


class ChangeLog:
    """The newest row per key of all batches appended; see the module's text."""

    def __init__(self, spark: SparkSession, path: str, key: str = "user_id", fan_in: int = 4):
        if fan_in < 2:
            raise ValueError("fan_in must be at least 2")
        self.spark, self.path, self.key, self.fan_in = spark, path, key, fan_in

    @cached_property
    def _folder(self) -> _Folder:
        return _Folder(self.spark, self.path)

    def manifest(self) -> dict:
        """version, last batch, runs [name, level], and the runs that the version before still had (old)."""
        found = [n for n in self._folder.names("manifest") if n.endswith(".json")]
        if not found:
            return {"version": 0, "last": -1, "runs": [], "old": []}
        return json.loads(self._folder.read(f"manifest/{found[-1]}"))

    def _newest(self, rows: DataFrame) -> DataFrame:
        cols = [c for c in rows.columns if c not in (self.key, BATCH)]
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*cols, BATCH), F.col(BATCH)).alias("r"))
        return newest.select(self.key, *[F.col(f"r.`{c}`").alias(c) for c in [*cols, BATCH]])

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{n}" for n in names])

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Add the rows of one batch (at most one a key counts: any); a batch that is in already changes nothing."""
        now = self.manifest()
        if batch_id <= now["last"]:
            return
        first = f"run-{batch_id:012d}-0"
        batch.withColumn(BATCH, F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.path}/{first}")
        runs, level = [*now["runs"], [first, 0]], 0
        while len(full := [n for n, at in runs if at == level]) >= self.fan_in:
            merged = f"run-{batch_id:012d}-{level + 1}"
            self._newest(self._read(full)).write.mode("overwrite").parquet(f"{self.path}/{merged}")
            runs = [r for r in runs if r[0] not in full] + [[merged, level + 1]]
            level += 1
        kept = {n for n, _ in runs}
        after = {"version": now["version"] + 1, "last": batch_id, "runs": runs,
                 "old": [n for n, _ in now["runs"] if n not in kept]}
        if not self._folder.write_once(f"manifest/{after['version']:012d}.json", json.dumps(after)):
            raise RuntimeError(f"another writer has changed {self.path}")
        # a reader may still be at the version before, so its runs go one version later;
        # what was written and merged in this very append is in no version
        in_between = {f"run-{batch_id:012d}-{at}" for at in range(level)}
        for name in [*now["old"], *(in_between - kept)]:
            self._folder.delete(name)
        for name in self._folder.names("manifest")[:-2]:
            self._folder.delete(f"manifest/{name}")

    def writer(self):
        """For ``foreachBatch``."""
        return lambda batch, batch_id: self.append(batch, batch_id)

    def latest(self) -> DataFrame:
        """The newest row per key, as of the current manifest."""
        runs = self.manifest()["runs"]
        if not runs:
            raise ValueError(f"nothing was written to {self.path} yet")
        return self._newest(self._read([n for n, _ in runs])).drop(BATCH)


class ProfileStore:
    """Profiles with attributes, renewed by the micro-batches of a stream; see the module's text.

    Families and the classification of the columns come from a batch analysis of earlier
    events and stay as they are, so that all profiles mean the same."""

    def __init__(self, path: str, options, family_plan, classification=None, buckets: int = 64):
        self.path, self.options, self.buckets = path, replace(options, materialize=False), buckets
        self.family_plan, self.classification = family_plan, classification

    def _bucket(self, user: str):
        return F.pmod(F.xxhash64(F.col(user).cast("string")), F.lit(self.buckets)).cast("int")

    def _replace(self, rows: DataFrame, name: str, *by: str) -> None:
        """Write ``rows``, replacing only the folders that they fall into."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.path}/{name}")

    def history(self, spark: SparkSession, buckets: list[int]) -> DataFrame:
        """All rows of some buckets; Spark lists and reads their folders alone."""
        return spark.read.parquet(f"{self.path}/history").where(F.col("user_bucket").isin(buckets))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        from usertrail.plans.pipeline import analyze

        spark, user = batch.sparkSession, self.options.user_id
        self._replace(batch.withColumns({"user_bucket": self._bucket(user), "usertrail_batch": F.lit(batch_id)}),
                      "history", "user_bucket", "usertrail_batch")
        own = spark.read.parquet(f"{self.path}/history").where(F.col("usertrail_batch") == batch_id).where(F.col(user).isNotNull())
        touched = sorted(r[0] for r in own.select("user_bucket").distinct().collect())  # at most ``buckets`` numbers
        if not touched:
            return
        users = own.select("user_bucket", user).distinct()
        rows = self.history(spark, touched).join(users, ["user_bucket", user], "left_semi").drop("user_bucket", "usertrail_batch")
        a = analyze(spark, rows.select(*batch.columns), self.options)
        a.__dict__["family_plan"] = self.family_plan
        if self.classification is not None:
            a.__dict__["classification"] = self.classification
            new = a.profiles
        else:
            new = a.core_profiles
        new = new.withColumn("user_bucket", self._bucket("user_id"))
        if _Folder(spark, self.path).names("profiles"):
            ids = users.select("user_bucket", F.col(user).cast("string").alias("user_id"))
            others = self.profiles(spark, touched).join(ids, ["user_bucket", "user_id"], "left_anti")
            new = reduce(DataFrame.unionByName, [new, others.select(*new.columns)])
        self._replace(new, "profiles", "user_bucket")

    def profiles(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """The profiles as they stand, with their bucket; of some buckets, or of all."""
        found = spark.read.parquet(f"{self.path}/profiles")
        return found if buckets is None else found.where(F.col("user_bucket").isin(buckets))

    def profile_of(self, spark: SparkSession, user_id: str) -> DataFrame:
        """One user's profile: one bucket's files are read."""
        at = spark.range(1).select(F.pmod(F.xxhash64(F.lit(user_id)), F.lit(self.buckets)).cast("int")).first()[0]
        return self.profiles(spark, [at]).where(F.col("user_id") == F.lit(user_id)).drop("user_bucket")

    def power(self, spark: SparkSession) -> DataFrame:
        """Power scores of all users from the profiles as they stand."""
        from usertrail.operators.insights import power_scores

        return power_scores(self.profiles(spark).drop("user_bucket"))
