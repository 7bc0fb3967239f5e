"""Orchestration: raw events -> normalised events -> timeline -> profiles.

``analyze`` returns an ``Analysis`` whose tables are lazy DataFrames.  The
only driver round-trips are small, bounded metadata jobs, each run at most
once and only when a table that needs it is requested:

* schema sniff (one aggregate over all rows, skipped when aliases resolve every role);
* epoch unit probe (integer time columns only, one ``max``);
* row count + family plan (<= 207 strings back);
* column classification (three one-row aggregates).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usertrail.config import ensure_checkpoint_dir, prepare
from usertrail.constants import DEFAULT_SESSION_GAP_MINUTES, OTHER_FAMILY
from usertrail.functions.text import named
from usertrail.operators import classify as C
from usertrail.operators import families as FAM
from usertrail.operators import insights as INS
from usertrail.operators import profiles as P
from usertrail.operators.normalize import normalize
from usertrail.operators.resolve import SniffedSchema, resolve_schema
from usertrail.operators.timeline import DEFAULT_BUCKET_SECONDS, detect_hot_users, sessions, timeline
from usertrail.sources.reader import read_events


@dataclass(frozen=True)
class Options:
    user_id: str | None = None
    timestamp: str | None = None
    event_name: str | None = None
    session_id: str | None = None
    order_by: tuple[str, ...] | str | None = None
    max_users: int | None = None
    session_gap_minutes: int = DEFAULT_SESSION_GAP_MINUTES
    no_families: bool = False
    redact: tuple[str, ...] = ()
    redact_key: bytes | str | None = None  # needed to redact a user or session id
    timezone: str | None = None
    bucket_seconds: int = DEFAULT_BUCKET_SECONDS
    use_session_column: bool = True
    # Materialise the per-user gold tables (profiles, attributes, power
    # scores, user x event counts) once as Parquet in the shared
    # ``spark.checkpoint.dir``: later queries read users, not events, and the
    # lineage back to the raw events is cut (an executor loss does not
    # recompute the sessionisation).
    materialize: bool = True
    # With a number here the gold tables are bucketed and sorted by user id into so many
    # buckets (tables of the session's catalog, files in the same folder), so that joins
    # and aggregates by user need no shuffle of them.  For user counts that fill the buckets.
    gold_buckets: int | None = None
    # Skew handling for the per-user ordered scan: "auto" samples for users
    # with >= hot_user_events events and sends only them through the
    # two-level (user, time-bucket) scan; "bucketed" sends everyone;
    # "single" no one.  Results are identical in every mode.
    skew: str = "auto"
    hot_user_events: int = 2_000_000


@dataclass
class Analysis:
    spark: SparkSession
    raw: DataFrame
    options: Options
    sniffed: SniffedSchema
    _cache: dict = field(default_factory=dict)

    # ---- metadata ----------------------------------------------------------
    @property
    def schema(self):
        return self.sniffed.schema

    @cached_property
    def events(self) -> DataFrame:
        """Normalised events (all rows, null users included)."""
        return normalize(self.raw, self.schema, order_by=self.options.order_by,
                         redact=self.options.redact, redact_key=self.options.redact_key)

    @cached_property
    def n_events(self) -> int:
        # reuse the classification job's row count when it already ran
        if "classification" in self.__dict__:
            return self.classification.n_rows
        return self.events.count()

    @cached_property
    def family_plan(self) -> FAM.FamilyPlan:
        return FAM.plan_families(self.events, no_families=self.options.no_families,
                                 total_rows=self.n_events)

    @cached_property
    def classification(self) -> C.Classification:
        known = self.__dict__.get("n_events")
        return C.classify_columns(self.events, self.schema.extras, n_rows=known)

    @cached_property
    def family_dim(self) -> DataFrame | None:
        """The (event_name, family) dimension when it is small enough to
        broadcast (checked name count); None -> expression path.

        Kept lazy: as the build side of a broadcast join its narrow scan runs
        concurrently with the main scan inside the same job (writing it as a
        separate gold table measured slower: one more serial job)."""
        plan = self.family_plan
        return plan.dimension(self.events) if plan.broadcastable else None

    @property
    def families(self) -> list[str]:
        return list(self.family_plan.kept) + [OTHER_FAMILY]

    def family_of(self, name_col):
        return self.family_plan.family(name_col)

    # ---- tables ------------------------------------------------------------
    def _gold(self, df: DataFrame) -> DataFrame:
        """Write a gold table once into the shared checkpoint folder, read it back.

        A written table cuts the lineage like ``checkpoint()`` but computes the
        plan once (a reliable checkpoint of an unpersisted plan recomputes it
        for the write).
        """
        if not self.options.materialize:
            return df
        base = ensure_checkpoint_dir(self.spark).rstrip("/")
        path = f"{base}/usertrail-gold-{uuid.uuid4().hex}"
        self._cache.setdefault("gold_paths", []).append(path)
        buckets = self.options.gold_buckets
        if not buckets:
            df.write.parquet(path)
            return self.spark.read.parquet(path)
        name = path.rsplit("/", 1)[1].replace("-", "_")
        # dealt as the buckets are, so a bucket is one file
        (df.repartition(buckets, "user_id").write.format("parquet").bucketBy(buckets, "user_id").sortBy("user_id")
         .option("path", path).saveAsTable(name))
        self._cache.setdefault("gold_tables", []).append(name)
        return self.spark.table(name)

    def release(self) -> None:
        """Delete the gold tables this analysis wrote (Hadoop FileSystem API,
        so it works on shared storage); cached tables are recomputed on demand."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in self._cache.pop("gold_tables", []):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in self._cache.pop("gold_paths", []):
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        for name in ("core_profiles", "attributes", "power", "user_event_counts", "profiles", "n_users",
                     "family_dim", "tl"):
            self.__dict__.pop(name, None)

    @cached_property
    def capped_events(self) -> DataFrame:
        return P.cap_users(self.events, self.options.max_users)

    @cached_property
    def hot_users(self) -> list[str] | None:
        """Users routed through the two-level scan (None = all of them)."""
        mode = self.options.skew
        if mode == "bucketed":
            return None
        if mode == "single":
            return []
        if mode != "auto":
            raise ValueError(f"unknown skew mode {mode!r}")
        if self.n_events < self.options.hot_user_events:
            return []  # no user can hold more events than the whole table
        return detect_hot_users(self.capped_events, self.options.hot_user_events)

    @property
    def paths(self) -> str:
        hot = self.hot_users
        return "bucketed" if hot is None else ("single" if not hot else "mixed")

    def timeline(self, *, with_props: bool = False, with_family: bool = True) -> DataFrame:
        tl = timeline(self.capped_events, gap_minutes=self.options.session_gap_minutes,
                      by_column=self.by_column, bucket_seconds=self.options.bucket_seconds,
                      hot_users=self.hot_users)
        if with_family:
            tl = self.family_plan.apply(tl, dim=self.family_dim)
        if with_props:
            tl = tl.withColumn("props", C.props_map(self.classification.props))
        return tl

    @cached_property
    def tl(self) -> DataFrame:
        return self.timeline()

    @property
    def by_column(self) -> bool:
        return bool(self.schema.session_id) and self.options.use_session_column

    @cached_property
    def sessions(self) -> DataFrame:
        # hot users' gap sessions come from the bucket summary alone
        return sessions(self.capped_events, gap_minutes=self.options.session_gap_minutes,
                        by_column=self.by_column, bucket_seconds=self.options.bucket_seconds,
                        hot_users=self.hot_users)

    @cached_property
    def core_profiles(self) -> DataFrame:
        """Profiles without attributes (no classification job needed)."""
        return self._gold(P.user_profile(self.tl, self.families, tz=self.options.timezone,
                                         with_gap=not self.by_column))

    @cached_property
    def attributes(self) -> DataFrame | None:
        cls = self.classification
        if not cls.attrs:
            return None
        constant = [a for a in cls.attrs if cls.constant_per_user.get(a)]
        return self._gold(P.user_attributes(self.capped_events, cls.attrs, constant))

    @cached_property
    def profiles(self) -> DataFrame:
        """Core profiles plus the ``attrs`` map (runs the classification first)."""
        attributes = self.attributes
        return P.with_attributes(self.core_profiles, attributes)

    def profiles_without_attrs(self) -> DataFrame:
        return self.core_profiles

    def longest_gap(self) -> DataFrame:
        """I3 per user: from the profile (gap sessions) or, for column
        sessions, from consecutive rows of the sessions table."""
        if "longest_gap_days" in self.core_profiles.columns:
            return self.core_profiles.select("user_id", "longest_gap_days")
        return INS.longest_gap(self.sessions, self.core_profiles)

    @cached_property
    def power(self) -> DataFrame:
        return self._gold(INS.power_scores(self.core_profiles))

    @cached_property
    def user_event_counts(self) -> DataFrame:
        """Gold (user, event, family, count, first_key) shared by Q3/Q5/Q6/Q8.

        Straight from the events: neither counts nor first times need the
        order that sessions do, so there is no window, and the aggregate is
        combined on the map side."""
        ev = self.capped_events.where(F.col("user_id").isNotNull())
        counts = ev.groupBy("user_id", "event_name").agg(
            F.count(F.lit(1)).alias("count"), F.min("ts_key").alias("first_key"))
        return self._gold(self.family_plan.apply(counts, dim=self.family_dim).select(
            "user_id", named(F.col("event_name")).alias("event_name"), "family", "count", "first_key"))

    @cached_property
    def n_users(self) -> int:
        return self.core_profiles.count()

    def top_events(self, n: int = 50) -> DataFrame:
        return P.top_events(self.events, self.family_of, n)

    def event_family_dim(self) -> DataFrame:
        return FAM.event_family_dim(self.events, self.family_plan)

    def meta(self, top_n: int = 50) -> dict[str, DataFrame]:
        """U8: the dataset-level meta record as small DataFrames.

        ``schema`` (role, column), ``attributes`` (key, value) domain,
        ``families`` registry and ``top_events``.  Wall-clock fields are left
        to the caller.
        """
        roles = [(r, c) for r, c in self.schema.as_mapping().items() if c is not None]
        return {
            "schema": self.spark.createDataFrame(roles, "role string, column string"),
            "attributes": C.attribute_domain(self.events, self.classification.attrs),
            "families": self.family_plan.registry(self.spark),
            "top_events": self.top_events(top_n),
        }

    def for_user(self, user_id: str) -> "Analysis":
        """A view of one user's history that the Parquet scan can prune.

        ``user_id`` is compared on the normalised (string) id, which Parquet
        cannot use; an equivalent predicate on the raw, typed column is added
        so row groups are skipped by their min/max statistics.  Family plan and
        classification are reused from this analysis (they describe the whole
        data set).  A hot user takes the two-level scan here too.
        """
        from dataclasses import replace

        from pyspark.sql import types as T

        col = self.schema.user_id
        raw = self.raw
        dtype = raw.schema[col].dataType
        if isinstance(dtype, (T.NumericType, T.StringType)):
            raw = raw.where(F.col(f"`{col}`") == F.lit(str(user_id)).try_cast(dtype))
        sub = Analysis(self.spark, raw, replace(self.options, materialize=False, max_users=None), self.sniffed)
        sub.__dict__["family_plan"] = self.family_plan
        if self.schema.extras:
            sub.__dict__["classification"] = self.classification
        sub.__dict__["events"] = sub.events.where(F.col("user_id") == F.lit(str(user_id)))
        return sub


def analyze(spark: SparkSession, source: str | DataFrame, options: Options | None = None,
            *, schema=None, **kw) -> Analysis:
    """Resolve the schema of ``source`` (a path or DataFrame) and return lazy tables.

    ``schema`` (DDL string or StructType) is passed to the reader for path
    sources; at scale always give one for CSV/JSON (inference is a full pass).
    """
    prepare(spark)
    options = options or Options(**kw)
    raw = read_events(spark, source, schema=schema) if isinstance(source, str) else source
    sniffed = resolve_schema(raw, user_id=options.user_id, timestamp=options.timestamp,
                             event_name=options.event_name, session_id=options.session_id)
    return Analysis(spark, raw, options, sniffed)
