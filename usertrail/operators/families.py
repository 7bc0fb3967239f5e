"""Event families.

Families depend only on the ``(event_name, count)`` table.  One aggregate
job over the column-pruned name counts (plus the row count, usually shared
with the classification job) brings back a *provably bounded* result: the
verb families present (at most 7), the qualifying prefixes (each needs a
share >= 0.5 % of all rows, so at most 200) and the number of distinct names.

Applying the assignment to events has two strategies, chosen on that checked
name count:

* few names (<= ``BROADCAST_MAX_NAMES``, of <= ``BROADCAST_MAX_BYTES``): the per-name dimension
  ``(event_name, family)`` is computed by Spark from the events and joined
  with a broadcast hash join -- one hash probe per event;
* otherwise: the assignment is evaluated as a column expression per event
  (regex tokenising + literal map), which needs no join and no broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usertrail.constants import (
    MAX_FAMILIES,
    OTHER_COLORS,
    OTHER_FAMILY,
    PALETTE,
    PREFIX_MIN_DISTINCT,
    PREFIX_MIN_SHARE,
    VERB_FAMILIES,
)
from usertrail.functions.text import first_token, last_token

# Largest name dimension we broadcast: count and bytes are both checked by plan_families.
BROADCAST_MAX_NAMES = 200_000
BROADCAST_MAX_BYTES = 16 << 20


def verb_family(name: Column) -> Column:
    """family from the verb-like last token, null when no entry matches."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in VERB_FAMILIES.items()))
    return F.element_at(table, last_token(name))


@dataclass(frozen=True)
class FamilyPlan:
    """Driver-side description of the family assignment (bounded size)."""

    kept: tuple[str, ...]          # named families after the cap, alphabetical
    prefixes: tuple[str, ...]      # qualifying first-token prefixes (<= 200)
    has_other: bool
    disabled: bool = False
    n_names: int = 0               # distinct non-null event names (checked size)
    name_bytes: int = 0            # their length in UTF-8

    def family(self, name: Column) -> Column:
        """F3/F4/F6/F7 as one expression over the event name."""
        if self.disabled or not self.kept:
            return F.lit(OTHER_FAMILY)
        first = first_token(name)
        candidate = F.coalesce(
            verb_family(name),
            F.when(first.isin(*self.prefixes), first) if self.prefixes else F.lit(None).cast("string"),
        )
        return F.when(candidate.isin(*self.kept), candidate).otherwise(F.lit(OTHER_FAMILY))

    @property
    def broadcastable(self) -> bool:
        return not self.disabled and bool(self.kept) and self.n_names <= BROADCAST_MAX_NAMES and (
            self.name_bytes <= BROADCAST_MAX_BYTES)

    def dimension(self, names: DataFrame) -> DataFrame:
        """(event_name, family) for every distinct non-null name in ``names``."""
        return (names.select("event_name").where(F.col("event_name").isNotNull()).distinct()
                .select("event_name", self.family(F.col("event_name")).alias("family")))

    def apply(self, df: DataFrame, names: DataFrame | None = None, col: str = "family",
              dim: DataFrame | None = None) -> DataFrame:
        """Add the family column to ``df``.

        ``dim`` is a prepared name dimension; otherwise ``names`` (normally the
        events themselves) is used to derive one when the checked name count
        allows a broadcast, else the expression path is taken.
        """
        if self.disabled or not self.kept:
            return df.withColumn(col, F.lit(OTHER_FAMILY))
        if dim is None and names is not None and self.broadcastable:
            dim = self.dimension(names)
        if dim is not None:
            out = df.join(F.broadcast(dim.withColumnRenamed("family", "_fam")), "event_name", "left")
            return out.withColumn(col, F.coalesce(F.col("_fam"), F.lit(OTHER_FAMILY))).drop("_fam")
        return df.withColumn(col, self.family(F.col("event_name")))

    def registry_rows(self) -> list[tuple[str, str, int, str, str, str]]:
        """(family, label, slot, color, bg, fg); slot from a stable CRC32."""
        import zlib

        rows = []
        for fam in self.kept:
            slot = zlib.crc32(fam.encode("utf-8")) % len(PALETTE)
            c, bg, fg = PALETTE[slot]
            rows.append((fam, fam.replace("_", " ").title(), slot, c, bg, fg))
        if self.has_other or self.disabled or not self.kept:
            c, bg, fg = OTHER_COLORS
            rows.append((OTHER_FAMILY, "Other", -1, c, bg, fg))
        return rows

    def registry(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            self.registry_rows(),
            "family string, label string, slot int, color string, bg string, fg string")


def name_counts(events: DataFrame) -> DataFrame:
    """Per-name row counts (null names form their own group)."""
    return events.groupBy("event_name").agg(F.count(F.lit(1)).alias("n"))


def plan_families(events: DataFrame, *, no_families: bool = False,
                  total_rows: int | None = None) -> FamilyPlan:
    if no_families:
        return FamilyPlan((), (), True, disabled=True)
    total = total_rows if total_rows is not None else events.count()
    total = max(total, 1)
    nc = name_counts(events).where(F.col("event_name").isNotNull())
    nc = nc.select("n", F.octet_length("event_name").cast("long").alias("bytes"), verb_family(F.col("event_name")).alias("verb"),
                   first_token(F.col("event_name")).alias("first"))
    grp = (
        F.when(F.col("verb").isNotNull(), F.concat(F.lit("v:"), F.col("verb")))
        .when(F.col("first").isNull(), F.lit("x"))
        .otherwise(F.concat(F.lit("p:"), F.col("first")))
    )
    groups = nc.groupBy(grp.alias("g")).agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("r"), F.sum("bytes").alias("bytes"))
    # the catch-all has no name of its own: a prefix spelled like it stays in it
    is_prefix = F.col("g").startswith("p:") & (F.col("g") != F.lit("p:" + OTHER_FAMILY))
    qualifies = is_prefix & (F.col("d") >= PREFIX_MIN_DISTINCT) & (F.col("r") / F.lit(total) >= PREFIX_MIN_SHARE)
    row = groups.agg(
        F.collect_set(F.when(F.col("g").startswith("v:"), F.substring("g", 3, 1 << 20))).alias("verbs"),
        F.collect_set(F.when(qualifies, F.substring("g", 3, 1 << 20))).alias("prefixes"),
        F.max((F.col("g") == "x") | (F.col("g").startswith("p:") & ~qualifies)).alias("unmatched"),
        F.sum("d").alias("n_names"), F.sum("bytes").alias("name_bytes"),
    ).first()
    verbs = set(row["verbs"] or [])
    prefixes = sorted(row["prefixes"] or [])
    named = sorted(verbs | set(prefixes))
    kept = tuple(named[:MAX_FAMILIES])
    has_other = bool(row["unmatched"]) or len(named) > MAX_FAMILIES
    return FamilyPlan(kept, tuple(prefixes), has_other, n_names=int(row["n_names"] or 0),
                      name_bytes=int(row["name_bytes"] or 0))


def event_family_dim(events: DataFrame, plan: FamilyPlan) -> DataFrame:
    """dim_event_family: (event_name, n, family)."""
    return name_counts(events).withColumn("family", plan.family(F.col("event_name")))
