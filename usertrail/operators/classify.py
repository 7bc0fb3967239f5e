"""Column classification (C1-C8): user attribute / event property / skipped.

The decision is metadata (column names) and is made from at most three
aggregate jobs whose results are one row each:

A. one pass with a HyperLogLog sketch + a null flag per extra (C1/C2);
B. per-user ``min``/``max`` of a 64-bit hash of each extra ->
   ``bool_and(min <=> max)`` (C4: a user has at most one distinct non-null
   value iff they agree; hashing keeps every buffer fixed-width so the job is
   a hash aggregation, and a 64-bit collision between two values of one user
   is ~1e-19) plus the exact user count (C5).  ``groupBy(user)`` is map-side
   combinable, so a hot user never materialises as one group;
C. exact distinct counts only for the columns whose estimate lies near a
   decision boundary (``distinct.exact``: hashes made distinct on the map side).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usertrail.constants import FREE_TEXT_SHARE, MAX_ATTR_CARDINALITY, USER_ATTR_PREFIX_PATTERN
from usertrail.operators.distinct import decided, sketch, value_hash
from usertrail.operators.normalize import extra_column

_USER_PREFIX = re.compile(USER_ATTR_PREFIX_PATTERN)


@dataclass(frozen=True)
class Classification:
    attrs: tuple[str, ...]
    props: tuple[str, ...]
    skipped: tuple[str, ...]
    n_unique: dict[str, int] = field(default_factory=dict)
    constant_per_user: dict[str, bool] = field(default_factory=dict)
    max_cardinality: int = 0
    n_users: int = 0
    n_rows: int = 0

    def rows(self) -> list[tuple[str, int, str]]:
        out = []
        for c, n in self.n_unique.items():
            klass = "attr" if c in self.attrs else "prop" if c in self.props else "skip"
            out.append((c, n, klass))
        return out


def _q(c: str) -> Column:
    return F.col(f"`{extra_column(c)}`")


def max_attr_cardinality(n_users: int) -> int:
    """min(50, int(sqrt(max(n_users, 1))) * 2 + 1)."""
    return min(MAX_ATTR_CARDINALITY, int(math.sqrt(max(n_users, 1))) * 2 + 1)


def classify_columns(events: DataFrame, extras: list[str] | tuple[str, ...],
                     n_rows: int | None = None) -> Classification:
    extras = list(extras)
    if not extras:
        n = n_rows if n_rows is not None else events.count()
        return Classification((), (), (), n_rows=n)
    dtypes = {f.name: f.dataType for f in events.schema.fields}

    def dtype(c: str) -> T.DataType:
        return dtypes[extra_column(c)]

    # Job A: estimates, null flags and the row count.  A null counts as one more value.
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(extras):
        aggs += [sketch(_q(c), dtype(c)).alias(f"a{i}"), F.max(_q(c).isNull().cast("int")).alias(f"z{i}")]
    ra = events.agg(*aggs).first()
    rows = ra["__rows"] if n_rows is None else n_rows
    nulls = {c: ra[f"z{i}"] or 0 for i, c in enumerate(extras)}

    # Job B: constant-per-user flags and the exact user count (null user counts).
    per_user = events.groupBy("user_id").agg(*[
        agg for i, c in enumerate(extras)
        for agg in (F.min(value_hash(_q(c), dtype(c))).alias(f"mn{i}"), F.max(value_hash(_q(c), dtype(c))).alias(f"mx{i}"))
    ])
    rb = per_user.agg(
        F.count(F.lit(1)).alias("__users"),
        *[F.bool_and(F.col(f"mn{i}").eqNullSafe(F.col(f"mx{i}"))).alias(f"k{i}")
          for i in range(len(extras))],
    ).first()
    n_users = rb["__users"]
    constant = {c: bool(rb[f"k{i}"]) for i, c in enumerate(extras)}
    cap = max_attr_cardinality(n_users)
    free_text = rows * FREE_TEXT_SHARE

    # Job C: exact distinct counts only where the estimate could flip a decision.
    thresholds = {c: [t - nulls[c] for t in ([free_text, cap] if constant[c] and not _USER_PREFIX.match(c) else [free_text])]
                  for c in extras}
    values = decided(events, {c: _q(c) for c in extras}, {c: ra[f"a{i}"] for i, c in enumerate(extras)}, thresholds)
    n_unique = {c: values[c] + nulls[c] for c in extras}

    attrs, props, skipped = [], [], []
    for c in extras:
        if n_unique[c] > free_text:
            skipped.append(c)          # C2: free text, silently skipped
        elif _USER_PREFIX.match(c):
            attrs.append(c)            # C3: naming rule, no cardinality cap
        elif constant[c] and n_unique[c] <= cap:
            attrs.append(c)            # C4 + C5
        else:
            props.append(c)
    return Classification(tuple(attrs), tuple(props), tuple(skipped), n_unique, constant, cap, n_users, rows)


def first_attr_value(c: str, dtype: T.DataType | None = None) -> Column:
    """C6 aggregate: the first non-null value in time order, stringified."""
    key = F.when(_q(c).isNotNull(), F.struct(F.col("ts_key"), F.col("ord")))
    return F.min_by(_q(c), key).cast("string")


def attrs_map(values: dict[str, Column]) -> Column:
    """Build ``map<string,string>`` dropping null values (users without -> {})."""
    if not values:
        return F.create_map().cast("map<string,string>")
    m = F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*values.values()))
    return F.map_filter(m, lambda k, v: v.isNotNull())


def props_map(cols: list[str] | tuple[str, ...]) -> Column:
    """Per-event property map, nulls skipped, values stringified."""
    if not cols:
        return F.create_map().cast("map<string,string>")
    m = F.map_from_arrays(F.array(*[F.lit(c) for c in cols]),
                          F.array(*[_q(c).cast("string") for c in cols]))
    return F.map_filter(m, lambda k, v: v.isNotNull())


def attribute_domain(events: DataFrame, attrs: list[str] | tuple[str, ...]) -> DataFrame:
    """C7 (long form): distinct non-null (key, value) pairs of every attribute.

    One scan for all attributes; the pairs are deduplicated on the map side
    before the shuffle.  Ordering is left to the consumer.
    """
    if not attrs:
        return events.sparkSession.createDataFrame([], "key string, value string")
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), _q(c).cast("string").alias("value")) for c in attrs])
    return events.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()
