"""Numbers of distinct values of many columns at once.

``sketches`` gives every column's estimate in one aggregate over one scan: a
HyperLogLog sketch per column, one binary buffer each, which partial aggregation merges.
``exact`` counts some columns exactly: (column, 128-bit hash) pairs are made distinct
on the map side, then by one shuffle, and counted by column in two steps; no Expand,
and a value travels as 16 bytes however long it is.

``decided`` ties both together: a decision is a set of thresholds on a column's
count, and only the columns with a threshold within ten standard errors of their
estimate are counted exactly.  So decisions are those of exact counts, whatever the
number of rows (an estimate is off by more than that with probability below 1e-20;
two values share 128 bits with probability n**2 / 2**129).

Nulls are no values; maps, arrays, structs and variants are compared as JSON.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKETCH_BITS = 14
STANDARD_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)
BAND = 10 * STANDARD_ERROR


def comparable(c: Column, dtype: T.DataType) -> Column:
    nested = isinstance(dtype, (T.MapType, T.StructType, T.ArrayType, T.VariantType))
    return F.to_json(c) if nested else c


def value_hash(c: Column, dtype: T.DataType) -> Column:
    """A 64-bit hash of the value; null for null."""
    v = comparable(c, dtype)
    return F.when(v.isNotNull(), F.xxhash64(v))


def sketch(c: Column, dtype: T.DataType) -> Column:
    """Aggregate: the estimated number of distinct values."""
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(value_hash(c, dtype), SKETCH_BITS)), F.lit(0))


def near(estimate: float, thresholds: Iterable[float]) -> bool:
    """Whether the true count may lie on the other side of a threshold."""
    return any(abs(estimate - t) <= max(BAND * max(estimate, t), 2.0) for t in thresholds)


def exact(df: DataFrame, columns: Mapping[str, Column], *, salt: int = 64) -> dict[str, int]:
    """Exact numbers of distinct values by name (``columns``: name -> the column as in ``df``)."""
    if not columns:
        return {}
    names = list(columns)
    dtypes = {n: df.select(c).schema[0].dataType for n, c in columns.items()}
    values = {n: comparable(columns[n], dtypes[n]) for n in names}
    pairs = F.array(*[F.when(v.isNotNull(), F.struct(F.lit(i).alias("at"), F.xxhash64(v).alias("h"),
                                                     F.xxhash64(F.lit(n), v).alias("g")))
                      for i, (n, v) in enumerate(values.items())])
    found = df.select(F.inline(F.filter(pairs, F.isnotnull))).distinct()
    # a column may hold nearly all pairs: counted in parts, then summed
    parts = found.groupBy("at", F.pmod("h", F.lit(salt)).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    counted = {r["at"]: r["n"] for r in parts.groupBy("at").agg(F.sum("n").alias("n")).collect()}
    return {n: counted.get(i, 0) for i, n in enumerate(names)}


def decided(df: DataFrame, columns: Mapping[str, Column], estimates: Mapping[str, int],
            thresholds: Mapping[str, Iterable[float]]) -> dict[str, int]:
    """The estimates, exact wherever a column's thresholds need it."""
    unsure = {n: columns[n] for n in columns if near(estimates[n], thresholds.get(n, ()))}
    return {**{n: int(estimates[n]) for n in columns}, **exact(df, unsure)}
