"""Skew-safe ranking helpers.

``strictly_lower`` answers "how many rows have a strictly lower score" for
every row without a global (single-partition) window over the rows:

* a histogram collapses equal scores (a hot score is one row);
* sampled splitters cut the distinct scores into ranges of about equal size,
  whose totals (one number a range) get prefix sums on the driver;
* inside a range a window over the *distinct* scores finishes the prefix sum.

``with_ranks`` brings the ranks back to the rows.  A score that holds more than its share of
the rows goes by a broadcast of such scores (there can't be many), so that no
task of the join gets all its rows.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES_AT_MOST = 1024


def _splitters(hist: DataFrame, score: str, ranges: int) -> list:
    """Scores that cut the distinct scores into about equal parts (approximate: only balance depends on it)."""
    shares = [k / ranges for k in range(1, ranges)]
    found = hist.agg(F.percentile_approx(score, shares, 100 * ranges).alias("s")).first()["s"] if shares else None
    return sorted(set(found or []))


def score_ranks(df: DataFrame, score: str, ranges: int | None = None) -> DataFrame:
    """(score, n_rows, n_lower, n_total) for every distinct score of ``df[score]``; nulls have no rank."""
    n = min(ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), RANGES_AT_MOST)
    hist = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("n_rows"))
    cuts = _splitters(hist, score, n)
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= F.col(score))) if cuts else F.lit(0)
    hist = hist.withColumn("_b", at)
    # at most RANGES_AT_MOST totals; as literals, their prefix sums need no join
    totals = {r["_b"]: r["n"] for r in hist.groupBy("_b").agg(F.sum("n_rows").alias("n")).collect()}
    before = list(accumulate((totals.get(k, 0) for k in range(len(cuts) + 1)), initial=0))
    ws = Window.partitionBy("_b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("n_rows").over(ws), F.lit(0))
    offset = F.element_at(F.array(*[F.lit(n).cast("long") for n in before]), F.col("_b") + 1)
    return hist.select(score, "n_rows", (offset + inside).alias("n_lower"), F.lit(before[-1]).cast("long").alias("n_total"))


def with_ranks(df: DataFrame, score: str, parts: int | None = None) -> DataFrame:
    """The rows of ``df`` that have a score, with n_lower and n_total."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranks = score_ranks(df, score)
    # fewer than 4 * parts scores can each hold more than 1 / (4 * parts) of the rows
    hot = ranks.where(F.col("n_rows") * F.lit(4 * parts) > F.col("n_total")).drop("n_rows")
    often = df.join(F.broadcast(hot), score)
    seldom = df.join(F.broadcast(hot.select(score)), score, "left_anti").join(ranks.drop("n_rows"), score)
    return often.unionByName(seldom)


def percentile_score(n_lower, n_total):
    """min(100, round_half_even(100 * n_lower / n_total))."""
    pct = F.bround(n_lower.cast("double") * 100.0 / n_total.cast("double"), 0).cast("int")
    return F.least(pct, F.lit(100))


def top_n_per_key(df: DataFrame, key: str, order: list, n: int, *, spread: str | None = None,
                  fanout: int = 64) -> DataFrame:
    """Top ``n`` rows per ``key`` in two stages so a hot key is never one window.

    Stage 1 ranks inside ``(key, hash(spread) % fanout)`` sub-groups; stage 2
    ranks the at most ``n * fanout`` survivors per key.
    """
    if spread is not None:
        sub = F.pmod(F.xxhash64(F.col(spread)), F.lit(fanout))
        w1 = Window.partitionBy(F.col(key), sub).orderBy(*order)
        df = df.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= n).drop("_r1")
    w2 = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= n)
