"""Skew-safe ranking helpers against brute force."""

from __future__ import annotations

import random
import statistics

import pytest

from pyspark.sql import functions as F

from usertrail.operators.order_stats import median, nth_smallest
from usertrail.operators.ranking import percentile_score, score_ranks, top_n_per_key, with_ranks


def test_score_ranks_match_brute_force(spark):
    rnd = random.Random(3)
    # heavy ties (a third of rows share one score) and scores spanning many octaves
    scores = [7] * 300 + [rnd.choice([0, 1, 2, 3, 10**6, 10**12]) for _ in range(300)] + \
             [rnd.randint(0, 5000) for _ in range(300)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "id long, activity long")
    ranks = score_ranks(df, "activity")
    got = {r["activity"]: (r["n_lower"], r["n_total"]) for r in ranks.collect()}
    n = len(scores)
    for s in set(scores):
        assert got[s] == (sum(1 for x in scores if x < s), n)
    pct = df.join(ranks, "activity").select(
        "activity", percentile_score(F.col("n_lower"), F.col("n_total")).alias("p")).distinct().collect()
    for r in pct:
        lower = sum(1 for x in scores if x < r["activity"])
        assert r["p"] == min(100, round(lower * 100 / n))


def test_top_n_per_key_two_stage(spark):
    rows = [("hot", f"s{i % 50}", i) for i in range(1000)] + [("cold", "s0", 5), ("cold", "s1", 9)]
    df = spark.createDataFrame(rows, "user_id string, session_id string, v long")
    top = top_n_per_key(df, "user_id", [F.col("v").desc()], 3, spread="session_id", fanout=8)
    got = sorted((r["user_id"], r["rank"], r["v"]) for r in top.collect())
    assert got == [("cold", 1, 9), ("cold", 2, 5), ("hot", 1, 999), ("hot", 2, 998), ("hot", 3, 997)]


def test_a_score_of_half_of_the_rows(spark):
    rnd = random.Random(5)
    scores = [4] * 2000 + [rnd.randint(0, 3000) for _ in range(2000)] + [None, None]
    df = spark.createDataFrame(list(enumerate(scores)), "id long, activity long").repartition(4)
    known = sorted(s for s in scores if s is not None)
    got = with_ranks(df, "activity", parts=4)
    assert got.columns == ["activity", "id", "n_lower", "n_total"]
    rows = got.collect()
    assert sorted(r.id for r in rows) == [i for i, s in enumerate(scores) if s is not None]
    import bisect
    assert all(r.n_lower == bisect.bisect_left(known, scores[r.id]) and r.n_total == 4000 for r in rows)
    # the hot score stays where its rows are: no task of the result holds them all
    sizes = got.where("activity = 4").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 0.5 * 2000
    # distinct scores are dealt evenly over the ranges
    for k in (1, 7):
        assert {r.activity: r.n_lower for r in score_ranks(df, "activity", ranges=k).collect()} == {
            s: bisect.bisect_left(known, s) for s in set(known)}
    assert with_ranks(df.where("activity is null"), "activity").count() == 0


@pytest.mark.parametrize("values", [
    [5], [1, 2], [3, 3, 3, None], [0, -(2**63), 2**63 - 1], [-7, 9, -7, 100, 10**12, 4], list(range(100)) * 3, [2**63 - 1, 2**63 - 2]])
def test_median_by_refinement(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
    known = sorted(v for v in values if v is not None)
    assert nth_smallest(df, F.col("v"), list(range(0, len(known), 5)), cells=16) == known[::5]
    assert median(df, F.col("v")) == pytest.approx(statistics.median(known))


def test_median_of_a_million_distinct_values(spark):
    df = spark.range(1_000_001).select((F.col("id") * 977 % 1_000_003).alias("v"))
    want = sorted(i * 977 % 1_000_003 for i in range(1_000_001))[500_000]
    assert median(df, F.col("v")) == want
    assert median(df.where("false"), F.col("v")) is None
    with pytest.raises(ValueError):
        nth_smallest(df.where("false"), F.col("v"), [0])
