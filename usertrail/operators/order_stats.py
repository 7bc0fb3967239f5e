"""Exact order statistics without a holistic aggregate (Q5).

The k-th smallest of whole numbers is found by refining a histogram: a pass counts
the rows of at most ``cells`` equal ranges (partial aggregation, a bounded buffer whatever the
values), the range that holds the rank is cut again, and after a few passes it is one
value wide: two passes for ranges up to sixteen million, six for all of 64 bits.
Several ranks are followed at once, one aggregate a pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 4096


def nth_smallest(df: DataFrame, value: Column, ranks: list[int], cells: int = CELLS) -> list[int]:
    """The values at the given ranks (from 0) among the non-null whole numbers of ``value``."""
    rows = df.select(value.cast("long").alias("v")).where("v is not null")
    ends = rows.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if any(not 0 <= r < ends["n"] for r in ranks):
        raise ValueError(f"ranks {ranks} of {ends['n']} values")
    # per rank: the range lo..hi that holds it, and the rank inside
    at = [(ends["lo"], ends["hi"], r) for r in ranks]
    while any(lo < hi for lo, hi, _ in at):
        ranges = sorted({(lo, hi) for lo, hi, _ in at if lo < hi})
        width = {r: (r[1] - r[0]) // cells + 1 for r in ranges}
        # v - lo may not fit into 64 bits for the first range of all
        whole = "cast({} as decimal(20, 0))".format
        found = F.coalesce(*[F.when(F.col("v").between(lo, hi), F.struct(F.lit(k).alias("range"), F.expr(
            f"({whole('v')} - {whole(lo)}) div {whole(width[lo, hi])}").cast("int").alias("cell")))
            for k, (lo, hi) in enumerate(ranges)])
        counts = rows.select(found.alias("f")).where("f is not null").groupBy("f.range", "f.cell").agg(
            F.count(F.lit(1)).alias("n")).collect()  # at most cells rows a range
        by = {r: sorted((c["cell"], c["n"]) for c in counts if c["range"] == k) for k, r in enumerate(ranges)}
        for i, (lo, hi, rank) in enumerate(at):
            for cell, n in by.get((lo, hi), ()):
                if rank < n:
                    start = lo + cell * width[lo, hi]
                    at[i] = (start, min(start + width[lo, hi] - 1, hi), rank)
                    break
                rank -= n
    return [lo for lo, _, _ in at]


def median(df: DataFrame, value: Column) -> float | None:
    """The exact median of whole numbers, the mean of the middle two; None without values."""
    n = df.agg(F.count(value).alias("n")).first()["n"]
    if not n:
        return None
    low, high = nth_smallest(df, value, [(n - 1) // 2, n // 2])
    return (low + high) / 2
