"""Exact quantiles of a distributed column by repeated narrowing, a few small aggregations each."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1024
FINAL_ROWS = 100_000


def exact_quantile(df: DataFrame, column: str, q: float) -> float | None:
    """Linear-interpolation quantile of the non-null values; None without values."""
    values = df.select(F.col(column).cast("double").alias("v")).dropna()
    bounds = values.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not bounds["n"]:
        return None
    place = q * (bounds["n"] - 1)
    rank = math.floor(place)
    low = _value_at(values, rank, bounds)
    share = place - rank
    if share == 0:
        return low
    high = _value_at(values, rank + 1, bounds)
    return low + (high - low) * share


def _value_at(values: DataFrame, rank: int, bounds) -> float:
    """The value at 0-based ``rank``: each pass keeps only the histogram bin the rank falls into."""
    n, lo, hi = bounds["n"], bounds["lo"], bounds["hi"]
    while lo < hi:
        inside = values.filter(F.col("v").between(lo, hi))
        if n <= FINAL_ROWS:
            return inside.orderBy("v").offset(rank).limit(1).first()["v"]
        place = F.floor((F.col("v") - lo) / F.lit(hi - lo) * BINS)
        bins = inside.groupBy(F.least(place, F.lit(BINS - 1)).alias("bin")).agg(
            F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
        )
        for row in sorted(bins.collect(), key=lambda r: r["bin"]):
            if rank < row["n"]:
                n, lo, hi = row["n"], row["lo"], row["hi"]
                break
            rank -= row["n"]
    return lo
