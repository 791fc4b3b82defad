"""Tail probability of clustered events."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tail_probability(p, n, k) -> Column:
    """P(X >= k) among n trials of probability p, never below 0.

    Poisson when n > 20 and p < 0.05, binomial otherwise.
    """
    p, n, k = _c(p).cast("double"), _c(n).cast("double"), _c(k).cast("int")
    poisson = (n > 20) & (p < 0.05)
    first = F.when(poisson, F.exp(-n * p)).otherwise(F.pow(1 - p, n))
    terms = F.when(k > 1, F.sequence(F.lit(1), k - 1)).otherwise(F.array().cast("array<int>"))
    rest = F.aggregate(
        terms, F.struct(first.alias("t"), (1 - first).alias("s")),
        lambda acc, i: F.struct(
            (acc["t"] * F.when(poisson, n * p / i).otherwise((n - i + 1) * p / (i * (1 - p)))).alias("t"),
            (acc["s"] - acc["t"] * F.when(poisson, n * p / i).otherwise((n - i + 1) * p / (i * (1 - p)))).alias("s")),
        lambda acc: acc["s"])
    return F.greatest(rest, F.lit(0.0))
