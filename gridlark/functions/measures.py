"""Small column functions: valid values, bins, digamma of whole numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EULER = 0.5772156649015329


def valid(v: Column) -> Column:
    """The value, or null where it is NaN; aggregates then leave it out."""
    return F.nanvl(v, F.lit(None).cast("double"))


def bin_of(v: Column, low: Column, high: Column, bins: int) -> Column:
    """Number of the bin, with the largest value in the last one; 0 where all values are equal.

    Values beyond the bounds, infinite ones too, are in the outermost bins, and NaN in bin 0.
    """
    at = F.nanvl(F.coalesce(F.try_divide(v - low, high - low) * bins, F.lit(0.0)), F.lit(0.0))
    # clamped before it is a whole number, which far values don't fit
    return F.floor(F.least(F.greatest(at, F.lit(0.0)), F.lit(bins - 1.0))).cast("int")


def psi(n: int) -> float:
    return -EULER + math.fsum(1 / i for i in range(1, n))


def psi_of(n: Column) -> Column:
    """``psi`` of a column of whole numbers."""
    parts = F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: F.when(i < n, 1 / i).otherwise(0.0))
    return F.aggregate(parts, F.lit(-EULER), lambda a, x: a + x)


def compare(v: Column, op: str, c: float) -> Column:
    """IEEE comparison: NaN fails everything but ``!=``."""
    tests = {">": v > c, ">=": v >= c, "<": v < c, "<=": v <= c, "==": v == c}
    return F.isnan(v) | (v != c) if op == "!=" else ~F.isnan(v) & tests[op]


def max_mi_ksg(k: int, n: int) -> float:
    """The largest value that Kraskov's estimate takes."""
    return psi(n) - psi(k)


def covariance_ratio(a: str = "a", b: str = "b", eps: float = 0.0) -> Column:
    """Pearson's correlation as an aggregate: null for a constant side, or 0 with ``eps`` in the divisor."""
    spread = F.stddev_samp(a) * F.stddev_samp(b)
    return F.covar_samp(a, b) / (spread + eps if eps else F.nullif(spread, F.lit(0.0)))


def value_range(measure: str, absolute: bool = False) -> tuple[float, float | None]:
    """Smallest and largest value of a measure; None where the data decide."""
    if measure.startswith("mi_"):
        return (0.0, 1.0) if measure.endswith("coefficient") else (0.0, None)
    return (0.0 if absolute else -1.0), 1.0


def mi_coefficient(mi: Column) -> Column:
    return F.sqrt(1 - F.exp(-2 * mi))


def default_k(n: int) -> int:
    return max(math.ceil(3 * n / 100), 1)


def largest_k(n: int) -> int:
    """The largest k that a user may choose for n members."""
    return max(math.ceil(7 * n / 100), 20)
