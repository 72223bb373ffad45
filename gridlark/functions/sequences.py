"""Points of quasi-random sequences as closed forms of their number, so any part of a sequence is made where it is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASES = (2, 3, 5, 7, 11, 13)


def plastic_steps(d: int) -> list[float]:
    """The step of each coordinate: powers of the inverse of the root of g**(d + 1) = g + 1, after ten rounds."""
    g = 2.0
    for _ in range(10):
        g = (1.0 + g) ** (1.0 / (d + 1.0))
    return [(1.0 / g) ** (j + 1) % 1.0 for j in range(d)]


def plastic(i: Column, d: int, seed: float = 0.5) -> list[Column]:
    """Coordinates of point i = 0, 1, ... of the plastic sequence, as floats."""
    at = [F.lit(seed) + F.lit(a) * (i + 1).cast("double") for a in plastic_steps(d)]
    return [(x - F.floor(x)).cast("float") for x in at]


def halton(i: Column, d: int) -> list[Column]:
    """Coordinates of point i = 0, 1, ... of the Halton sequence in the first d primes, as floats."""
    out = []
    for b in BASES[:d]:
        total, size = F.lit(0.0), 1
        while size < 1 << 31:
            total = total + ((i + 1) / size).cast("long") % b / float(size * b)
            size *= b
        out.append(total.cast("float"))
    return out


def uniform(i: Column, d: int, seed: int = 2) -> list[Column]:
    """Coordinates of point i drawn by a hash of seed and number: the same in every plan."""
    bits = lambda j: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(j), i), 11)
    return [(bits(j).cast("double") / float(1 << 53)).cast("float") for j in range(d)]


METHODS = {"plastic": plastic, "halton": halton, "uniform": uniform}


def points(spark: SparkSession, method: str, n: int, d: int) -> DataFrame:
    """(i, s0, s1, ...): the first n points."""
    df = spark.range(n).withColumnRenamed("id", "i")
    return df.select("i", *[c.alias(f"s{j}") for j, c in enumerate(METHODS[method](F.col("i"), d))])


def cell(s: Column, size: Column) -> Column:
    """The cell of a coordinate in [0, 1) among ``size`` cells."""
    return F.least(F.greatest(F.floor(s.cast("double") * size), F.lit(0)), size - 1)
