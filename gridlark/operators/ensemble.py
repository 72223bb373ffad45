"""Aggregations over the member axis of a field; every plan is one grouped aggregate or one window sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlark.functions.measures import bin_of, compare, psi, psi_of, valid

KEY = ["point_id"]


def mean_and_spread(df: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """NaN-skipping mean and sample deviation; NaN with too few values."""
    v, nan = valid(F.col("value")), F.lit(float("nan"))
    return df.groupBy(*keys).agg(F.coalesce(F.avg(v), nan).alias("mean"), F.coalesce(F.stddev_samp(v), nan).alias("spread"), F.count(v).alias("n"))


def set_predicate(df: DataFrame, op: str, c: float, lower: int, upper: int, keys: list[str] = KEY) -> DataFrame:
    """Share of membership: members that pass, from lower (0) to upper (1)."""
    n = F.count_if(compare(F.col("value"), op, c))
    part = (n - lower) / (1 if lower == upper else upper - lower)
    return df.groupBy(*keys).agg(n.alias("n"), F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)).alias("share"))


def _standard(df: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys)
    v = F.col("value")
    u = F.try_divide(v - F.avg(v).over(w), F.stddev_pop(v).over(w))
    # null (a constant vector) becomes NaN, as infinite values do
    return df.withColumn("u", F.coalesce(u, F.lit(float("nan")))).withColumn("n", F.count("*").over(w))


def _finite(kl: Column, bad: Column, n: Column) -> Column:
    """1 for a single member, NaN where something is bad or the result is not finite."""
    nan = F.lit(float("nan"))
    return F.when(n == 1, 1.0).when(bad | kl.isNull() | F.isnan(kl) | (F.abs(kl) == float("inf")), nan).otherwise(kl)


def kl_binned(df: DataFrame, bins: int = 80, keys: list[str] = KEY) -> DataFrame:
    """KL divergence of the standardised members from a normal distribution, by a histogram."""
    w = Window.partitionBy(*keys)
    df = _standard(df, keys).withColumns({"lo": F.min("u").over(w) - 0.01, "hi": F.max("u").over(w) + 0.01})
    df = df.withColumn("bin", bin_of(F.col("u"), F.col("lo"), F.col("hi"), bins))
    # a NaN anywhere makes its key's bounds, and so the result, NaN
    one = df.groupBy(*keys, "lo", "hi", "n", "bin").agg((F.count("*") / F.col("n")).alias("p"))
    width = (F.col("hi") - F.col("lo")) / bins
    centre = F.col("lo") + (F.col("bin") + 0.5) * width
    normal = F.exp(-0.5 * centre * centre) / math.sqrt(2 * math.pi)
    kl = F.sum(F.col("p") * F.log(F.try_divide(F.try_divide(F.col("p"), width), normal)))
    bad = F.bool_or(F.isnan("lo") | F.isnan("hi"))
    return one.groupBy(*keys).agg(_finite(kl, bad, F.max("n")).alias("kl"))


def kl_knn(df: DataFrame, k: int = 3, keys: list[str] = KEY) -> DataFrame:
    """KL divergence from a normal distribution, by the k-th neighbour distances of each key's members."""
    order = Window.partitionBy(*keys).orderBy("u", "m")
    u = F.col("u")
    spans = [
        F.when(F.lag("u", a).over(order).isNotNull() & F.lead("u", k - a).over(order).isNotNull(), F.greatest(u - F.lag("u", a).over(order), F.lead("u", k - a).over(order) - u))
        for a in range(k + 1)
    ]
    df = _standard(df, keys).withColumn("d", F.least(*spans))
    entropy = F.avg(F.log("d")) + (psi_of(F.count("u")) - psi(k) + math.log(2))
    kl = F.greatest(-entropy + 0.5 * math.log(2 * math.pi) + 0.5 * F.avg(u * u), F.lit(0.0))
    # a distance of 0 (ties) makes the estimate infinite, which is no number
    bad = F.bool_or(F.isnan("u") | F.coalesce(F.col("d") <= 0, F.lit(True)))
    return df.groupBy(*keys).agg(_finite(kl, bad, F.max("n")).alias("kl"))


def histogram(df: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Counts of all bins, empty ones too, and their share of the fullest."""
    at = bin_of(F.col("value"), F.lit(low), F.lit(high), bins)
    counts = df.filter(~F.isnan("value")).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = spine.join(F.broadcast(counts), "bin", "left").fillna(0, ["n"])  # one row for each bin
    return out.withColumn("part", F.col("n") / F.max("n").over(Window.partitionBy()))


def block_means(df: DataFrame, factor: int) -> DataFrame:
    """NaN-skipping means of cubes of ``factor`` cells, for each member."""
    cell = [F.floor(F.col(a) / factor).alias(f"b{a}") for a in "xyz"]
    return df.groupBy(*cell, "m").agg(F.avg(valid(F.col("value"))).alias("value"))


def block_spread(df: DataFrame, factor: int) -> DataFrame:
    """Pooled deviation of blocks: root of the mean of the points' sample variances."""
    points = df.groupBy("point_id", "x", "y", "z").agg(F.var_samp(valid(F.col("value"))).alias("var"))
    cell = [F.floor(F.col(a) / factor).alias(f"b{a}") for a in "xyz"]
    return points.groupBy(*cell).agg(F.sqrt(F.avg("var")).alias("spread"), F.count("*").alias("n"))


def two_block_spreads(first: DataFrame, second: DataFrame, factor: int) -> DataFrame:
    """(bx, by, bz, first, second): the pooled deviations of two fields, each halved, so that both fit where one does."""
    half = lambda df, name: block_spread(df, factor).select("bx", "by", "bz", (F.col("spread") * 0.5).alias(name))
    return half(first, "first").join(half(second, "second"), ["bx", "by", "bz"])


def spread_range(spreads: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the smallest and largest deviation of each column, those that are no number left out."""
    v = lambda c: valid(F.col(c))
    return spreads.agg(*[f(v(c)).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))])


def block_abs_max(df: DataFrame, factor: int) -> DataFrame:
    """The value of largest magnitude in each block, with its sign; 0 where nothing is valid."""
    v = valid(F.col("value"))
    cell = [F.floor(F.col(a) / factor).alias(f"b{a}") for a in "xyz"]
    # of two values of one magnitude the larger one is taken
    return df.groupBy(*cell, "m").agg(F.coalesce(F.max(F.when(v.isNotNull(), F.struct(F.abs(v), v.alias("v"))))["v"], F.lit(0.0)).alias("value"))


def divergent_range(df: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """The symmetric range of a field: plus and minus its largest magnitude."""
    most = F.greatest(F.abs(F.min(valid(F.col("value")))), F.abs(F.max(valid(F.col("value")))))
    return df.groupBy(*keys).agg((-most).alias("low"), most.alias("high"))
