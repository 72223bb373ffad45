"""Dependence between member vectors: pairs are rows of (keys, m, a, b).

Of every measure: a single member gives 1, NaN in a pair gives NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlark.functions.kernels import of_vectors
from gridlark.functions.measures import bin_of, covariance_ratio, mi_coefficient
from gridlark.session import bounded

KEY = ["point_id"]


def with_reference(df: DataFrame, point: int) -> DataFrame:
    """Each row with the reference point's value of the same member.

    The reference has a row for each member, and is broadcast if it is counted to be small.
    """
    ref = df.filter(F.col("point_id") == point).select("m", F.col("value").alias("a"))
    return df.withColumnRenamed("value", "b").join(bounded(ref), "m")


def _axis(time: str) -> str:
    return "member" if time == "m" else time


def reference_pairs(
    df: DataFrame, point: int, variable: str = "value", reference_variable: str | None = None, member: str = "m",
    time: str | None = None, lag: int | None = None,
) -> DataFrame:
    """Pairs (point_id, time, m, a, b) of every point with a reference point.

    b is ``variable`` at the point, a ``reference_variable`` (the same if none
    is named) at the reference point, along the axis ``member``. Where the
    field has another axis, ``time``, the reference is taken at the same
    place of it, or at the fixed place ``lag`` for every row. An axis m that
    isn't the members' here is called ``member``.
    """
    ref = df.filter(F.col("point_id") == point)
    both = [] if time is None else [F.col(time).alias(_axis(time))]
    a = F.col(reference_variable or variable).alias("a")
    if time is not None and lag is not None:
        ref = ref.filter(F.col(time) == lag).select(F.col(member).alias("m"), a)
    else:
        ref = ref.select(F.col(member).alias("m"), *both, a)
    rows = df.select("point_id", *both, F.col(member).alias("m"), F.col(variable).alias("b"))
    return rows.join(bounded(ref), [c for c in ref.columns if c != "a"])


def _told(value: Column, bad: Column, n: Column) -> Column:
    return F.when(n == 1, 1.0).when(bad, F.lit(float("nan"))).otherwise(value)


def pearson(pairs: DataFrame, keys: list[str] = KEY, eps: float = 0.0) -> DataFrame:
    """Pearson's correlation; null for a constant side, or 0 with ``eps`` in the divisor."""
    return pairs.groupBy(*keys).agg(F.when(F.count("*") == 1, 1.0).otherwise(covariance_ratio(eps=eps)).alias("value"))


def pearson_one_pass(pairs: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Pearson's correlation from five sums; cheaper to maintain, less exact for large means."""
    a, b, n = F.col("a"), F.col("b"), F.count("*")
    sa, sb = F.sum("a"), F.sum("b")
    spread = F.sqrt((n * F.sum(a * a) - sa * sa) * (n * F.sum(b * b) - sb * sb))
    return pairs.groupBy(*keys).agg(F.when(n == 1, 1.0).otherwise((n * F.sum(a * b) - sa * sb) / F.nullif(spread, F.lit(0.0))).alias("value"))


def ranked(pairs: DataFrame, column: str, keys: list[str] = KEY) -> DataFrame:
    """The column as fractional ranks: ties share the mean of their ranks."""
    w = Window.partitionBy(*keys)
    rank = F.rank().over(w.orderBy(column)) + (F.count("*").over(Window.partitionBy(*keys, column)) - 1) / 2
    return pairs.withColumn(column, rank)


def spearman(pairs: DataFrame, keys: list[str] = KEY) -> DataFrame:
    pairs = pairs.withColumn("bad", F.isnan("a") | F.isnan("b"))
    one = _told(covariance_ratio(), F.bool_or("bad"), F.count("*"))
    return ranked(ranked(pairs, "a", keys), "b", keys).groupBy(*keys).agg(one.alias("value"))


def packed(pairs: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """One row for each key with both vectors, in order of m."""
    both = F.sort_array(F.collect_list(F.struct("m", "a", "b")))
    return pairs.groupBy(*keys).agg(both.alias("p")).select(*keys, F.col("p.a").alias("a"), F.col("p.b").alias("b"))


def kendall(pairs: DataFrame, keys: list[str] = KEY, variant: str = "tau_b") -> DataFrame:
    """Kendall's tau (see kernels.kendall); n log n in each vector."""
    return packed(pairs, keys).select(*keys, of_vectors("kendall", variant=variant).alias("value"))


def kendall_by_signs(pairs: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """tau-a as the mean of sign products over all pairs of members: the slow form, to check others by."""
    x, y = (pairs.select(*keys, *[F.col(c).alias(f"{c}{k}") for c in ("m", "a", "b")]) for k in (1, 2))
    both = x.join(y, keys).filter("m1 < m2")
    sign = F.signum(F.col("a1") - F.col("a2")) * F.signum(F.col("b1") - F.col("b2"))
    return both.groupBy(*keys).agg((F.sum(sign) / F.count("*")).alias("value"))


def mi_binned(pairs: DataFrame, low: float | None = None, high: float | None = None, bins: int = 80, keys: list[str] = KEY) -> DataFrame:
    """Mutual information of a joint histogram, in nats: H(a) + H(b) - H(a, b).

    Without bounds, bins span the smallest and largest value of each key.
    """
    w = Window.partitionBy(*keys)
    lo, hi = F.lit(low), F.lit(high)
    if low is None:
        pairs = pairs.withColumns({"lo": F.min(F.least("a", "b")).over(w), "hi": F.max(F.greatest("a", "b")).over(w)})
        lo, hi = F.col("lo"), F.col("hi")
    at = lambda c: bin_of(F.col(c), lo, hi, bins)
    joint = pairs.groupBy(*keys, at("a").alias("i"), at("b").alias("j"))
    joint = joint.agg(F.count("*").alias("c"), F.bool_or(F.isnan("a") | F.isnan("b")).alias("bad"))
    sizes = {"n": F.sum("c").over(w), "ci": F.sum("c").over(Window.partitionBy(*keys, "i")), "cj": F.sum("c").over(Window.partitionBy(*keys, "j"))}
    p = F.col("c") / F.col("n")
    mi = F.sum(p * F.log(p * F.col("n") * F.col("n") / (F.col("ci") * F.col("cj"))))
    return joint.withColumns(sizes).groupBy(*keys).agg(_told(mi, F.bool_or("bad"), F.max("n")).alias("value"))


def mi_ksg(pairs: DataFrame, k: int | None = None, estimator: int = 1, keys: list[str] = KEY, noise: float = 0.0) -> DataFrame:
    """Kraskov's estimate of mutual information (1 or 2), without jitter unless ``noise`` is given."""
    return packed(pairs, keys).select(*keys, of_vectors("mi_ksg", k=k, estimator=estimator, noise=noise).alias("value"))


MEASURES = {"pearson": pearson, "spearman": spearman, "kendall": kendall, "mi_binned": mi_binned, "mi_ksg": mi_ksg}


def measured(pairs: DataFrame, measure: str, keys: list[str] = KEY, absolute: bool = False, **options) -> DataFrame:
    """(keys, value) of a named measure; ``mi_..._coefficient`` turns information into a correlation."""
    name = measure.removesuffix("_coefficient")
    out = MEASURES[name](pairs, keys=keys, **options)
    if name != measure:
        out = out.withColumn("value", mi_coefficient(F.col("value")))
    return out.withColumn("value", F.abs("value")) if absolute else out


def correlation_field(df: DataFrame, point: int, measure: str = "pearson", absolute: bool = False, options: dict | None = None, **pairing) -> DataFrame:
    """The measure of every point with a reference point: (point_id, time, value).

    ``pairing`` is passed to reference_pairs: second variable, axis, time and
    lag; ``options`` to the measure: bins, bounds, k, estimator, variant.
    """
    pairs = reference_pairs(df, point, **pairing)
    keys = ["point_id"] + ([_axis(pairing["time"])] if pairing.get("time") else [])
    return measured(pairs, measure, keys, absolute, **options or {})


def same_point_field(df: DataFrame, first: str, second: str, measure: str = "pearson", keys: list[str] = KEY, member: str = "m", **options) -> DataFrame:
    """The measure of two variables at the same point, along the axis ``member``."""
    return measured(df.select(*keys, F.col(member).alias("m"), F.col(first).alias("a"), F.col(second).alias("b")), measure, keys, **options)


#: Steps of a series that are one group of the windowed operators, besides what its first windows look back on.
CHUNK = 4096


def windowed(series: DataFrame, reference: str, length: int = 32, measure: str = "pearson", **options) -> DataFrame:
    """The measure of each series with the reference in every full window of ``length`` steps.

    A series is cut into chunks of steps, each with all the steps that its
    first windows look back on, however many chunks before these lie in, so a
    long series is many tasks' work.
    """
    ref = series.filter(F.col("sidx") == reference).select("t", F.col("value").alias("a"))
    own = F.floor(F.col("t") / CHUNK)
    # the last window that holds a step begins there and ends length - 1 steps on
    chunks = F.sequence(own, F.floor((F.col("t") + (length - 1)) / CHUNK))
    df = series.withColumnRenamed("value", "b").join(ref, "t").withColumns({"own": own, "chunk": F.explode(chunks)})
    w = Window.partitionBy("sidx", "chunk").orderBy("t").rowsBetween(1 - length, 0)
    names = {"first": F.min("t").over(w), "n": F.count("*").over(w)}
    if measure == "pearson":
        spread = F.stddev_samp("a").over(w) * F.stddev_samp("b").over(w)
        names["value"] = F.covar_samp("a", "b").over(w) / F.nullif(spread, F.lit(0.0))
    else:
        names |= {"va": F.collect_list("a").over(w), "vb": F.collect_list("b").over(w)}
    df = df.withColumns(names).filter((F.col("n") == length) & (F.col("t") - F.col("first") == length - 1) & (F.col("own") == F.col("chunk")))
    if measure != "pearson":
        df = df.withColumn("value", of_vectors(measure, "va", "vb", **options))
    return df.select("sidx", "t", "value")
