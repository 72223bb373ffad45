"""Similarity of whole fields: every voxel, time step and member is a pair of values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlark.functions.measures import bin_of, covariance_ratio
from gridlark.operators import whole
from gridlark.session import bounded, checkpointed


def global_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the fractional rank of a column over all rows.

    Values are counted first, and the distinct ones dealt out by range; a
    part's rows are numbered within it, from the total of the parts before.
    """
    counts = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(counts.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part").agg(F.sum("n").alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    totals = totals.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranks = dealt.join(F.broadcast(totals), "part")
    rank = F.col("ahead") + F.coalesce(F.sum("n").over(own), F.lit(0)) + (F.col("n") + 1) / 2
    ranks = checkpointed(ranks.select("v", rank.alias(out)))
    return df.join(bounded(ranks), df[column] == ranks["v"]).drop("v")


def field_similarity(df: DataFrame, first: str, second: str, measure: str = "pearson", bins: int = 80, low: float | None = None, high: float | None = None, **options) -> DataFrame:
    """One row (value): the measure of two columns over all rows; rows with NaN or null are left out.

    Binned information spans both columns' values unless bounds are given.
    No task holds a whole field, whatever the measure (see whole).
    """
    pairs = df.select(F.col(first).alias("a"), F.col(second).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    pairs = pairs.filter(~F.isnan("a") & ~F.isnan("b"))
    if measure == "pearson":
        return pairs.agg(covariance_ratio().alias("value"))
    if measure == "spearman":
        pairs = global_ranks(global_ranks(pairs, "a", "ra"), "b", "rb")
        return pairs.agg(covariance_ratio("ra", "rb").alias("value"))
    if measure == "mi_binned":
        return binned_matrix(pairs, [("a", "b")], bins, low, high).select("value")
    name = measure.removesuffix("_coefficient")
    value = {"kendall": whole.kendall, "mi_ksg": whole.mi_ksg}[name](pairs, **options)
    value = value if name == measure else math.sqrt(1 - math.exp(-2 * value))
    return df.sparkSession.createDataFrame([(value,)], "value double")


def binned_matrix(df: DataFrame, pairs: list[tuple[str, str]], bins: int = 80, low: float | None = None, high: float | None = None) -> DataFrame:
    """(a, b, value): binned information of pairs of columns, whose ends are found in one pass and whose histograms are counted in another."""
    valid = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    full = [valid(a) & valid(b) for a, b in pairs]
    ends = [(low, high)] * len(pairs)
    if low is None:
        asked = [f(F.when(ok, g(a, b))).alias(f"{k}:{n}") for k, ((a, b), ok) in enumerate(zip(pairs, full)) for n, f, g in ((0, F.min, F.least), (1, F.max, F.greatest))]
        found = df.agg(*asked).first()
        ends = [(found[2 * k], found[2 * k + 1]) for k in range(len(pairs))]
    at = lambda c, k: bin_of(F.col(c), F.lit(ends[k][0]), F.lit(ends[k][1]), bins)
    each = [F.when(ok, F.struct(F.lit(k).alias("k"), at(a, k).alias("i"), at(b, k).alias("j"))) for k, ((a, b), ok) in enumerate(zip(pairs, full))]
    # bins * bins rows of a pair at the most
    joint = df.select(F.explode(F.array(*each)).alias("c")).filter("c IS NOT NULL").groupBy("c.k", "c.i", "c.j").agg(F.count("*").alias("c"))
    of = lambda *by: F.sum("c").over(Window.partitionBy("k", *by))
    joint = joint.withColumns({"p": F.col("c") / of(), "pi": of("i") / of(), "pj": of("j") / of()})
    told = joint.groupBy("k").agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("pi") * F.col("pj")))).alias("value"))
    names = df.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    return names.join(told, "k", "left").select("a", "b", "value")


def similarity_matrix(df: DataFrame, variables: list[str], measure: str = "pearson", **options) -> DataFrame:
    """(a, b, value) of every pair of columns; Pearson takes one pass for all of them."""
    pairs = [(a, b) for k, a in enumerate(variables) for b in variables[:k]]
    if measure == "pearson":
        one = df.agg(*[covariance_ratio(a, b).alias(f"{a}:{b}") for a, b in pairs])
        rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}:{b}").alias("value")) for a, b in pairs])
        return one.select(F.inline(rows))
    if len(pairs) > 1 or measure == "mi_binned":
        # a field is made once, and not again for each pair and pass
        df = checkpointed(df.select(*variables))
    if measure == "mi_binned":
        return binned_matrix(df, pairs, **options)
    if measure == "spearman" and not df.agg(*[F.count_if(F.col(v).isNull() | F.isnan(v)).alias(v) for v in variables]).filter(" + ".join(variables) + " > 0").count():
        # nothing is left out of any pair, so each variable is ranked once
        for v in variables:
            df = global_ranks(df, v, f"{v}:rank")
        ranks = df.select(*[F.col(f"`{v}:rank`").alias(v) for v in variables])
        return similarity_matrix(ranks, variables, "pearson")
    out = None
    for a, b in pairs:
        one = field_similarity(df, a, b, measure, **options).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "value")
        out = one if out is None else out.union(one)
    return out
