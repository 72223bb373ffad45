"""Feature vectors of points and members, sampling of points, and labels of linked nodes (for clusters see density)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions.kernels import of_vectors
from gridlark.functions.sequences import METHODS, cell
from gridlark.operators.regions import point_vectors
from gridlark.session import checkpointed


def sampled_points(spark: SparkSession, sizes: tuple, n: int, border: int = 0, mask: DataFrame | None = None, method: str = "plastic", most: int = 100) -> DataFrame:
    """(x, y, z) of the first n distinct points that the sequence hits inside the border and the mask.

    At most ``most`` times n numbers of the sequence are tried.
    """
    s = METHODS[method](F.col("id"), 3)
    df = spark.range(n * most).select("id", *[cell(c, F.lit(size)).alias(a) for c, a, size in zip(s, "xyz", sizes)])
    for a, size in zip("xyz", sizes):
        df = df.filter(F.col(a).between(border, size - 1 - border))
    if mask is not None:
        df = df.join(mask.filter("value > 0.5").select("x", "y", "z").distinct(), ["x", "y", "z"], "left_semi")
    first = df.groupBy("x", "y", "z").agg(F.min("id").alias("id"))
    return first.orderBy("id").limit(n).select("x", "y", "z")


def neighbourhood_features(df: DataFrame, sizes: tuple, radius: int = 1, measure: str = "pearson", **options) -> DataFrame:
    """(x, y, z, k, value): the measure of each point with its (2 * radius + 1) ** 3 neighbours.

    Places beyond the border are those at the border; what is not a number is 0.
    """
    span = range(-radius, radius + 1)
    offsets = [F.struct(F.lit(n).alias("k"), *[F.lit(v).alias(a) for v, a in zip(o, "xyz")]) for n, o in enumerate((i, j, k) for k in span for j in span for i in span)]
    vectors = point_vectors(df)
    asked = vectors.select("x", "y", "z", F.col("v").alias("a"), F.explode(F.array(*offsets)).alias("o"))
    at = [F.least(F.greatest(F.col(a) + F.col(f"o.{a}"), F.lit(0)), F.lit(n - 1)).alias(f"q{a}") for a, n in zip("xyz", sizes)]
    asked = asked.select("x", "y", "z", "a", F.col("o.k").alias("k"), *at)
    met = asked.join(vectors.select(*[F.col(a).alias(f"q{a}") for a in "xyz"], F.col("v").alias("b")), ["qx", "qy", "qz"], "left")
    value = of_vectors(measure, **options)
    return met.select("x", "y", "z", "k", F.nanvl(value, F.lit(0.0)).alias("value"))


def point_features(df: DataFrame) -> DataFrame:
    """(point_id, k, value): a point's members as its features, 0 for NaN."""
    return df.select("point_id", F.col("m").alias("k"), F.nanvl("value", F.lit(0.0)).alias("value"))


def member_features(df: DataFrame) -> DataFrame:
    """(m, k, value): a member's points as its features, 0 for NaN."""
    return df.select("m", F.col("point_id").alias("k"), F.nanvl("value", F.lit(0.0)).alias("value"))


def least_labels(edges: DataFrame, nodes: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, label): the smallest id that each node reaches; labels of labels are taken in every round."""
    now = checkpointed(nodes.select("id", F.col("id").alias("label")))
    for _ in range(most_rounds):
        met = edges.join(now.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("label").alias("near"))
        step = now.join(met, "id", "left").select("id", F.least("label", "near").alias("label"))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("further"))
        step = step.join(jump, "label", "left").select("id", F.least("label", "further").alias("label"))
        step = checkpointed(step)
        moved = step.join(now.withColumnRenamed("label", "was"), "id").filter("label <> was").limit(1).count()
        now = step
        if not moved:
            return now
    raise RuntimeError(f"labels did not settle in {most_rounds} rounds")
