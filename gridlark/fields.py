"""Fields made from tables: rows of (point_id, x, y, z, m, value), m being the member axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GRID = 10


def placed(df: DataFrame, point: str = "point_id", xs: int = GRID, ys: int = GRID) -> DataFrame:
    """Add grid places x, y, z of a point number in which x runs fastest."""
    p = F.col(point)
    return df.withColumns({"x": p % xs, "y": F.floor(p / xs) % ys, "z": F.floor(p / (xs * ys))})


def embedding_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as an ensemble: a point for each vector, a member for each component."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    df = df.select(F.col("vec_id").alias("point_id"), F.posexplode("embedding").alias("m", "value"))
    return placed(df.withColumn("value", F.col("value").cast("double")))


def lineitem_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of four variables for each supplier (point), year (t) and line number (m)."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return placed(
        df.groupBy(
            F.col("l_suppkey").alias("point_id"), (F.year("l_shipdate") - 1995).alias("t"), F.col("l_linenumber").alias("m")
        ).agg(*[F.avg(f"l_{v}").alias(v) for v in ("quantity", "extendedprice", "discount", "tax")])
    )


def ordered_lineitem_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem_field`` with sums in the order of the table's rows, however the table is split.

    Sums of doubles depend on their order, and ranks tell means apart that
    differ in the last place only. Here equal rows give equal ranks on any
    cluster, and those of SQL that reads the table from its first row to its last.
    """
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    names = ("quantity", "extendedprice", "discount", "tax")
    df = df.select(
        F.col("l_suppkey").alias("point_id"), (F.year("l_shipdate") - 1995).alias("t"), F.col("l_linenumber").alias("m"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), *[F.col(f"l_{v}").alias(v) for v in names],
    )
    w = Window.partitionBy("point_id", "t", "m").orderBy("file", "row")
    means = {v: F.avg(v).over(w.rowsBetween(Window.unboundedPreceding, 0)) for v in names}
    df = df.withColumns(means | {"last": F.lead("row").over(w).isNull()}).filter("last")
    return placed(df.select("point_id", "t", "m", *names))


def event_series(spark: SparkSession, sf_dir: str, seconds: int = 21600) -> DataFrame:
    """(sidx, t, value): mean values of each event type in steps of ``seconds``."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    step = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds)
    return df.groupBy(F.col("event_type").alias("sidx"), step.alias("t")).agg(F.avg("value").alias("value"))


def holes(df: DataFrame) -> DataFrame:
    """Put NaN where point_id % 17 = 3 and m % 13 = 5, to see what operators make of it."""
    gap = (F.col("point_id") % 17 == 3) & (F.col("m") % 13 == 5)
    return df.withColumn("value", F.when(gap, F.lit(float("nan"))).otherwise(F.col("value")))
