"""Windowed correlation of event series as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.functions.measures import covariance_ratio


def windowed_correlation(
    events: DataFrame, names: list[str], reference: str, seconds: int = 21600, length: int = 32, late: str = "1 day"
) -> DataFrame:
    """(sidx, t, value) of every full window of ``length`` steps, once the watermark has passed it.

    events has ts (timestamp), event_type and value. Two windowed
    aggregations follow each other: means of each series in each step, then
    correlations over sliding windows of steps. State is one row for each open
    step and window, however many events they hold. Append mode.
    """
    mean = [F.avg(F.when(F.col("event_type") == n, F.col("value"))).alias(f"s{k}") for k, n in enumerate(names)]
    steps = events.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds")).agg(*mean)
    span = F.window(F.window_time("window"), f"{seconds * length} seconds", f"{seconds} seconds")
    ref = f"s{names.index(reference)}"
    told = []
    for k in range(len(names)):
        both = F.col(ref).isNotNull() & F.col(f"s{k}").isNotNull()
        told += [covariance_ratio(ref, f"s{k}").alias(f"c{k}"), F.count_if(both).alias(f"n{k}")]
    wide = steps.groupBy(span).agg(*told)
    last = (F.unix_timestamp("window.end") / seconds - 1).cast("long")
    rows = F.array(*[F.struct(F.lit(n).alias("sidx"), F.col(f"c{k}").alias("value"), F.col(f"n{k}").alias("n")) for k, n in enumerate(names)])
    return wide.select(last.alias("t"), F.inline(rows)).filter(F.col("n") == length).select("sidx", "t", "value")
