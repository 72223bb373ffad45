"""The streaming windowed correlation against the batch one, over the whole events table."""

import os

import pytest
from pyspark.sql import functions as F

from gridlark.fields import event_series
from gridlark.operators.dependence import windowed
from gridlark.streaming.windowed import windowed_correlation

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_windowed_as_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    names = sorted(r[0] for r in events.select("event_type").distinct().collect())
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    cuts = [low, low + (high - low) / 2, high + (high - low) / 100]
    src = str(tmp_path / "in")
    for a, b in zip(cuts, cuts[1:]):
        events.filter((F.col("ts") >= a) & (F.col("ts") < b)).coalesce(1).write.mode("append").parquet(src)
    # an event a year on moves the watermark past all others
    last = spark.createDataFrame([(high.replace(year=high.year + 1), names[0], 0.0)], events.schema)
    last.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = windowed_correlation(stream, names, "click")
    query = (
        out.writeStream.format("memory").queryName("told").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(100)
    got = {(r.sidx, r.t): r.value for r in spark.table("told").collect()}
    want = {(r.sidx, r.t): r.value for r in windowed(event_series(spark, SF), "click", 32).collect()}
    assert len(want) > 100 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
