"""What operators need of the session: checkpoints in the shared folder, and broadcasts behind a count."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast, once it is counted to have no more.
MOST_ROWS = 1_000_000


def bounded(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """df, marked for broadcast if it is counted to have at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of df in the folder of spark.checkpoint.dir; only a local session may lack that setting."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not found and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="gridlark-"))
    return df.checkpoint(eager=True)
