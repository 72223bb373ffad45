"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word definition here: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is missing, a local session gets a temporary folder of
    its own; a cluster is refused, since its machines don't share one.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(found)
        return found
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridlark-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder; later reads can prune its columns."""
    path = f"{shared_dir(df.sparkSession)}/gridlark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def emptied(*tables: DataFrame) -> None:
    """Give back the space of written tables that nothing reads any longer."""
    for df in tables:
        files = df.inputFiles()
        if files:
            df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(files[0].rpartition("/")[0])


#: A table that is counted to have so many rows is broadcast; a larger one is joined by shuffling.
FEW = 100_000


def few_rows(df: DataFrame, most: int = FEW) -> DataFrame:
    """df marked for broadcast if it is counted to have at most ``most`` rows."""
    return hinted(checkpointed(df), most)[0]


def hinted(df: DataFrame, most: int = FEW) -> tuple[DataFrame, int]:
    """A checkpointed df, marked for broadcast if it has at most ``most`` rows, and their number."""
    n = df.count()
    return (F.broadcast(df) if n <= most else df), n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def folded(text: Column) -> Column:
    """Text with A-Z, and nothing else, in lower case."""
    return F.translate(text, UPPER, LOWER)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def slots(df: DataFrame, least: int = 1) -> int:
    """Partitions for work that is heavier than its bytes: those of the session's shuffles."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
