"""Corpus pipeline: quality rules, line dedup, near dedup, mixing, packing.

Null and empty texts fail the quality rules and go there; rows without doc_id
stay, and are copies of nothing. Repeated rows are judged alike, and are one
document to near dedup, which leaves all of them. Very long texts are
processed whole. Columns besides doc_id, text and source pass through to
packing, whatever their names. An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlark.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from gridlark.llm.common import written
from gridlark.llm.queries import tokenizer_path


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop failing lines, and the documents that the rules reject."""
    return quality_rules.stage(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines whose template recurs across documents."""
    return line_dedup.stage(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five words, 80 %)."""
    return near_dedup.stage(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source as often as its target asks."""
    return mixing.stage(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in sequences of at most 4096 tokens."""
    return packing.stage(docs, tokenizer_path())


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("near_dedup", near), ("mixing", mix), ("packing", pack)]
#: Packing counts the ids of a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = written(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
