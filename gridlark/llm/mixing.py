"""Mixing sources to target weights, in DataFrame functions only.

Every source gets a target of words; what exceeds three times a source is
shared again by weight. A source is first taken whole as often as its target
allows. The rest comes from Efraimidis-Spirakis sampling without replacement:
each document draws the exponential key -ln(u) / w, where w is its quality
weight, and the smallest keys win until the source's words are reached. The
document at the edge gives only the words that are missing.

The prefix sum over a source is taken over a histogram of its keys, first by
doublings of the key, then by the BINS parts of the one doubling in which the
target falls; only the documents of one part are sorted. Whatever the weights,
a part holds at most 0.26 / BINS of the keys expected, so a source with a
third of all rows is no task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, few_rows, words

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
BINS = 1024


def quality_weight(size: Column, text: Column) -> Column:
    """0.05 to 1: short texts and texts full of marks are drawn more rarely."""
    marks = F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>!{}]", ""))
    clean = F.lit(1.0) - F.when(text.rlike("[#*$%&|<>!{}]"), marks * 5.0 / F.length(text)).otherwise(0.0)
    return F.greatest(F.lit(0.05), clean) * F.greatest(F.lit(0.05), F.least(F.lit(1.0), size / 50.0))


def drawn(docs: DataFrame, source: str, text: str, doc_id: str, seed: int) -> DataFrame:
    """docs with src (a key that null has too), size, key and bin added to it."""
    body = F.coalesce(F.col(text), F.lit(""))
    h = F.xxhash64(F.lit(seed), F.col(doc_id), body)
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(2**53))
    df = docs.withColumn("size", F.size(words(F.col(text))).cast("long"))
    df = df.withColumn("key", -F.log(u) / quality_weight(F.col("size"), body))
    return df.withColumns(
        {
            "src": F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source), F.lit("")).alias("name")),
            "bin": F.floor(F.log2(F.greatest(F.col("key"), F.lit(2.0**-80))) * BINS).cast("int"),
        }
    )


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(src, source_size) to (src, source_size, target).

    Weights go round over the sources in code point order, null last. The
    water level is found in one pass over sources by cap / weight: the first
    of them that the level of it and all later ones does not overflow.
    """
    turn = (F.row_number().over(Window.orderBy("src")) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)
    df = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    every, before = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    df = df.withColumns(
        {
            "words": F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), zero),
            "shares": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero),
            "turn": F.row_number().over(order),
        }
    ).withColumn("level", F.col("words") / F.col("shares"))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("turn"))).over(every)
    return df.select("src", "source_size", F.least("cap", level * F.col("weight")).alias("target"))


def _fallen(groups: DataFrame, group: str, wanted: DataFrame) -> DataFrame:
    """The group of each source in which its rest falls, with the words before it.

    groups has src, the group's place and words; wanted has src, rest and the
    words ahead of the source's first group.
    """
    by_place = Window.partitionBy("src").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    df = groups.withColumn("sum", F.coalesce(F.sum("words").over(by_place), F.lit(0))).join(wanted, "src")
    df = df.withColumn("before", F.col("ahead") + F.col("sum"))
    return df.filter("before < rest AND before + words >= rest")


def planned(rows: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """What each source gives: (src, source_size, target, epochs, edge).

    rows has doc_id, src, size, key and bin. ``edge`` is the place at which
    sampling stops (key, id) with the words that a row there gives; null where
    nothing but complete epochs is taken.
    """
    per_bin = checkpointed(rows.groupBy("src", "bin").agg(F.sum("size").alias("words")))
    goal = targets(per_bin.groupBy("src").agg(F.sum("words").alias("source_size")), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("epochs", epochs.cast("long"))
    rest = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    goal = checkpointed(goal.withColumn("rest", F.when(F.col("epochs") >= most, F.lit(0)).otherwise(rest).cast("long")))
    doubling = F.floor(F.col("bin") / BINS).cast("int").alias("doubling")
    wanted = goal.filter("rest > 0").select("src", "rest", F.lit(0).cast("long").alias("ahead"))
    at = _fallen(per_bin.groupBy("src", doubling).agg(F.sum("words").alias("words")), "doubling", wanted)
    at = at.select("src", "rest", F.col("doubling").alias("within"), F.col("before").alias("ahead"))
    parts = per_bin.select("src", "bin", "words", doubling).join(few_rows(at), "src").filter("doubling = within")
    at = _fallen(parts.select("src", "bin", "words"), "bin", few_rows(at.select("src", "rest", "ahead")))
    at = at.select("src", "bin", "before", "rest")
    few = rows.select("src", "bin", "doc_id", "key", "size").join(few_rows(at), ["src", "bin"])
    same = few.groupBy("src", "key", "doc_id").agg(
        F.sum("size").alias("words"), F.count("*").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest")
    )
    by_key = Window.partitionBy("src").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    same = same.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(by_key), F.lit(0)))
    edge = same.filter("before < rest AND before + words >= rest").select(
        "src",
        F.struct("key", F.col("doc_id").alias("id"), ((F.col("rest") - F.col("before")) / F.col("n")).cast("long").alias("part")).alias("edge"),
    )
    return goal.join(edge, "src", "left").select("src", "source_size", "target", "epochs", "edge")


def taken_words(doc_id: str = "doc_id") -> Column:
    """Words that the mix takes of a row that has size, key, epochs and edge."""
    key, edge, own = F.col("key"), F.col("edge"), F.col(doc_id)
    same = (key == edge["key"]) & own.eqNullSafe(edge["id"])
    ahead = (key < edge["key"]) | (
        (key == edge["key"]) & ((own < edge["id"]) | (own.isNull() & edge["id"].isNotNull()))
    )
    extra = F.when(edge.isNull(), 0).when(same, edge["part"]).when(ahead, F.col("size")).otherwise(0)
    return (F.col("epochs") * F.col("size") + extra).cast("long")


def mixed_sizes(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs.

    docs has doc_id, source and text; other columns are left aside, so their
    names can't clash. Null text has size 0; null source is a source of its
    own. Repeated rows draw one key and are taken alike; rows of equal keys
    are taken in order of doc_id, null last. A very long text is one row like
    others, of which the edge of a source may take a part. An empty table
    gives an empty table, one without any word targets of 0.
    """
    docs = docs.select("doc_id", "source", "text")
    rows = checkpointed(drawn(docs, "source", "text", "doc_id", seed).select("doc_id", "src", "size", "key", "bin"))
    plan = few_rows(planned(rows, weights, most))
    df = rows.join(plan, "src")
    return df.select("doc_id", "size", "source_size", "target", taken_words().alias("taken"))


def stage(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 7) -> DataFrame:
    """The mix itself: a row for each time that a document is taken, in docs' columns.

    The document at a source's edge comes with the first words only (joined
    by single spaces); documents that are not taken are left out.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row = row.select("row", *[F.col("row")[c].alias(c) for c in ("doc_id", "source", "text")])
    slim = drawn(row.drop("row"), "source", "text", "doc_id", seed).select("doc_id", "src", "size", "key", "bin")
    plan = few_rows(planned(checkpointed(slim), weights, most))
    df = drawn(row, "source", "text", "doc_id", seed).join(plan, "src").withColumn("taken", taken_words())
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    df = df.withColumn("whole", whole).withColumn("left", (F.col("taken") - F.col("whole") * F.col("size")).cast("int"))
    copies = F.concat(F.array_repeat(F.lit(0), F.col("whole")), F.when(F.col("left") > 0, F.array(F.col("left"))).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("part", F.explode(copies))
    text = F.when(F.col("part") > 0, F.array_join(F.slice(words(F.col("text")), F.lit(1), F.greatest("part", F.lit(1))), " "))
    text = text.otherwise(F.col("row")["text"])
    return df.select(*[(text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
