"""Line dedup by a log-template tree, in DataFrame functions only.

A line walks down a tree of fixed depth: first by its number of tokens, then
by its leading tokens. Tokens that hold a digit are variable fields (``<*>``)
everywhere. In a leaf, a line's template is the line with its variable fields
open; where single lines of a busy leaf are rare, the positions at which the
leaf's lines differ are opened too, as long as most of the template stays
fixed. Templates that recur in ``min_docs`` documents or more are dropped
from all documents but the first (the smallest doc_id). ``long_docs`` sets
another least number of documents for lines of over ``LONG`` words, which
don't recur by chance; it holds for lines that are equal but for their
variable fields.

Only hashes are shuffled for counting, added up before the shuffle; texts
move once, to meet the numbers of the lines they lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, few_rows, words, written

VARIABLE = "(?<![^\\x20\\x09-\\x0D])[^\\x20\\x09-\\x0D0-9]*+[0-9][^\\x20\\x09-\\x0D]*+"
OPEN = "<*>"
#: A line of more words is long; documents in which a line, and a long one, recurs.
LONG = 50
MIN_DOCS, LONG_DOCS = 10, 2


def masked(line: Column) -> Column:
    """The line with every token that holds a digit as a variable field."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, VARIABLE, OPEN)).otherwise(line)


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """One row for each line with a word: id, text_hash, pos, leaf, line (hash) and tokens."""
    at = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text")
    df = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), at).filter(F.col("text").rlike(WORD))
    df = df.withColumn("tokens", words(masked(F.col("text"))))
    return df.select(
        "doc_id",
        "text_hash",
        "pos",
        F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth)).alias("leaf"),
        F.xxhash64(F.array_join("tokens", " ")).alias("line"),
        "tokens",
    )


def _first() -> Column:
    """The place of the first occurrence; null doc_ids come last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "pos")).alias("first")


def templates(docs: DataFrame, min_docs: int, depth: int, share: float, fixed: float, long_docs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The lines of docs, and the recurring ones among them (leaf, line, first) to drop by.

    A line, and so a template, is counted once for each document; lines that
    are less than ``fixed`` outside their variable fields don't recur, since
    little of them is the same. ``share`` is the part of a
    leaf's documents in which a token must stand at its position to be fixed,
    ``fixed`` the part of a template that must be.
    """
    full = _lines(docs, depth)
    firm = F.size(F.filter("tokens", lambda t: t != OPEN)) >= F.size("tokens") * fixed
    # null, which no count reaches, where too little is fixed
    need = F.when(~firm, None).when(F.size("tokens") > LONG, long_docs or min_docs).otherwise(min_docs)
    lines = written(full.withColumn("need", need).drop("tokens"), "lines")
    once = lines.groupBy("leaf", "line", "need", "doc_id", "text_hash").agg(F.min("pos").alias("pos"))
    per_line = written(once.groupBy("leaf", "line", "need").agg(F.count("*").alias("n"), _first()), "line-counts")
    exact = per_line.filter(F.col("n") >= F.col("need")).select("leaf", "line", "first")
    # rare lines of leaves that recur all the same: open the positions that vary
    rare = per_line.filter(F.col("n") < min_docs)
    busy = rare.groupBy("leaf").agg(F.sum("n").alias("docs"), F.count("*").alias("k"))
    # few_rows: a table of its own, so that the join doesn't gather a leaf's lines in one task
    busy = few_rows(busy.filter((F.col("docs") >= min_docs) & (F.col("k") > 1)).select("leaf", "docs"))
    rare = rare.join(busy, "leaf")
    # tokens come from the documents in which these lines stand first
    named = written(rare.select("leaf", "line", "docs", "n", "first", F.col("first.pos").alias("pos")), "rare-named")
    owners = few_rows(named.select(F.col("first.doc_id").alias("owner"), F.col("first.text_hash").alias("owner_hash")).distinct())
    held = F.col("doc_id").eqNullSafe(F.col("owner")) & (F.xxhash64("text") == F.col("owner_hash"))
    told = _lines(docs.join(owners, held, "left_semi"), depth).select("leaf", "line", "pos", "tokens")
    told = written(named.join(told, ["leaf", "line", "pos"]).dropDuplicates(["leaf", "line"]), "rare-lines")
    each = told.select("leaf", "docs", "n", F.posexplode("tokens").alias("place", "token"))
    common = each.groupBy("leaf", "place", "token").agg(F.sum("n").alias("k"), F.first("docs").alias("docs"))
    often = F.when(F.col("k") > F.col("docs") * share, F.struct("k", "token"))
    common = common.groupBy("leaf", "place").agg(F.max(often)["token"].alias("token"))
    # one entry for each position of a leaf's lines, null where it is open
    common = common.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("c"))
    common = few_rows(common.select("leaf", F.col("c.token").alias("constant")))
    opened = told.join(common, "leaf")
    opened = opened.withColumn("tokens", F.zip_with("tokens", "constant", lambda t, c: F.when(c == t, t).otherwise(OPEN)))
    held = F.size(F.filter("tokens", lambda t: t != OPEN))
    opened = opened.filter(held >= F.size("tokens") * fixed)
    opened = opened.select("leaf", "line", "n", "first", F.xxhash64("leaf", F.array_join("tokens", " ")).alias("template"))
    # a document may hold many lines of a template: where lines are enough, documents are counted
    recur = opened.groupBy("template").agg(F.sum("n").alias("docs"), F.min("first").alias("first"))
    recur = few_rows(recur.filter(F.col("docs") >= min_docs).select("template", F.col("first").alias("start")))
    opened = written(opened.select("leaf", "line", "template").join(recur, "template"), "recurring")
    each = lines.select("leaf", "line", "doc_id", "text_hash").join(opened, ["leaf", "line"])
    recur = each.groupBy("template", "start", "doc_id", "text_hash").agg(F.lit(1).alias("one")).groupBy("template", "start").agg(F.count("*").alias("docs"))
    recur = few_rows(recur.filter(F.col("docs") >= min_docs).select("template", F.col("start").alias("first")))
    general = opened.select("leaf", "line", "template").join(recur, "template").select("leaf", "line", "first")
    return lines, exact.union(general)


def dropped(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = 3, share: float = 0.5, fixed: float = 0.7, long_docs: int | None = None) -> DataFrame:
    """(doc_id, text_hash, drop): the numbers of the lines that each document loses."""
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    lines, recurring = templates(docs, min_docs, depth, share, fixed, long_docs)
    hit = lines.join(few_rows(recurring), ["leaf", "line"]).filter(
        ~(
            F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
            & (F.col("text_hash") == F.col("first.text_hash"))
            & (F.col("pos") == F.col("first.pos"))
        )
    )
    # a line has one row, a position of repeated rows one entry
    hit = hit.select("doc_id", "text_hash", "pos").distinct()
    return hit.groupBy("doc_id", "text_hash").agg(F.collect_list("pos").alias("drop"))


def deduped(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = 3, long_docs: int | None = None) -> DataFrame:
    """Every row of docs as ``row`` with ``clean_text``, ``n_lines`` and ``n_dropped``.

    n_lines counts lines with a word. Null text stays null. Texts that lose
    no line stay as they were; one that loses all is left empty. Repeated
    rows (one doc_id, one text) count as one document and lose the same
    lines. Rows without doc_id count like others and are the last to be
    the first occurrence. Very long texts and lines are processed whole, in
    time linear in their lines and words. Other columns are left in ``row``
    whatever their names; doc_id and text must be there. Lines are told apart
    by two 64-bit hashes, of the line and of its leaf. An empty table gives
    an empty table.
    """
    gone = dropped(docs, min_docs, depth, long_docs=long_docs).withColumnRenamed("doc_id", "gone_id").withColumnRenamed("text_hash", "gone_hash")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row = row.withColumn("hash", F.xxhash64(F.col("row")["text"]))
    df = row.join(gone, F.col("row")["doc_id"].eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash")), "left")
    df = df.withColumn("lines", F.split(F.col("row")["text"], "\n"))
    # set difference and access by number: linear in the lines of a text
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")
    left = F.transform(places, lambda i: F.get("lines", i))
    return df.select(
        "row",
        F.when(F.col("drop").isNull(), F.col("row")["text"]).otherwise(F.array_join(left, "\n")).alias("clean_text"),
        F.coalesce(F.size(F.filter("lines", lambda x: x.rlike(WORD))), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def stage(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = 3, long_docs: int | None = LONG_DOCS) -> DataFrame:
    """All documents without their recurring lines, in the columns of docs; odd rows as in ``deduped``."""
    df = deduped(docs, min_docs, depth, long_docs)
    return df.select(*[(F.col("clean_text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
