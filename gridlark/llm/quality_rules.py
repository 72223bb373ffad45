"""Line-first quality rules, in DataFrame functions only.

Every line of a text is judged by punctuation, navigation and boilerplate
rules; failing lines are removed, and a document that loses too much of its
text with them is rejected. Document statistics (words, symbols, repeated
lines and repeated five-word windows) come beside the verdict.

Nothing is shuffled: each document is judged in its own row, so skewed
sources or groups of copies make no difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, words, written

# The characters of n_symbols, those of the punctuation rule,
# and phrases of boilerplate lines.
SYMBOLS = "#*$%&|<>"
MARKS = "#*$%&|<>!{}[]=~^_\\@+"
SEPARATORS = "|»›•·>"
BOILERPLATE = (
    "all rights reserved",
    "terms of (use|service)",
    "privacy policy",
    "cookie (policy|settings)",
    "accept (all )?cookies",
    "licensed under",
    "released under the",
    "this work is licensed",
    "copyright \\(c\\)",
    "©",
    "lorem ipsum",
    "enable javascript",
    "subscribe to our",
    "sign up for",
    "click here",
    "share (this|on)",
    "powered by",
    "skip to (main )?content",
)


def character_class(marks: str) -> str:
    return "[" + "".join("\\" + x if x in "[]^\\&-" else x for x in marks) + "]"


def _count_of(text: Column, marks: str) -> Column:
    """How many characters of text are marks; most texts have none and are only scanned."""
    left = F.regexp_replace(text, character_class(marks), "")
    return F.when(text.rlike(character_class(marks)), F.length(text) - F.length(left)).otherwise(0)


def line_fails(line: Column, max_marks: int = 10, max_separators: int = 3, max_item_chars: int = 40) -> Column:
    """True for a line that a rule rejects.

    punctuation: over max_marks in a hundred of its characters are marks;
    navigation: at least max_separators separators, with fewer than
    max_item_chars characters to each; boilerplate: one of the phrases in a
    line of at most 200 characters.
    """
    size = F.length(line)
    marks, breaks = _count_of(line, MARKS), _count_of(line, SEPARATORS)
    phrase = "(?i)(" + "|".join(BOILERPLATE) + ")"
    return (
        (marks * 100 > size * max_marks)
        | ((breaks >= max_separators) & (size < breaks * max_item_chars))
        | ((size <= 200) & line.rlike(phrase))
    )


def repeated_words(df: DataFrame, word_list: str, out: str, window: int = 5) -> DataFrame:
    """Add how many words lie in windows that occur twice or more in the array.

    Windows are compared by 64-bit hashes within one document. Documents in
    which no window recurs stop after a distinct; the others sort (hash,
    position) pairs, so the cost is n log n for any repetition.
    """
    h, s, p = f"{out}_h", f"{out}_s", f"{out}_p"
    n = F.size(word_list)
    df = df.withColumn(h, F.transform(word_list, lambda w: F.xxhash64(w)))
    grams = F.when(
        n >= window,
        F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])),
    )
    df = df.withColumn(h, grams)
    pairs = F.when(
        F.size(F.array_distinct(h)) < F.size(h),
        F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
    )
    df = df.withColumn(s, pairs)
    twin = F.filter(
        s,
        lambda x, i: (F.get(s, i - 1)["h"].eqNullSafe(x["h"]) & (i > 0)) | F.get(s, i + 1)["h"].eqNullSafe(x["h"]),
    )
    df = df.withColumn(p, F.sort_array(F.transform(twin, lambda x: x["i"])))
    start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(
        p,
        start,
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(window), x - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop(h, s, p)


def judged(
    docs: DataFrame,
    text: str = "text",
    min_words: int = 10,
    max_repeat: int = 20,
    max_lost: float = 0.5,
) -> DataFrame:
    """Judge every row of docs.

    Returns ``row`` (a struct of all input columns, whatever their names),
    ``clean_text``, ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``lost`` (the removed share of the
    characters in words), ``base_failed`` and ``kept``.

    A null or empty text has no words: it fails the base rules, and its clean
    text is the text as it was. Blank lines are no lines to judge and stay.
    Repeated rows are judged alike; an empty table gives an empty table.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    body = F.coalesce(F.col("row")[text], F.lit(""))
    df = row.withColumn("words", words(body))
    df = repeated_words(df, "words", "n_repeat_words")
    df = df.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": _count_of(body, SYMBOLS).cast("long"),
            "lines": F.split(body, "\n"),
        }
    ).drop("words")
    full = F.filter("lines", lambda x: x.rlike(WORD))
    df = df.withColumn("full", full).withColumn("stay", F.filter("full", lambda x: ~line_fails(x)))
    df = df.withColumns(
        {
            "n_dup_lines": (F.size("full") - F.size(F.array_distinct("full"))).cast("long"),
            "some_fail": F.size("stay") < F.size("full"),
            "stay_chars": F.when(
                F.size("stay") < F.size("full"), F.length(F.regexp_replace(F.array_join("stay", ""), "[\\x20\\x09-\\x0D]", ""))
            ).otherwise(F.col("word_chars")),
        }
    )
    df = df.withColumns(
        {
            "lost": F.when(F.col("word_chars") > 0, 1 - F.col("stay_chars") / F.col("word_chars")).otherwise(0.0),
            "base_failed": (F.col("n_words") < min_words)
            | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat),
            "clean_text": F.when(
                F.col("some_fail"),
                F.array_join(F.filter("lines", lambda x: ~(x.rlike(WORD) & line_fails(x))), "\n"),
            ).otherwise(F.col("row")[text]),
        }
    )
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= max_lost))
    return df.drop("lines", "full", "stay", "some_fail", "stay_chars")


def stage(docs: DataFrame) -> DataFrame:
    """Kept documents with their failing lines removed, in the columns of docs."""
    # Written before it is filtered: Catalyst would copy the definitions behind
    # ``kept`` into the filter, and evaluate them again for every word.
    rest = [F.col("row")[c].alias(c) for c in docs.columns if c != "text"]
    df = written(judged(docs).select(F.struct(*rest).alias("row"), "clean_text", "kept"), "judged").filter("kept")
    return df.select(*[(F.col("clean_text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
