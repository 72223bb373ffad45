"""Audit of sources: how far each source of a language strays from the others, term by term.

Terms are counted in Arrow batches, summed over (lang, source, term), and kept
for a language if enough of its documents have them. All probabilities and
divergences are integers.

Pairs of sources are computed from postings: only terms that both sources have
meet in a join on the term; what a source's terms add against a source without
them depends on the count alone, and comes from the source's histogram of
counts. The terms that set a source apart are found by upper bounds: its terms
lie in buckets of their count and of the language's, and the largest count
with the smallest probability of the language bounds a bucket's divergences.
Buckets are evaluated best first, in waves over all groups at once, until the
bounds of all unseen ones are strictly below the k-th value found.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, hinted, written

#: Bytes of terms to themselves, A-Z to a-z, all others to a space.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"
#: Terms that a task counts before it hands them on.
_HELD = 500_000


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8: runs of letters and of code points over 127, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split() if text else []


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to the occurrences and documents of each term, in portions."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def portion() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, within) in held.items():
            n = len(times)
            same = [pa.repeat(pa.scalar(v, pa.string()), n) for v in (lang, source)]
            term = pa.array(times.keys(), pa.binary(), size=n).cast(pa.string())
            counts = [pa.array(times.values(), pa.int64(), size=n), pa.array(map(within.__getitem__, times), pa.int64(), size=n)]
            yield pa.RecordBatch.from_arrays([*same, term, *counts], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i) for i in range(3))):
            times, within = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            size -= len(times)
            found = terms(text.as_py())
            times.update(found)
            within.update(set(found))
            size += len(times)
            if size > _HELD:
                yield from portion()
                held, size = {}, 0
    yield from portion()


def probability(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + kept)), exactly; in decimals where longs would overflow. Null if nothing is kept."""
    low = F.call_function("div", F.lit(1_000_000_000).cast("long") * (n + 1), total + kept)
    long = F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + kept).cast("decimal(20,0)"))
    return F.when(kept > 0, 1 + F.when(n < 9_000_000_000, low).otherwise(long))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _octaves(n: Column) -> Column:
    """Bucket of a count: the count itself up to 16, then eighths of an octave."""
    return F.when(n <= 16, n.cast("int")).otherwise(17 + F.floor(8 * F.log2(n / 16)).cast("int"))


_GROUP = ["lang", "source"]


def _best(values: DataFrame, k: int, parts: int = 32) -> DataFrame:
    """The k largest values of each group, ties to the smaller term; parts of a group first, so that no task gets all of it."""
    order = [F.col("value").desc(), F.col("item")]
    part = F.pmod(F.xxhash64("item"), F.lit(parts)).alias("part")
    some = values.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy(*_GROUP, "part").orderBy(*order)))
    some = some.filter(F.col("rank") <= k).drop("part", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(*_GROUP).orderBy(*order))).filter(F.col("rank") <= k)


def distinguishing_terms(posted: DataFrame, facts: DataFrame, k: int = 200, step: int = 8) -> DataFrame:
    """(lang, source, item, value, rank): the k terms of each group that its language has more rarely, by upper bounds.

    ``posted`` holds (lang, source, term, n, n_lang), ``facts`` one row a
    group with total, lang_total and kept. A wave evaluates the best unseen
    buckets of every unfinished group, about k terms at first and ``step``
    times as many in each further one. Groups with fewer than k terms end with
    all of them. Nothing is dropped before its bound is strictly below the
    k-th value found.
    """
    p = probability(F.col("n"), F.col("total"), F.col("kept"))
    q = probability(F.col("n_lang"), F.col("lang_total"), F.col("kept"))
    shelved = posted.withColumns({"high": _octaves(F.col("n")), "wide": _octaves(F.col("n_lang"))})
    buckets = shelved.groupBy(*_GROUP, "high", "wide").agg(
        F.count("*").alias("size"), F.max("n").alias("n"), F.min("n_lang").alias("n_lang")
    )
    buckets = buckets.join(facts, _GROUP).select(*_GROUP, "high", "wide", "size", p.alias("p"), q.alias("q")).filter("p > q")
    order = Window.partitionBy(*_GROUP).orderBy(F.col("bound").desc(), "high", "wide")
    buckets = buckets.withColumn("bound", divergence(F.col("p"), F.col("q"))).drop("p", "q")
    buckets = checkpointed(buckets.withColumns({"place": F.row_number().over(order), "upto": F.sum("size").over(order)}))
    best = posted.sparkSession.createDataFrame([], "lang string, source string, item string, value long, rank int")
    # how far each group has come: its buckets are taken in the order of their bounds
    seen = checkpointed(buckets.groupBy(*_GROUP).agg(F.lit(0).alias("seen")))
    most = k
    while True:
        kth = best.filter(F.col("rank") == k).select(*_GROUP, F.col("value").alias("kth"))
        open_ = buckets.join(seen, _GROUP).join(kth, _GROUP, "left").filter("place > seen AND (kth IS NULL OR bound >= kth)")
        start = F.min(F.col("upto") - F.col("size")).over(Window.partitionBy(*_GROUP))
        wave, n = hinted(open_.withColumn("start", start).filter(F.col("upto") - F.col("size") - F.col("start") < most).select(*_GROUP, "high", "wide", "place"))
        if n == 0:
            return best
        values = shelved.join(wave, [*_GROUP, "high", "wide"]).join(facts, _GROUP)
        values = values.select(*_GROUP, F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
        values = values.select(*_GROUP, "item", divergence(F.col("p"), F.col("q")).alias("value"))
        best = checkpointed(_best(best.drop("rank").unionByName(values), k))
        far = wave.groupBy(*_GROUP).agg(F.max("place").alias("far"))
        seen = checkpointed(seen.join(far, _GROUP, "left").select(*_GROUP, F.coalesce("far", "seen").alias("seen")))
        most *= step


def pairs(posted: DataFrame, facts: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of each source from each other one of its language, over all kept terms.

    With f0 the divergence where neither has the term, the sum is kept x f0,
    plus f - f0 for each source's terms as if the other lacked them, plus a
    correction for each term that both have. The last sum joins postings; the
    others need histograms of counts only.
    """
    f = divergence
    none = probability(F.lit(0).cast("long"), F.col("total"), F.col("kept"))
    sides = facts.select(*_GROUP, "kept", none.alias("none"))
    p = probability(F.col("n"), F.col("total"), F.col("kept"))
    side = lambda x: sides.select("lang", *[F.col(c).alias(f"{x}_{c}") for c in ("source", "none")])
    ways = sides.select("lang", F.col("source").alias("a_source"), F.col("none").alias("a_none"), "kept").join(side("b"), "lang").filter("a_source <> b_source")
    a0, b0 = F.col("a_none"), F.col("b_none")
    # a's terms against b without them, and b's against a
    bars = posted.groupBy(*_GROUP, "n").agg(F.count("*").alias("size")).join(facts, _GROUP)
    bars = checkpointed(bars.select("lang", F.col("source").alias("a_source"), p.alias("a"), none.alias("a_none"), "size"))
    met = bars.join(side("b"), "lang").filter("a_source <> b_source")
    a = F.col("a")
    alone = met.groupBy("lang", "a_source", "b_source").agg(
        F.sum(F.col("size") * (f(a, b0) - f(a0, b0))).alias("there"), F.sum(F.col("size") * (f(b0, a) - f(b0, a0))).alias("back")
    )
    # the terms of both
    rated = posted.join(facts, _GROUP).select("lang", "source", "term", p.alias("p"), none.alias("none"))
    one = lambda x: rated.select("lang", "term", *[F.col(c).alias(f"{x}_{c}") for c in ("source", "p", "none")])
    both = one("a").join(one("b"), ["lang", "term"]).filter("a_source < b_source")
    a, b = F.col("a_p"), F.col("b_p")
    more = lambda a, b, a0, b0: F.sum(f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0))
    both = checkpointed(both.groupBy("lang", "a_source", "b_source").agg(more(a, b, a0, b0).alias("there"), more(b, a, b0, a0).alias("back")))
    turned = lambda df: df.select("lang", F.col("b_source").alias("a_source"), F.col("a_source").alias("b_source"), F.col("back").alias("extra"))
    straight = lambda df: df.select("lang", "a_source", "b_source", F.col("there").alias("extra"))
    alone = checkpointed(alone)
    extra = straight(alone).unionByName(turned(alone)).unionByName(straight(both)).unionByName(turned(both))
    extra = extra.groupBy("lang", "a_source", "b_source").agg(F.sum("extra").alias("extra"))
    whole = ways.join(extra, ["lang", "a_source", "b_source"], "left")
    value = F.when(F.col("kept") > 0, F.col("kept") * f(a0, b0) + F.coalesce("extra", F.lit(0))).otherwise(0)
    return whole.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"), value.cast("long").alias("value"))


def audit(docs: DataFrame, min_docs: int = 3, k: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) for each (lang, source) of docs.

    Part "pair" ranks all other sources of the language by their divergence,
    part "term" the k terms that set the source apart (rank from 1, value
    descending, ties to the smaller item in UTF-8 order). Terms in fewer than
    ``min_docs`` documents of the language don't count.

    Null lang, source and text are empty strings. Groups without terms have
    pairs and no terms; a language without kept terms has pairs of value 0; a
    source that is alone in its language has no pairs. Repeated rows are
    documents of their own, very long texts count whole, other columns are
    left aside, and an empty table gives an empty table.
    """
    bare = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = bare.mapInArrow(_counted, _COUNTS).groupBy(*_GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = written(counts, "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    posted = written(counts.drop("docs").join(kept.drop("docs"), ["lang", "term"]), "divergence-postings")
    langs = posted.groupBy("lang", "term").agg(F.max("n_lang").alias("n_lang")).groupBy("lang")
    langs = langs.agg(F.sum("n_lang").alias("lang_total"), F.count("*").alias("kept"))
    facts = bare.select(*_GROUP).distinct().join(posted.groupBy(*_GROUP).agg(F.sum("n").alias("total")), _GROUP, "left").join(langs, "lang", "left")
    facts, _ = hinted(facts.fillna(0, ["total", "lang_total", "kept"]))
    order = Window.partitionBy(*_GROUP).orderBy(F.col("value").desc(), "item")
    sources = pairs(posted, facts).withColumn("rank", F.row_number().over(order))
    items = distinguishing_terms(posted, facts, k)
    columns = lambda df, part: df.select(*_GROUP, F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(sources, "pair").unionByName(columns(items, "term"))
