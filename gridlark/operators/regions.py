"""Dependence between regions: blocks of points, all or some pairs of them.

A block is named by the struct (bz, by, bx), so that no two share a name.
Vectors are packed once for each block or point, and pairs meet by equi-joins
of groups of blocks: every pair of groups is a key of its own, so work spreads
evenly however few members there are.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlark.functions.kernels import of_vectors
from gridlark.functions.sequences import METHODS, cell
from gridlark.operators import tiles, unit_pairs
from gridlark.session import checkpointed

#: Blocks in a group.
GROUP = 128


def _packed(df: DataFrame, keys: list[str], unit: bool = False) -> DataFrame:
    """One row for each key with its values in order of m as v.

    ``unit``: less their mean and of length 1, so that a correlation is a sum
    of products; null for a constant vector, 1 for a single member.
    """
    if unit:
        # windows over the packing's own keys: one shuffle serves all three
        w = Window.partitionBy(*keys)
        df = df.withColumn("u", F.col("value") - F.avg("value").over(w))
        size, n = F.sqrt(F.sum(F.col("u") * F.col("u")).over(w)), F.count("*").over(w)
        df = df.withColumn("value", F.when(n == 1, F.col("value") * 0 + 1).otherwise(F.try_divide("u", size))).drop("u")
    p = F.sort_array(F.collect_list(F.struct("m", "value")))
    return df.groupBy(*keys).agg(p.alias("p")).select(*keys, F.col("p.value").alias("v"))


def _whole(df: DataFrame) -> DataFrame:
    """Without the vectors that miss a member, and so without their pairs."""
    return df.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))


def block_vectors(blocks: DataFrame, measure: str) -> DataFrame:
    """(id, v) of blocks (bx, by, bz, m, value), as the measure wants them."""
    df = _packed(blocks, ["bz", "by", "bx"], measure == "pearson")
    return _whole(df).select(F.struct("bz", "by", "bx").alias("id"), "v")


def _valued(pairs: DataFrame, measure: str, absolute: bool, **options) -> DataFrame:
    """pairs with vectors a and b, and their measure as value instead."""
    if measure == "pearson":
        # a and b have been made unit vectors before they were paired
        value = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        value = F.abs(value) if absolute else value
    else:
        value = of_vectors(measure, absolute=absolute, **options)
    return pairs.withColumn("value", value).drop("a", "b")


def all_pairs(a: DataFrame, b: DataFrame, groups: int) -> DataFrame:
    """Every row of a (i, ...) beside every row of b (j, ...), by an equi-join on pairs of groups."""
    n = F.lit(groups)
    every = F.sequence(F.lit(0), n - 1)
    left = a.withColumns({"ga": F.pmod(F.xxhash64("i"), n).cast("int"), "gb": F.explode(every)})
    right = b.withColumns({"gb": F.pmod(F.xxhash64("j"), n).cast("int"), "ga": F.explode(every)})
    return left.join(right, ["ga", "gb"]).drop("ga", "gb")


def paired(a: DataFrame, b: DataFrame, same: bool, diagonal: bool, listed: DataFrame | None) -> DataFrame:
    if listed is not None:
        return listed.join(a, "i").join(b, "j")
    groups = max(1, math.ceil(a.count() / GROUP))
    pairs = all_pairs(a, b, groups)
    if not same:
        return pairs
    return pairs.filter(F.col("i") >= F.col("j")) if diagonal else pairs.filter(F.col("i") > F.col("j"))


def distance(i: Column, j: Column) -> Column:
    """Distance of two blocks in blocks."""
    return F.sqrt(sum(((i[c] - j[c]) * (i[c] - j[c]) for c in ("bx", "by", "bz")), F.lit(0.0)))


def narrowed(pairs: DataFrame, cells: tuple | None = None, clicked: tuple | None = None) -> DataFrame:
    """Pairs whose blocks are so far apart, and those with one end at the block (bx, by, bz)."""
    if cells is not None:
        pairs = pairs.filter(distance(F.col("i"), F.col("j")).between(*map(float, cells)))
    if clicked is not None:
        at = lambda c: (F.col(c)["bx"] == clicked[0]) & (F.col(c)["by"] == clicked[1]) & (F.col(c)["bz"] == clicked[2])
        pairs = pairs.filter(at("i") | at("j"))
    return pairs


def within(pairs: DataFrame, low: float | None, high: float | None = None, least: float | None = None) -> DataFrame:
    """Pairs with a value in the range, and of a magnitude of ``least``; NaN and null are in none."""
    pairs = pairs.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    if low is not None:
        pairs = pairs.filter(F.col("value") >= low)
    if least is not None:
        pairs = pairs.filter(F.abs("value") >= least)
    return pairs.filter(F.col("value") <= high) if high is not None else pairs


def mean_pairs(
    blocks: DataFrame, others: DataFrame | None = None, measure: str = "pearson", low: float | None = None, high: float | None = None,
    absolute: bool = False, diagonal: bool = False, cells: tuple | None = None, clicked: tuple | None = None,
    listed: DataFrame | None = None, least: float | None = None, **options,
) -> DataFrame:
    """(i, j, value): the measure between block means (bx, by, bz, m, value).

    Pairs i > j of one region (i >= j with ``diagonal``), all pairs of two
    regions where ``others`` are given, or the pairs ``listed``. Binned
    information spans the values of the pair. A block with a missing member
    has no pairs. Pearson's correlations between ``low`` and ``high``, or of a
    magnitude of ``least``, are found by bounds, without a list of all pairs;
    other measures of all pairs are taken by tiles of two groups of blocks.
    """
    vectors = block_vectors(blocks, measure)
    if measure == "pearson" and listed is None and cells is None and clicked is None:
        second = None if others is None else block_vectors(others, measure)
        return unit_pairs.unit_pairs(vectors, second, diagonal, low, high, least, absolute)
    if listed is None and cells is None and clicked is None:
        second = None if others is None else block_vectors(others, measure)
        return within(tiles.pairs(vectors, second, measure, diagonal, absolute, **options), low, high, least)
    second = vectors if others is None else block_vectors(others, measure)
    a, b = vectors.select(F.col("id").alias("i"), F.col("v").alias("a")), second.select(F.col("id").alias("j"), F.col("v").alias("b"))
    pairs = narrowed(paired(a, b, others is None, diagonal, listed), cells, clicked)
    return within(_valued(pairs, measure, absolute, **options), low, high, least)


def strongest_means(blocks: DataFrame, k: int, others: DataFrame | None = None) -> DataFrame:
    """The k Pearson correlations of largest magnitude between block means, strongest first, without a list of all pairs."""
    return unit_pairs.strongest(block_vectors(blocks, "pearson"), k, None if others is None else block_vectors(others, "pearson"))


def two_fields(first: DataFrame, second: DataFrame, **options) -> DataFrame:
    """(i, j, value, second) in both directions: blocks of the first field with those of the second, and back.

    i belongs to the first field in either; pairs are those of one region, its diagonal included.
    """
    one = _two(first, second, **options).withColumn("second", F.lit(False))
    back = _two(second, first, **options).select(F.col("j").alias("i"), F.col("i").alias("j"), "value")
    return one.union(back.withColumn("second", F.lit(True)))


def _two(a: DataFrame, b: DataFrame, **options) -> DataFrame:
    return mean_pairs(a, b, **options).filter(F.col("i") >= F.col("j"))


def strongest(pairs: DataFrame, k: int) -> DataFrame:
    """The k pairs of largest magnitude, strongest first."""
    return pairs.orderBy(F.desc(F.abs("value")), "i", "j").limit(k)


def merged(**variables: DataFrame) -> DataFrame:
    """Pairs of several variables in one table, with the variable's name, weakest first."""
    out = None
    for name, pairs in variables.items():
        one = pairs.withColumn("variable", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.abs("value"))


def limited(pairs: DataFrame, variable: str | None) -> DataFrame:
    """The merged pairs of one variable, or of all of them for None."""
    return pairs if variable is None else pairs.filter(F.col("variable") == variable)


def matrix(pairs: DataFrame) -> DataFrame:
    """Both halves of the symmetric matrix of pairs i > j."""
    return pairs.select("i", "j", "value").union(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))


def point_vectors(df: DataFrame, measure: str | None = None) -> DataFrame:
    """(x, y, z, v) of a field (x, y, z, m, value), as the measure wants them."""
    return _packed(df, ["x", "y", "z"], measure == "pearson")


def _boxes(points: DataFrame, factor: int, sizes: tuple) -> DataFrame:
    """(id, ox, oy, oz, nx, ny, nz): each block with its first point and its extent."""
    at = {a: F.floor(F.col(a) / factor) for a in "xyz"}
    df = points.select(*[c.alias(f"b{a}") for a, c in at.items()]).distinct()
    first = [(F.col(f"b{a}") * factor).alias(f"o{a}") for a in "xyz"]
    extent = [F.least(F.lit(factor), F.lit(n) - F.col(f"b{a}") * factor).alias(f"n{a}") for a, n in zip("xyz", sizes)]
    return df.select(F.struct("bz", "by", "bx").alias("id"), *first, *extent)


def _named(df: DataFrame, end: str, v: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}{end}") for c in "xyz"], F.col("v").alias(v))


def _made(measure: str) -> str:
    """The measure of vectors that have been packed for it: unit vectors' correlation is their product."""
    return "product" if measure == "pearson" else measure


def _samples(df: DataFrame, factor: int, sizes: tuple, samples: int, method: str, measure: str, side: int) -> DataFrame:
    """(id, s, v): the vector that each sample hits in each block, as the first or the second of a pair.

    A sample's place in a block doesn't depend on the other block.
    """
    s = METHODS[method](F.col("s"), 6)[3 * side : 3 * side + 3]
    asked = _boxes(df, factor, sizes).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)).cast("array<bigint>")))
    at = [(F.col(f"o{c}") + cell(s[k], F.col(f"n{c}"))).alias(c) for k, c in enumerate("xyz")]
    return asked.select("id", F.col("s").cast("int").alias("s"), *at).join(_whole(point_vectors(df, measure)), ["x", "y", "z"]).select("id", "s", "v")


def sampled_pairs(
    df: DataFrame, factor: int, sizes: tuple, samples: int, method: str = "plastic", measure: str = "pearson",
    low: float | None = None, high: float | None = None, absolute: bool = False, cells: tuple | None = None,
    clicked: tuple | None = None, listed: DataFrame | None = None, second: DataFrame | None = None, diagonal: bool = False,
    others: DataFrame | None = None, **options,
) -> DataFrame:
    """(i, j, value): the value of largest magnitude among ``samples`` pairs of points of each pair of blocks.

    Points come from a six-dimensional sequence, three coordinates for each
    block. Samples that hit a missing value are left out. Pairs are i > j,
    with ``diagonal`` i >= j. j's values are those of the field ``second``
    where one is given (then i >= j), or j is a block of another region of
    points, ``others`` (then all pairs).
    """
    there = others if others is not None else df if second is None else second
    if listed is None and cells is None and clicked is None:
        sides = [_samples(d, factor, sizes, samples, method, measure, k) for k, d in enumerate((df, there))]
        found = tiles.sampled(*sides, _made(measure), samples, others is None, diagonal or second is not None, **options)
        return within(found.withColumn("value", F.abs("value")) if absolute else found, low, high)
    boxes = _boxes(df, factor, sizes)
    a = boxes.select(F.col("id").alias("i"), F.struct("ox", "oy", "oz", "nx", "ny", "nz").alias("p"))
    boxes = _boxes(there, factor, sizes)
    b = boxes.select(F.col("id").alias("j"), F.struct("ox", "oy", "oz", "nx", "ny", "nz").alias("q"))
    pairs = narrowed(paired(a, b, others is None, diagonal or second is not None, listed), cells, clicked)
    s = METHODS[method](F.col("s"), 6)
    asked = pairs.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)).cast("array<bigint>")))
    at = [(F.col("p")[f"o{c}"] + cell(s[k], F.col("p")[f"n{c}"])).alias(f"{c}i") for k, c in enumerate("xyz")]
    at += [(F.col("q")[f"o{c}"] + cell(s[k + 3], F.col("q")[f"n{c}"])).alias(f"{c}j") for k, c in enumerate("xyz")]
    asked = asked.select("i", "j", *at).distinct()
    ready, back = _whole(point_vectors(df, measure)), _whole(point_vectors(there, measure))
    met = asked.join(_named(ready, "i", "a"), ["xi", "yi", "zi"]).join(_named(back, "j", "b"), ["xj", "yj", "zj"])
    values = within(_valued(met, measure, False, **options), None)
    best = values.groupBy("i", "j").agg(F.max(F.struct(F.abs("value").alias("size"), "value")).alias("best"))
    best = best.select("i", "j", F.col("best.size" if absolute else "best.value").alias("value"))
    return within(best, low, high)


def _cells(df: DataFrame, factor: int, measure: str) -> DataFrame:
    """(id, p, v): each point's block, place and vector."""
    at = F.struct(*[F.floor(F.col(a) / factor).alias(f"b{a}") for a in "zyx"])
    return _whole(point_vectors(df, measure)).select(at.alias("id"), F.struct("x", "y", "z").alias("p"), "v")


def cell_pairs(df: DataFrame, factor: int, measure: str = "pearson", listed: DataFrame | None = None, **options) -> DataFrame:
    """(i, j, value) for every pair of points of every pair of blocks (or of the pairs listed): the whole truth."""
    ready = _whole(point_vectors(df, measure))
    at = F.struct(*[F.floor(F.col(a) / factor).alias(f"b{a}") for a in "zyx"])
    cells = ready.select(at.alias("id"), "v")
    a, b = cells.select(F.col("id").alias("i"), F.col("v").alias("a")), cells.select(F.col("id").alias("j"), F.col("v").alias("b"))
    if listed is not None:
        pairs = listed.join(a, "i").join(b, "j")
    else:
        # points of a group are dealt by number, so that a large block is no task of its own
        tagged = cells.withColumn("g", F.xxhash64("v"))
        groups = max(1, math.ceil(tagged.count() / GROUP))
        n, every = F.lit(groups), F.sequence(F.lit(0), F.lit(groups) - 1)
        left = tagged.select(F.col("id").alias("i"), F.col("v").alias("a"), F.pmod("g", n).cast("int").alias("ga"), F.explode(every).alias("gb"))
        right = tagged.select(F.col("id").alias("j"), F.col("v").alias("b"), F.pmod("g", n).cast("int").alias("gb"), F.explode(every).alias("ga"))
        pairs = left.join(right, ["ga", "gb"]).drop("ga", "gb").filter(F.col("i") > F.col("j"))
    return within(_valued(pairs, measure, False, **options), None)


def exhaustive_pairs(df: DataFrame, factor: int, measure: str = "pearson", listed: DataFrame | None = None, **options) -> DataFrame:
    """(i, j, value, n): the value of largest magnitude of each pair of blocks among all n pairs of points."""
    if listed is None:
        return tiles.largest(_cells(df, factor, measure), _made(measure), **options)
    values = cell_pairs(df, factor, measure, listed, **options)
    best = values.groupBy("i", "j").agg(F.max(F.struct(F.abs("value").alias("size"), "value")).alias("best"), F.count("*").alias("n"))
    return best.select("i", "j", F.col("best.value").alias("value"), "n")


def pair_statistics(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(i, j, value) of the pairs listed, 0 for those that were not found."""
    return listed.join(found.select("i", "j", "value"), ["i", "j"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


#: The columns of a sampling benchmark.
BENCHMARK = ("Sampling Method", "Samples", "Time", "Quantile", "Linear", "Absolute", "Init Samples")


def sampling_benchmark(df: DataFrame, factor: int, sizes: tuple, samples: list[int], methods: dict[str, Callable], measure: str = "pearson") -> DataFrame:
    """A row for each method and number of samples: seconds taken and mean errors against all points (see sampling_errors).

    A method is a function (df, factor, sizes, samples, measure) to pairs; the
    points that it asks before it learns, if it does, are its ``initial``. The
    rows are few: write them with ``df.write.csv(path, header=True)``.
    """
    every = checkpointed(cell_pairs(df, factor, measure).select("i", "j", "value"))
    rows = []
    for name, method in methods.items():
        for n in samples:
            start = time.time()
            found = checkpointed(method(df, factor, sizes, n, measure=measure).select("i", "j", "value"))
            took = time.time() - start
            told = sampling_errors(every, found).first()
            rows.append((name, n, took, told["quantile"], told["linear"], told["absolute"], getattr(method, "initial", lambda n: 0)(n)))
    kinds = ("string", "int", "double", "double", "double", "double", "int")
    return df.sparkSession.createDataFrame(rows, ", ".join(f"`{c}` {k}" for c, k in zip(BENCHMARK, kinds)))


def sampling_errors(values: DataFrame, found: DataFrame) -> DataFrame:
    """How far sampled maxima fall short of all values, in magnitudes: one row of means over pairs.

    quantile: share of the values at or above the one found; linear: distance
    to the maximum as a part of the range; absolute: that distance itself.
    """
    rows = values.select("i", "j", F.abs("value").alias("v")).join(found.select("i", "j", F.abs("value").alias("f")), ["i", "j"])
    below, n = F.count_if(F.col("v") < F.col("f")), F.count("*")
    return _errors(rows.groupBy("i", "j").agg(F.first("f").alias("f"), F.min("v").alias("low"), F.max("v").alias("high"), n.alias("n"), below.alias("below")))


def _errors(each: DataFrame) -> DataFrame:
    """Means over pairs of regions (f, low, high, n, below)."""
    f, low, high = (F.col(c) for c in ("f", "low", "high"))
    quantile, linear = 1 - F.col("below") / F.col("n"), 1 - F.coalesce(F.try_divide(f - low, high - low), F.lit(1.0))
    return each.agg(*[F.avg(c).alias(name) for name, c in (("quantile", quantile), ("linear", linear), ("absolute", high - f))])


def exhaustive_errors(df: DataFrame, factor: int, found: DataFrame, measure: str = "pearson", **options) -> DataFrame:
    """``sampling_errors`` against all points of df, whose values are compared where they are made and never listed."""
    found = found.select("i", "j", F.abs("value").alias("f"))
    return _errors(tiles.compared(_cells(df, factor, measure), found, _made(measure), **options))
