"""Density clusters without pairs of points: by cells whose points are all within eps of each other.

A cell of at least ``least`` points is full: all its points are cores. Only
the points of other cells, fewer than ``least`` in each, ask the cells around
them how many points they have within eps. All cores of a cell are of one
cluster, so clusters are components of cells. Two cells are linked by a pair
of cores within eps; whether there is one is told by the boxes around their
cores, and where these leave it open, by those of their quarters, until few
enough points are left to be compared.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.operators.features import least_labels
from gridlark.session import checkpointed

#: Pairs of cores that are compared at once when boxes leave a link open.
COMPARED = 1 << 20
_AROUND = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) != (0, 0)]
_SIDES = ("x0", "x1", "y0", "y1", "n")


def _key(side: float, level: int = 0) -> Column:
    """The cell of a point, or its part after so many halvings: halved sides are exact, so parts nest."""
    return F.struct(*[F.floor(F.col(c) / (side / 2**level)).cast("long").alias(a) for c, a in (("px", "i"), ("py", "j"))])


def _moved(key: Column, i: Column, j: Column) -> Column:
    return F.struct((key["i"] + i).alias("i"), (key["j"] + j).alias("j"))


def _boxes(cores: DataFrame, side: float, level: int) -> DataFrame:
    ends = [f(c).alias(f"{c[1]}{k}") for c in ("px", "py") for k, f in enumerate((F.min, F.max))]
    return cores.groupBy(_key(side, level).alias("part")).agg(*ends, F.count("*").alias("n")).select("part", F.struct(*_SIDES).alias("box"))


def _length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def _nearest(a: Column, b: Column) -> Column:
    gap = lambda c: F.greatest(a[f"{c}0"] - b[f"{c}1"], b[f"{c}0"] - a[f"{c}1"], F.lit(0.0))
    return _length(gap("x"), gap("y"))


def _farthest(a: Column, b: Column) -> Column:
    span = lambda c: F.greatest(a[f"{c}1"] - b[f"{c}0"], b[f"{c}1"] - a[f"{c}0"])
    return _length(span("x"), span("y"))


def _any_within(eps: float):
    @F.pandas_udf("boolean")
    def told(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
        def one(ax, ay, bx, by) -> bool:
            step = max(1, COMPARED // max(1, len(bx)))
            for s in range(0, len(ax), step):
                dx, dy = ax[s : s + step, None] - bx, ay[s : s + step, None] - by
                if (np.sqrt(dx * dx + dy * dy) <= eps).any():
                    return True
            return False

        return pd.Series([one(*map(np.asarray, r)) for r in zip(ax, ay, bx, by)], dtype=bool)

    return told


def _compared(pairs: DataFrame, cores: DataFrame, side: float, level: int, eps: float) -> DataFrame:
    """The (a, b) among pairs (a, b, pa, pb) of few cores that have one pair within eps."""
    keyed = cores.withColumn("part", _key(side, level))
    gathered = lambda c, name: (
        keyed.join(pairs.select(F.col(name).alias("part")).distinct(), "part", "left_semi")
        .groupBy(F.col("part").alias(name)).agg(F.collect_list("px").alias(f"{c}x"), F.collect_list("py").alias(f"{c}y"))
    )
    met = pairs.join(gathered("a", "pa"), "pa").join(gathered("b", "pb"), "pb")
    return met.filter(_any_within(eps)("ax", "ay", "bx", "by")).select("a", "b").distinct()


def _linked(cores: DataFrame, side: float, eps: float, most_levels: int = 60) -> DataFrame:
    """(a, b): the pairs of cells with cores within eps of each other."""
    boxes = checkpointed(_boxes(cores, side, 0))
    ahead = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _AROUND if (i, j) > (0, 0)])
    asked = boxes.select(F.col("part").alias("a"), F.col("box").alias("ba"), F.explode(ahead).alias("o"))
    asked = asked.select("a", "ba", _moved(F.col("a"), F.col("o.i"), F.col("o.j")).alias("b"))
    open_ = asked.join(boxes.select(F.col("part").alias("b"), F.col("box").alias("bb")), "b")
    open_ = open_.select("a", "b", F.col("a").alias("pa"), F.col("b").alias("pb"), "ba", "bb")
    found = []
    for level in range(most_levels):
        a, b = F.col("ba"), F.col("bb")
        open_ = open_.filter(_nearest(a, b) <= eps).withColumn("sure", _farthest(a, b) <= eps)
        open_ = checkpointed(open_.withColumn("few", (a["n"] * b["n"] <= COMPARED) | F.lit(level == most_levels - 1)))
        sure = open_.filter("sure").select("a", "b").distinct()
        left = open_.join(sure, ["a", "b"], "left_anti")
        near = checkpointed(_compared(left.filter("few").select("a", "b", "pa", "pb"), cores, side, level, eps))
        found += [sure, near]
        left = checkpointed(left.filter("NOT few").join(near, ["a", "b"], "left_anti"))
        if left.isEmpty():
            break
        halves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
        half = lambda c, o: F.struct((F.col(c)["i"] * 2 + F.col(o)["i"]).alias("i"), (F.col(c)["j"] * 2 + F.col(o)["j"]).alias("j"))
        boxes = checkpointed(_boxes(cores, side, level + 1))
        left = left.select("a", "b", "pa", "pb", F.explode(halves).alias("oa")).select("*", F.explode(halves).alias("ob"))
        left = left.select("a", "b", half("pa", "oa").alias("pa"), half("pb", "ob").alias("pb"))
        left = left.join(boxes.select(F.col("part").alias("pa"), F.col("box").alias("ba")), "pa")
        open_ = left.join(boxes.select(F.col("part").alias("pb"), F.col("box").alias("bb")), "pb")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _met(askers: DataFrame, points: DataFrame, eps: float) -> DataFrame:
    """(asker, cell) for each point of the cells around an asker (id, px, py, cell) that is within eps.

    A cell has few askers around it, so they are one array, which its points
    meet however many they are.
    """
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _AROUND])
    asks = askers.select(F.struct("id", "px", "py").alias("ask"), "cell", F.explode(around).alias("o"))
    asks = asks.groupBy(_moved(F.col("cell"), F.col("o.i"), F.col("o.j")).alias("cell")).agg(F.collect_list("ask").alias("asks"))
    met = points.join(asks, "cell")
    near = F.filter("asks", lambda q: _length(F.col("px") - q["px"], F.col("py") - q["py"]) <= eps)
    return met.select(F.explode(F.transform(near, lambda q: q["id"])).alias("asker"), "cell")


def dbscan(points: DataFrame, eps: float, least: int = 8) -> DataFrame:
    """(id, cluster) of points (id, px, py): density clusters, named by their smallest core point; noise is left out.

    A core has ``least`` points within eps, itself included. A point that is
    no core belongs to the cluster of the smallest name among its core
    neighbours. Points with NaN have no neighbours.
    """
    points = points.select("id", *[F.col(c).cast("double").alias(c) for c in ("px", "py")]).filter("NOT isnan(px) AND NOT isnan(py)")
    # a little less than eps / sqrt(2): rounding must not put two points of a cell beyond eps
    side = eps / math.sqrt(2) * (1 - 1e-9)
    points = checkpointed(points.withColumn("cell", _key(side)))
    counts = points.groupBy("cell").agg(F.count("*").alias("n"))
    rest = checkpointed(points.join(counts.filter(F.col("n") < least), "cell"))
    full = points.join(counts.filter(F.col("n") >= least).select("cell"), "cell", "left_semi").select("id", "px", "py", "cell")
    seen = _met(rest, points, eps).groupBy(F.col("asker").alias("id")).agg(F.count("*").alias("more"))
    rest = checkpointed(rest.join(seen, "id", "left").withColumn("core", F.col("n") + F.coalesce("more", F.lit(0)) >= least))
    cores = checkpointed(full.unionByName(rest.filter("core").select("id", "px", "py", "cell")))
    named = checkpointed(cores.groupBy("cell").agg(F.min("id").alias("name")))
    links = _linked(cores, side, eps)
    edges = links.join(named.select(F.col("cell").alias("a"), F.col("name").alias("x")), "a").join(named.select(F.col("cell").alias("b"), F.col("name").alias("y")), "b")
    edges = checkpointed(edges.select(F.inline(F.array(F.struct(F.col("x").alias("id"), F.col("y").alias("other")), F.struct(F.col("y").alias("id"), F.col("x").alias("other"))))))
    labels = least_labels(edges, named.select(F.col("name").alias("id")))
    cells = checkpointed(named.join(labels.withColumnRenamed("id", "name"), "name").select("cell", "label"))
    inside = cores.join(cells, "cell").select("id", F.col("label").alias("cluster"))
    border = rest.filter("NOT core")
    # its own cell's cores are all within eps
    near = border.select(F.col("id").alias("asker"), "cell").unionByName(_met(border, cores, eps).distinct())
    border = near.join(cells, "cell").groupBy(F.col("asker").alias("id")).agg(F.min("label").alias("cluster"))
    return inside.unionByName(border)
