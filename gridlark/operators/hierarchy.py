"""The tree over blocks of a grid: nodes, bundles of pairs along it, and the next level inside a block.

A node is named by its level (0: the root) and a code of three bits for each
level, x lowest, so its parent's code is ``code >> 3``. Every axis is halved
by itself, the larger half first; all leaves lie at one level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.operators.grid import region

#: Levels that fit into a code of 64 bits.
MOST_LEVELS = 20


def height(counts: tuple[int, int, int]) -> int:
    """Levels below the root of a tree over so many blocks along each axis."""
    levels = max(0, max(counts) - 1).bit_length()
    if levels > MOST_LEVELS:
        raise ValueError(f"{max(counts)} blocks along an axis need more than {MOST_LEVELS} levels")
    return levels


def _halves(at: Column, count: int, levels: int) -> Column:
    """A bit for each level, the root's first: whether the place ``at`` lies in the second half."""
    long = lambda v: F.lit(v).cast("long")

    def halved(s: Column, _: Column) -> Column:
        first = F.shiftright(s["n"] + 1, 1)
        second = at.cast("long") - s["low"] >= first
        return F.struct(
            (s["low"] + F.when(second, first).otherwise(long(0))).alias("low"),
            F.when(second, s["n"] - first).otherwise(first).alias("n"),
            (s["bits"] * 2 + second.cast("long")).alias("bits"),
        )

    start = F.struct(long(0).alias("low"), long(count).alias("n"), long(0).alias("bits"))
    return F.aggregate(F.array_repeat(F.lit(0), levels), start, halved)["bits"]


def coded(blocks: DataFrame, counts: tuple[int, int, int]) -> DataFrame:
    """blocks (bx, by, bz, ...) with the ``code`` of their leaf in the tree."""
    levels = height(counts)
    df = blocks.withColumns({f"_{a}": _halves(F.col(f"b{a}"), n, levels) for a, n in zip("xyz", counts)})

    bit = lambda a, k: F.shiftright(f"_{a}", k).bitwiseAND(F.lit(1).cast("long"))
    # three bits a level; none at all where the root is the only node
    code = sum((F.shiftleft(bit(a, k), 3 * k + at) for k in range(levels) for at, a in enumerate("xyz")), F.lit(0).cast("long"))
    df = df.withColumn("code", code)
    return df.drop("_x", "_y", "_z")


def nodes(code: Column, levels: int) -> Column:
    """The nodes (level, code) from the root to a leaf."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(code, 3 * (levels - k)).alias("code")) for k in range(levels + 1)])


def bundled(pairs: DataFrame, counts: tuple[int, int, int]) -> DataFrame:
    """pairs (i, j, ...) of blocks with ``path``, the nodes between their leaves.

    A path climbs from i to below the lowest common ancestor and descends to
    j. The ancestor itself is left out unless the path had two nodes only.
    """
    levels = height(counts)
    for end in ("i", "j"):
        at = pairs.withColumns({f"b{a}": F.col(end)[f"b{a}"] for a in "xyz"})
        pairs = coded(at, counts).withColumn(f"_{end}", nodes(F.col("code"), levels)).drop("bx", "by", "bz", "code")
    same = F.size(F.filter(F.zip_with("_i", "_j", lambda a, b: a == b), lambda x: x))
    df = pairs.withColumn("_same", same)
    below = lambda end: F.slice(F.col(end), F.col("_same") + 1, F.lit(levels + 1))
    top = F.when(F.col("_same") == levels, F.slice("_i", F.col("_same"), F.lit(1))).otherwise(F.slice("_i", 1, 0))
    return df.withColumn("path", F.concat(F.reverse(below("_i")), top, below("_j"))).drop("_i", "_j", "_same")


def straightened(points: Column, beta: float = 0.75) -> Column:
    """Control points (x, y), all but the ends drawn towards the line between the ends by 1 - beta."""
    first, last, n = points[0], F.element_at(points, -1), F.size(points)

    def moved(p: Column, k: Column) -> Column:
        on = lambda c: first[c] + F.try_divide(k, n - 1) * (last[c] - first[c])
        inner = (k > 0) & (k < n - 1)
        return F.struct(*[F.when(inner, beta * p[c] + (1 - beta) * on(c)).otherwise(p[c]).alias(c) for c in "xy"])

    return F.transform(points, moved)


def _with(value: Column, told: Callable[[Column], Column]) -> Column:
    """told(value), with the value calculated once however often it is used."""
    return F.get(F.transform(F.array(value), told), F.lit(0))


def _drawn(points: Column, n: Column, order: int, t: Column) -> Column:
    """The point at t in [0, 1] of the spline of that order, whose knots are even inside and repeated at the ends."""
    spans = n - order + 1

    def step(now: Column, at: Column, first: Column, r: int) -> Column:
        if r == order:
            return F.get(now, F.lit(0))
        # neighbours are drawn together, until one is left
        knot = lambda j: F.greatest(F.lit(0), F.least(first + j - (order - 1), spans)).cast("double")
        part = [(at - knot(j)) / (knot(j + order - r) - knot(j)) for j in range(r, order)]
        drawn = [F.struct(*[((1 - p) * F.get(now, F.lit(j))[c] + p * F.get(now, F.lit(j + 1))[c]).alias(c) for c in "xy"]) for j, p in enumerate(part)]
        return _with(F.array(*drawn), lambda v: step(v, at, first, r + 1))

    def placed(at: Column) -> Column:
        return _with(F.least(F.floor(at), spans - 1).cast("int"), lambda first: _with(F.slice(points, first + 1, order), lambda v: step(v, at, first, 1)))

    return _with(t * spans, placed)


def curved(points: Column, steps: int = 50) -> Column:
    """``steps`` points (x, y) along the cubic B-spline of control points, from the first one to the last one.

    Three control points make a quadratic curve, two a line, and one a point;
    without any, or for null, there is none.
    """
    t = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: i / float(max(steps - 1, 1)))
    line = lambda p, order: F.transform(t, lambda v: _drawn(p, F.size(p), order, v))
    of = lambda p: F.when(F.size(p) > 3, line(p, 4)).when(F.size(p) == 3, line(p, 3)).when(F.size(p) == 2, line(p, 2)).when(F.size(p) == 1, line(p, 1))
    return _with(points, of)


def block_counts(sizes: tuple[int, int, int], factor: int) -> tuple[tuple[int, int, int], int]:
    """Blocks along each axis, and the factor: 1 where the whole region would be one block."""
    counts = tuple(-(-n // factor) for n in sizes)
    return (tuple(sizes), 1) if counts == (1, 1, 1) else (counts, factor)


def drilled(df: DataFrame, block: tuple[int, int, int], factor: int, sizes: tuple[int, int, int]) -> tuple[DataFrame, tuple[int, int, int]]:
    """The points of a block (bx, by, bz) as a grid of its own, and that grid's sizes.

    Only that box is read further, so the next level costs what the block
    holds. point_id stays that of the whole grid.
    """
    low = [b * factor for b in block]
    inner = tuple(min(factor, n - start) for n, start in zip(sizes, low))
    if min(inner) < 1 or min(block) < 0:
        raise ValueError(f"block {block} lies outside the grid")
    box = region(df, tuple(low), tuple(start + n - 1 for start, n in zip(low, inner)))
    return box.withColumns({a: (F.col(a) - start).cast("int") for a, start in zip("xyz", low)}), inner
