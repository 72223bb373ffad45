"""Kendall's tau and Kraskov's information of whole fields, whose pairs are many tasks' work.

Kendall counts swapped pairs over ranges. Points are cut into ranges of (a, b)
and into ranges of (b, a). A pair of points of one range is counted inside
that range; of all others, only the ranges matter, and pairs of ranges are
points of the same problem, with counts as weights, but far fewer of them.

Kraskov's estimate cuts the plane into cells of about as many points each,
whatever their density. A point's k-th neighbour within its cell bounds the
true one, so only cells that its square meets are asked; the counts along both
axes come from ranks over ranges of all values, not from neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlark.functions.measures import default_k, psi
from gridlark.session import checkpointed

#: Points of a range, and of a cell at least; of a cell that is large enough, or fewer for that many cells; cells at the most (a table of five numbers each).
RANGE, CELL, FULL, TASKS, MOST_CELLS = 200_000, 1024, 16_384, 64, 500_000


def weighted_inversions(r: np.ndarray, w: np.ndarray) -> int:
    """Sum of the products of weights of all pairs that fall; r are distinct whole numbers."""
    n = len(r)
    size, width, total = 1 << max(n - 1, 0).bit_length(), 1, 0
    # products of large weights are sums of Python's whole numbers
    kind = np.int64 if float(w.sum()) ** 2 < 2**62 else object
    x, u = np.arange(size, dtype=np.int64) + (int(r.max()) + 1 if n else 0), np.zeros(size, np.int64)
    x[:n], u[:n] = r, w
    top = int(x.max()) + 1
    while width < size:
        runs, weights = x.reshape(-1, 2 * width), u.reshape(-1, 2 * width)
        order = np.argsort(runs[:, :width], axis=1)
        left, right = np.take_along_axis(runs[:, :width], order, 1), runs[:, width:]
        upto = np.zeros((len(runs), width + 1), np.int64)
        np.cumsum(np.take_along_axis(weights[:, :width], order, 1), axis=1, out=upto[:, 1:])
        row = np.arange(len(runs), dtype=np.int64)[:, None]
        at = np.searchsorted((left + row * top).ravel(), (right + row * top).ravel()).reshape(right.shape) - row * width
        above = upto[:, -1:] - np.take_along_axis(upto, at, 1)
        total += int((weights[:, width:].astype(kind) * above.astype(kind)).sum())
        width *= 2
    return total


def _swapped_within(g: pd.DataFrame) -> int:
    """Of points (first, a, b, w): pairs in ascending order of first, then (b, a), that fall in (b, a)."""
    a, b = g["a"].to_numpy(), g["b"].to_numpy()
    r = np.empty(len(g), np.int64)
    r[np.lexsort((a, b))] = np.arange(len(g))
    order = np.lexsort((r, g["first"].to_numpy())) if "first" in g else np.lexsort((b, a))
    return weighted_inversions(r[order], g["w"].to_numpy()[order])


def _summed(groups: DataFrame, key: str) -> int:
    one = lambda g: pd.DataFrame({"n": [Decimal(_swapped_within(g))]})
    return int(groups.groupBy(key).applyInPandas(one, "n decimal(38,0)").agg(F.sum("n")).first()[0] or 0)


def swapped(points: DataFrame, size: int | None = None) -> int:
    """The weight of all pairs of points (a, b, w) that rise in a and fall in b; points are distinct."""
    size = size or RANGE
    points = checkpointed(points.select("a", "b", "w"))
    parts = math.ceil(points.count() / size)
    if parts <= 1:
        return _summed(points.withColumn("p", F.lit(0)), "p")
    p = checkpointed(points.repartitionByRange(parts, "a", "b").withColumn("p", F.spark_partition_id()))
    pq = checkpointed(p.repartitionByRange(parts, "b", "a").withColumn("q", F.spark_partition_id()))
    within = _summed(pq, "p")
    # in one range of (b, a), pairs of different ranges of (a, b)
    across = _summed(pq.withColumn("first", F.col("p")), "q")
    cells = pq.groupBy(F.col("p").alias("a"), F.col("q").alias("b")).agg(F.sum("w").alias("w"))
    return within + across + swapped(cells, size)


def kendall(pairs: DataFrame, variant: str = "tau_b") -> float:
    """Kendall's tau of all rows (a, b) without NaN (see kernels.kendall); NaN where a side is constant."""
    points = checkpointed(pairs.groupBy("a", "b").agg(F.count("*").alias("w")))
    # two in a row of one value: n (n - 1), in decimals since it grows with the square of the field
    twice = lambda w: F.sum(w.cast("decimal(19,0)") * (w.cast("decimal(19,0)") - 1))
    total = lambda *by: int(points.groupBy(*by).agg(F.sum("w").alias("w")).agg(twice(F.col("w"))).first()[0] or 0) // 2
    n0, falls = total(), swapped(points)
    if variant == "tau_a":
        return (n0 - 2 * falls) / n0 if n0 else 1.0
    n1, n2 = total("a"), total("b")
    n3 = total("a", "b") if variant == "tau_b" else 0
    if not n0:
        return 1.0
    if n0 in (n1, n2):
        return float("nan")
    return (n0 - n1 - n2 + n3 - 2 * falls) / math.sqrt(float(n0 - n1) * float(n0 - n2))


def digamma(n: Column) -> Column:
    """``psi`` of whole numbers from 1 on: a table up to 32, beyond it the asymptotic series, which is exact to 1e-15 there."""
    table = F.array(*[F.lit(psi(k)) for k in range(1, 33)])
    x = n.cast("double")
    s = 1 / (x * x)
    series = F.log(x) - 1 / (2 * x) - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s / 240)))
    return F.when(n <= 32, F.get(table, n.cast("int") - 1)).otherwise(series)


def _digamma(n: int) -> float:
    if n <= 32:
        return psi(n)
    s = 1 / (n * n)
    return math.log(n) - 1 / (2 * n) - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s / 240)))


def _strips(wide_a: float, wide_b: float, cells: int) -> int:
    """Into how many strips of a, cut along b, makes about ``cells`` cells as wide as they are high."""
    if not wide_a > 0 or not wide_b > 0:
        return cells if wide_a > 0 else 1
    return max(1, round(min(cells, math.sqrt(cells * (wide_a / wide_b)))))


def _cut(points: DataFrame, count: int, size: int) -> DataFrame:
    """points with ``cell``: strips of a, each cut along b, of at most about ``size`` points.

    Cells of one point set that is far wider than high would else be long and thin, and a point's square would meet many.
    """
    cells = max(1, math.ceil(count / size))
    ends = points.agg(*[F.percentile_approx(c, [0.05, 0.95]) for c in "ab"]).first()
    strips = _strips(*[high - low for low, high in ends], cells)
    df = points.repartitionByRange(strips, "a", "b").withColumn("strip", F.spark_partition_id())
    if strips == cells:
        return checkpointed(df.withColumn("cell", F.col("strip").cast("long")).drop("strip"))
    df = checkpointed(df).repartitionByRange(cells, "strip", "b", "a")
    return checkpointed(df.withColumn("cell", F.spark_partition_id() * F.lit(1 << 31) + F.col("strip")).drop("strip"))


class _Strips:
    """Points of a cell in strips of a, each in ascending order of b."""

    def __init__(self, a: np.ndarray, b: np.ndarray, size: int):
        n = len(a)
        self.a, self.b, self.size = a, b, min(size, n)
        wide = [float(np.subtract(*np.percentile(v, [95, 5]))) for v in (a, b)]
        strips = _strips(*wide, max(1, n // size))
        order = np.argsort(a, kind="stable")
        strip = np.arange(n) * strips // n
        starts = np.searchsorted(strip, np.arange(strips))
        self.first, self.last = a[order[starts]], a[order[np.append(starts[1:], n) - 1]]
        self.order = order[np.lexsort((b[order], strip))]
        self.sorted = np.sort(b)
        # ranks of b are whole numbers, so strip and rank are one key
        self.key = strip * (n + 1) + np.searchsorted(self.sorted, b[self.order])

    def bounds(self, k: int) -> np.ndarray:
        """No less than the distance of each point's k-th neighbour: that among some next to it in its strip."""
        n, m = len(self.a), self.size
        out = np.full(n, np.inf)
        if m <= k:
            return out
        a, b = self.a[self.order], self.b[self.order]
        for s in _blocks(n, m):
            rows = np.arange(n)[s]
            at = np.clip(rows - m // 2, 0, n - m)[:, None] + np.arange(m)
            far = np.maximum(np.abs(a[rows, None] - a[at]), np.abs(b[rows, None] - b[at]))
            far[at == rows[:, None]] = np.inf
            out[self.order[rows]] = np.partition(far, k - 1, axis=1)[:, k - 1]
        return out

    def within(self, x: np.ndarray, y: np.ndarray, d: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, ...]]:
        """(i, at, dx, dy): the points at a distance of d at the most of each (x, y), all of an i in one portion."""
        n = len(self.a)
        # one number more than d, so that no rounded difference is lost
        reach = np.nextafter(d, np.inf)
        first = np.searchsorted(self.last, x - reach)
        strips = np.maximum(np.searchsorted(self.first, x + reach, "right") - first, 0)
        low, high = np.searchsorted(self.sorted, y - reach), np.searchsorted(self.sorted, y + reach, "right")
        i = np.repeat(np.arange(len(x)), strips)
        upto = np.concatenate([[0], np.cumsum(strips)])
        strip = (np.arange(upto[-1]) - upto[i] + first[i]) * (n + 1)
        start = np.searchsorted(self.key, strip + low[i])
        found = np.searchsorted(self.key, strip + high[i]) - start
        total = np.concatenate([[0], np.cumsum(found)])
        s = 0
        while s < len(x):
            e = max(s + 1, int(np.searchsorted(total[upto], total[upto[s]] + most, "right")) - 1)
            part = slice(upto[s], upto[e])
            rows = np.repeat(i[part], found[part])
            at = np.arange(len(rows)) - np.repeat(total[:-1][part] - total[upto[s]] - start[part], found[part])
            at = self.order[at]
            dx, dy = np.abs(x[rows] - self.a[at]), np.abs(y[rows] - self.b[at])
            near = (dx <= d[rows]) & (dy <= d[rows])
            yield rows[near], at[near], dx[near], dy[near]
            s = e


def _blocks(n: int, m: int, most: int = 1 << 20) -> Iterator[slice]:
    step = max(1, most // max(1, m))
    yield from (slice(s, min(s + step, n)) for s in range(0, n, step))


def _nearest(i: np.ndarray, dx: np.ndarray, dy: np.ndarray, w: np.ndarray, k: int, estimator: int) -> tuple[np.ndarray, ...]:
    """(i, dx, dy, w) of the neighbours that are the k nearest of each i, w of them each; in ascending order of i."""
    far = np.maximum(dx, dy)
    # among equally far ones, only the second estimator tells which come first
    order = np.lexsort((far, i) if estimator == 1 else (dy, dx, far, i))
    order = order[w[order] > 0]
    i, w = i[order], w[order]
    ahead = np.cumsum(w) - w
    begin = np.concatenate([[True], i[1:] != i[:-1]])[: len(i)]
    keep = ahead - np.maximum.accumulate(np.where(begin, ahead, 0)) < k
    return i[keep], dx[order][keep], dy[order][keep], w[keep]


def _extents(n: int, near: tuple[np.ndarray, ...], k: int, estimator: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n points: the distance of the k-th neighbour, and how far the counted intervals of a and of b reach; infinite with fewer than k."""
    i, dx, dy, w = near
    d, ex, ey = (np.full(n, np.inf) for _ in range(3))
    if len(i):
        at = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        full = np.add.reduceat(w, at) >= k
        for out, v in ((d, np.maximum(dx, dy)), (ex, dx), (ey, dy)):
            out[i[at]] = np.where(full, np.maximum.reduceat(v, at), np.inf)
    return (d, d, d) if estimator == 1 else (d, ex, ey)


def _edge(x: np.ndarray, d: np.ndarray, sign: int, strict: bool) -> np.ndarray:
    """The farthest number v on one side of x for which the rounded difference from x is below d (or d at the most)."""
    whole = lambda v: np.where(v.view(np.int64) < 0, np.int64(-(2**63)) - v.view(np.int64), v.view(np.int64))
    number = lambda i: np.where(i < 0, np.int64(-(2**63)) - i, i).astype(np.int64).view(np.float64)
    inside = x.astype(float) + 0.0

    def ok(i):
        apart = sign * (number(i) - inside)
        return apart < d if strict else apart <= d

    low, high = whole(inside), whole(inside + sign * (2 * d + np.finfo(float).tiny))
    # the edge is mostly a few numbers from x + d
    guess = whole(inside + sign * d + 0.0)
    below, above = guess - sign * 4, guess + sign * 4
    close = ok(below) & ~ok(above)
    low, high = np.where(close, below, low), np.where(close, above, high)
    # low is within (or nothing is), high is not: they close in on each other
    for _ in range(64):
        middle = (low >> 1) + (high >> 1) + (low & high & 1)
        if ((middle == low) | (middle == high)).all():
            break
        within = ok(middle)
        low, high = np.where(within, middle, low), np.where(within, high, middle)
    return number(low)


_INTERVALS = "a_low double, a_high double, b_low double, b_high double"


def _intervals(a: np.ndarray, b: np.ndarray, ex: np.ndarray, ey: np.ndarray, estimator: int) -> dict[str, np.ndarray]:
    """The interval of a and of b whose values are counted, of each point."""
    out = {}
    for c, v, e in (("a", a, ex), ("b", b, ey)):
        # where nothing is nearer than 0, the interval is empty
        none = (e <= 0) if estimator == 1 else np.zeros(len(e), bool)
        low, high = _edge(v, e, -1, estimator == 1), _edge(v, e, 1, estimator == 1)
        out[f"{c}_low"], out[f"{c}_high"] = np.where(none, np.inf, low), np.where(none, -np.inf, high)
    return out


def _squares(boxes, k: int, estimator: int):
    """Of each point of a cell, by its k nearest in the cell: the intervals, and the other cells that may have nearer ones."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        a, b, w, home = g["a"].to_numpy(), g["b"].to_numpy(), g["w"].to_numpy(), g["cell"].iloc[0]
        box, n = boxes.value, len(g)
        strips = _Strips(a, b, 4 * k + 24)
        bound = np.where(w > k, 0.0, strips.bounds(k))
        parts = [_nearest(i, dx, dy, w[at] - (i == at), k, estimator) for i, at, dx, dy in strips.within(a, b, bound)]
        near = tuple(np.concatenate(v) for v in zip(*parts))
        d, ex, ey = _extents(n, near, k, estimator)
        # a cell with few points knows too little: some other cell with k holds them all up to its farthest corner
        rich = {c: v[(box["w"] >= k) & (box["cell"] != home)] for c, v in box.items()}
        for at in np.flatnonzero(np.isinf(d)):
            corner = np.maximum.reduce([np.abs(rich[f"{c}{s}"] - v) for c, v in (("a", a[at]), ("b", b[at])) for s in (0, 1)])
            d[at] = np.nextafter(corner.min(initial=np.inf), np.inf)
        reach = d.max()
        # cells that the largest square of this cell may meet, then each point's own
        some = (box["a0"] <= a.max() + reach) & (box["a1"] >= a.min() - reach) & (box["b0"] <= b.max() + reach) & (box["b1"] >= b.min() - reach)
        some = {c: v[some & (box["cell"] != home)] for c, v in box.items()}
        met = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for s in _blocks(n, len(some["cell"])):
            x, y, r = a[s, None], b[s, None], d[s, None]
            i, j = np.nonzero((some["a0"] - x < r) & (x - some["a1"] < r) & (some["b0"] - y < r) & (y - some["b1"] < r))
            met.append((np.arange(n)[s][i], some["cell"][j]))
        i, cells = (np.concatenate(v) for v in zip(*met))
        out = {"id": g["id"], "home": home, "a": a, "b": b, "w": w, "d": d, **_intervals(a, b, ex, ey, estimator)}
        asking = np.unique(i)
        lists = {"meets": (i, cells), **{c: (near[0], v) for c, v in zip(("dx", "dy", "n"), near[1:])}}
        for c, (of, v) in lists.items():
            column = np.full(n, None, object)
            for at, low, high in zip(asking, np.searchsorted(of, asking), np.searchsorted(of, asking, "right")):
                column[at] = v[low:high]
            out[c] = column
        return pd.DataFrame(out)

    return run


def _answers(k: int, estimator: int):
    """What a cell has that is nearer to its visitors than what they know, up to k of them."""

    def run(visitors: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        a, b, w = (points[c].to_numpy() for c in ("a", "b", "w"))
        x, y, d = (visitors[c].to_numpy() for c in ("a", "b", "d"))
        found = []
        if len(x) and len(a):
            for i, at, dx, dy in _Strips(a, b, 4 * k + 24).within(x, y, d):
                nearer = np.maximum(dx, dy) < d[i]
                found.append(_nearest(i[nearer], dx[nearer], dy[nearer], w[at[nearer]], k, estimator))
        i, dx, dy, n = (np.concatenate(v) for v in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0), np.empty(0), np.empty(0, np.int64))
        return pd.DataFrame({"home": visitors["home"].to_numpy()[i], "id": visitors["id"].to_numpy()[i], "dx": dx, "dy": dy, "n": n})

    return run


def _settled(k: int, estimator: int):
    """The intervals of points that asked other cells, with what those answered."""

    def run(asking: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        asking = asking.sort_values("id")
        a, b, ids = (asking[c].to_numpy() for c in ("a", "b", "id"))
        own = np.repeat(np.arange(len(a)), asking["n"].map(len).to_numpy())
        known = (own, *(np.concatenate([np.asarray(v) for v in asking[c]]) for c in ("dx", "dy", "n")))
        told = (np.searchsorted(ids, answers["id"].to_numpy()), *(answers[c].to_numpy() for c in ("dx", "dy", "n")))
        near = _nearest(*(np.concatenate(v) for v in zip(known, told)), k, estimator)
        _, ex, ey = _extents(len(a), near, k, estimator)
        return pd.DataFrame({"id": ids, "w": asking["w"].to_numpy(), **_intervals(a, b, ex, ey, estimator)})

    return run


def _counted(points: DataFrame, count: int, squares: DataFrame, c: str) -> DataFrame:
    """(id, w, n): the weight n of the values of axis c in each square's interval, by their ranks; without empty intervals."""
    values = points.groupBy(F.col(c).alias("v")).agg(F.sum("w").alias("w"))
    parts = max(1, math.ceil(count / RANGE))
    dealt = checkpointed(values.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    firsts = dealt.groupBy("part").agg(F.min("v").alias("first"), F.sum("w").alias("w"))
    firsts = firsts.withColumn("ahead", F.coalesce(F.sum("w").over(ahead), F.lit(0))).orderBy("part").toPandas()
    bounds, number, before = (firsts[x].to_numpy() for x in ("first", "part", "ahead"))

    @F.pandas_udf("int")
    def part_of(v: pd.Series) -> pd.Series:
        return pd.Series(number[np.maximum(np.searchsorted(bounds, v.to_numpy(), "right") - 1, 0)], dtype="int32")

    def ranked(asked: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(values["v"].to_numpy())
        v, upto = values["v"].to_numpy()[order], np.concatenate([[0], np.cumsum(values["w"].to_numpy()[order])])
        start = before[np.searchsorted(number, asked["part"].iloc[0])] if len(asked) else 0
        n = np.zeros(len(asked), np.int64)
        for end, side, sign in (("high", "right", 1), ("low", "left", -1)):
            x = asked[end].to_numpy(dtype=float)
            n += np.where(np.isnan(x), 0, sign * (start + upto[np.searchsorted(v, x, side)])).astype(np.int64)
        return pd.DataFrame({"id": asked["id"], "w": asked["w"], "n": n})

    asked = squares.select("id", "w", F.col(f"{c}_low").alias("low"), F.col(f"{c}_high").alias("high")).filter("low <= high")
    asked = asked.withColumns({"p": part_of("low"), "q": part_of("high")})
    # both ends of most intervals lie in one part
    end = lambda part, low, high: F.struct(F.col(part).alias("part"), low.alias("low"), high.alias("high"))
    none, low, high = F.lit(float("nan")), F.col("low"), F.col("high")
    asked = checkpointed(asked.select("id", "w", F.inline(F.when(F.expr("p = q"), F.array(end("p", low, high))).otherwise(F.array(end("p", low, none), end("q", none, high))))))
    # a part may be asked for any number of ends: they are dealt out by blocks of ids, as many as it takes
    salts = lambda name: F.broadcast(asked.groupBy("part").agg(F.ceil(F.count("*") / (2 * RANGE)).alias(name)))  # noqa: E731 - one row for each part
    spread = dealt.join(salts("most"), "part").select("part", "v", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most") - 1)).alias("salt"))
    asked = asked.join(salts("salts"), "part").withColumn("salt", F.pmod("id", "salts"))
    found = asked.groupBy("part", "salt").cogroup(spread.groupBy("part", "salt")).applyInPandas(ranked, "id long, w long, n long")
    return found.groupBy("id", "w").agg(F.sum("n").alias("n"))


def mi_ksg(pairs: DataFrame, k: int | None = None, estimator: int = 1, noise: float = 0.0) -> float:
    """Kraskov's estimate of all rows (a, b) without NaN (see kernels.mi_ksg); 1 for a single row.

    Equal points are one, with a weight. Cells hold at least 4 k points, so
    few are asked; points near the sides of a cell send their k neighbours
    through shuffles, so k should be given for large fields (its default is 3 % of n).
    """
    if noise:
        pairs = checkpointed(pairs.select(*[(F.col(c) + noise * F.rand(617 + s)).alias(c) for s, c in enumerate("ab")]))
    points = checkpointed(pairs.groupBy("a", "b").agg(F.count("*").alias("w")).withColumn("id", F.monotonically_increasing_id()))
    count, n = points.agg(F.count("*"), F.sum("w")).first()
    if not count or n == 1:
        return 1.0 if n == 1 else float("nan")
    k = min(k or default_k(n), n - 1)
    cells = _cut(points, count, max(CELL, 4 * k, min(FULL, count // TASKS), count // MOST_CELLS))
    sides = [f(c).alias(f"{c}{i}") for c in "ab" for i, f in enumerate((F.min, F.max))]
    # at most about MOST_CELLS rows, whatever the field
    boxes = cells.groupBy("cell").agg(*sides, F.sum("w").alias("w")).toPandas()
    shared = cells.sparkSession.sparkContext.broadcast({c: boxes[c].to_numpy() for c in boxes})
    lists = "meets array<long>, dx array<double>, dy array<double>, n array<long>"
    told = checkpointed(cells.groupBy("cell").applyInPandas(_squares(shared, k, estimator), f"id long, home long, a double, b double, w long, d double, {_INTERVALS}, {lists}"))
    asking = told.filter("meets IS NOT NULL").drop(*[f"{c}_{e}" for c in "ab" for e in ("low", "high")])
    asks = asking.select(F.explode("meets").alias("cell"), "home", "id", "a", "b", "d")
    answers = asks.groupBy("cell").cogroup(cells.groupBy("cell")).applyInPandas(_answers(k, estimator), "home long, id long, dx double, dy double, n long")
    settled = asking.groupBy("home").cogroup(answers.groupBy("home")).applyInPandas(_settled(k, estimator), f"id long, w long, {_INTERVALS}")
    squares = told.filter("meets IS NULL").select(settled.columns).union(checkpointed(settled))
    less = 0 if estimator == 1 else 1
    total = 0.0
    for c in "ab":
        near = F.greatest(F.col("n") - less, F.lit(1))
        full = _counted(points, count, squares, c).agg(F.sum(F.col("w") * digamma(near)), F.sum("w")).first()
        # empty intervals count as one neighbour
        total += (full[0] or 0.0) + psi(1) * (n - (full[1] or 0))
    more = 1 / k if estimator == 2 else 0.0
    return max(0.0, _digamma(k) - more + _digamma(n) - total / n)
