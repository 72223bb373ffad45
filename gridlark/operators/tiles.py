"""Pairs by tiles: rows are dealt to groups, and each two groups meet in one task, as matrices.

A tile holds the rows of two groups, whose size is bounded, so a task's memory
doesn't grow with the table; a row is copied once for each group that it meets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions import kernels
from gridlark.session import checkpointed

ID = "struct<bz:bigint,by:bigint,bx:bigint>"
PAIR = f"i {ID}, j {ID}"
#: Groups that small tables are cut into, so that there are tiles for many cores, and tasks at the most.
LEAST, TASKS = 12, 2000
_PLACES = ("bz", "by", "bx")


def dealt(rows: DataFrame, most: int, salt: Column | None = None) -> tuple[DataFrame, int]:
    """rows (id, ...) with g, the number of a group of about ``most`` rows, and the count of groups.

    Rows of one id share a group, unless they are told apart by ``salt`` and more than ``most``.
    """
    rows = checkpointed(rows.withColumn("id", F.col("id").cast(ID)))
    n = rows.count()
    groups = max(1, math.ceil(n / most), min(LEAST, n // 32))
    name = [F.col("id")]
    if salt is not None:
        parts = rows.groupBy("id").agg(F.ceil(F.count("*") / most).alias("parts"))
        rows = rows.join(parts, "id")
        name.append(F.pmod(salt, F.col("parts")))
    return rows.withColumn("g", F.pmod(F.xxhash64(*name), F.lit(groups)).cast("int")).drop("parts"), groups


def met(a: tuple[DataFrame, int], b: tuple[DataFrame, int] | None, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, more: DataFrame | None = None) -> DataFrame:
    """``run`` of each two groups' rows: of a and of b, or each two of a once where b is None.

    ``more`` are further rows of the first side, which name their tile (ga, gb).
    """
    (left, n), (right, m) = a, b or a
    at = lambda first, last: F.explode(F.sequence(first, last))
    zero, end = F.lit(0), F.lit(n - 1)
    left = left.withColumnRenamed("g", "ga").withColumn("gb", at(zero, F.col("ga") if b is None else F.lit(m - 1)))
    right = right.withColumnRenamed("g", "gb").withColumn("ga", at(F.col("gb") if b is None else zero, end))
    if more is not None:
        left = left.unionByName(more, allowMissingColumns=True)
    parts = min(TASKS, n * (n + 1) // 2 if b is None else n * m)
    # columns of their own, since both sides may be one table
    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]).repartition(parts, "ga", "gb") for df in (left, right))
    return left.groupBy("ga", "gb").cogroup(right.groupBy("ga", "gb")).applyInArrow(run, schema)


def places(table: pa.Table, column: str = "id") -> np.ndarray:
    """(rows, 3): the blocks' numbers (bz, by, bx)."""
    c = table[column].combine_chunks()
    return np.column_stack([pc.struct_field(c, p).to_numpy(zero_copy_only=False).astype(np.int64) for p in _PLACES]).reshape(-1, 3)


def after(i: np.ndarray, j: np.ndarray, equal: bool = False) -> np.ndarray:
    """Which blocks of i come after those of j, or are the same with ``equal``."""
    out = i[..., 2] >= j[..., 2] if equal else i[..., 2] > j[..., 2]
    for c in (1, 0):
        out = (i[..., c] > j[..., c]) | ((i[..., c] == j[..., c]) & out)
    return out


def named(p: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(p[:, k])) for k in range(3)], list(_PLACES))


def rows_of(i: np.ndarray, j: np.ndarray, **columns: np.ndarray) -> pa.Table:
    return pa.table({"i": named(i), "j": named(j), **{c: pa.array(v) for c, v in columns.items()}})


def by_length(table: pa.Table, column: str = "v") -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Numbers of rows and their vectors as a matrix, for each length of vectors."""
    c = table[column].combine_chunks()
    sizes = pc.list_value_length(c).to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        flat = (c if len(at) == len(sizes) else c.take(pa.array(at))).flatten()
        out[int(d)] = at, flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(at), int(d))
    return out


def alike(x: pa.Table, y: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows and vectors of both sides, for each length that both have."""
    if x.num_rows and y.num_rows:
        one, two = by_length(x), by_length(y)
        yield from ((*one[d], *two[d]) for d in one if d in two and d)


def _one(x: pa.Table) -> bool:
    """Whether the tile is a group with itself."""
    return x["ga"][0].as_py() == x["gb"][0].as_py()


def _valued(measure: str, same: bool, turned: bool, diagonal: bool, absolute: bool, options: dict):
    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        i, j, v = [np.empty((0, 3), np.int64)], [np.empty((0, 3), np.int64)], [np.empty(0)]
        for at, a, bt, b in alike(x, y):
            value = kernels.table(measure, a, b, **options)
            r, c = np.nonzero(~np.isnan(value))
            p, q, w = places(x)[at][r], places(y)[bt][c], value[r, c]
            if same:
                ahead = after(p, q, diagonal)
                if turned and not _one(x):  # two groups meet once: a pair is met in either order
                    p, q = np.where(ahead[:, None], p, q), np.where(ahead[:, None], q, p)
                else:
                    p, q, w = p[ahead], q[ahead], w[ahead]
            i.append(p), j.append(q), v.append(np.abs(w) if absolute else w)
        return rows_of(np.concatenate(i), np.concatenate(j), value=np.concatenate(v))

    return run


#: Vectors of a group of blocks: its tile is so many times so many rows.
BLOCKS = 512


def pairs(first: DataFrame, second: DataFrame | None, measure: str, diagonal: bool = False, absolute: bool = False, **options) -> DataFrame:
    """(i, j, value) of vectors (id, v) without NaN: pairs i > j of one table (i >= j with ``diagonal``), or all pairs of two; no value is NaN."""
    a, same = dealt(first, BLOCKS), second is None
    # noise is another one on either side, so that a pair can't be turned round
    turned = same and not options.get("noise")
    b = None if turned else a if same else dealt(second, BLOCKS)
    return met(a, b, _valued(measure, same, turned, diagonal, absolute, options), f"{PAIR}, value double")


def _sampled(measure: str, samples: int, same: bool, diagonal: bool, options: dict):
    def cube(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Blocks and their vectors (block, sample, member) for each length, NaN where a sample has none."""
        ids, s, out = places(table), table["s"].to_numpy(), {}
        for d, (at, v) in by_length(table).items():
            blocks, k = np.unique(ids[at], axis=0, return_inverse=True)
            full = np.full((len(blocks), samples, d), np.nan)
            full[k.ravel(), s[at]] = v
            out[d] = blocks, full
        return out

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        i, j, v = [np.empty((0, 3), np.int64)], [np.empty((0, 3), np.int64)], [np.empty(0)]
        one, two = (cube(t) if x.num_rows and y.num_rows else {} for t in (x, y))
        for d in one:
            if d not in two:
                continue
            (p, a), (q, b) = one[d], two[d]
            best, size = np.full((len(p), len(q)), np.nan), np.full((len(p), len(q)), -1.0)
            for s in range(samples):
                r, c = np.flatnonzero(~np.isnan(a[:, s, 0])), np.flatnonzero(~np.isnan(b[:, s, 0]))
                value = np.full(best.shape, np.nan)
                value[np.ix_(r, c)] = kernels.table(measure, a[r, s], b[c, s], **options)
                far = np.abs(value)
                more = (far > size) | ((far == size) & (value > best))
                best, size = np.where(more, value, best), np.where(more, far, size)
            r, c = np.nonzero(size >= 0)
            p, q, w = p[r], q[c], best[r, c]
            ok = after(p, q, diagonal) if same else np.ones(len(p), bool)
            i.append(p[ok]), j.append(q[ok]), v.append(w[ok])
        return rows_of(np.concatenate(i), np.concatenate(j), value=np.concatenate(v))

    return run


def sampled(first: DataFrame, second: DataFrame, measure: str, samples: int, same: bool, diagonal: bool, **options) -> DataFrame:
    """(i, j, value): the value of largest magnitude of samples of one number s, of rows (id, s, v).

    Lengths of vectors that differ have values of their own.
    """
    a, b = dealt(first, 4096), dealt(second, 4096)
    return met(a, b, _sampled(measure, samples, same, diagonal, options), f"{PAIR}, value double")


#: Points of a group where all points of blocks meet; values at once.
POINTS, VALUES = 16_384, 1 << 19


def _segments(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of rows by their blocks, the blocks, and where each one's rows begin."""
    blocks, k = np.unique(ids, axis=0, return_inverse=True)
    order = np.argsort(k.ravel(), kind="stable")
    return order, blocks, np.searchsorted(k.ravel()[order], np.arange(len(blocks)))


def _told(measure: str, told: Callable, asks: Callable | None, options: dict):
    """Of each pair of blocks in a tile: what ``told`` makes of all values of their points."""

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        found = asks(x) if asks else None
        x = x.filter(pc.is_valid(x["v"]))
        out = []
        for at, a, bt, b in alike(x, y):
            (o, p, s), (u, q, t) = _segments(places(x)[at]), _segments(places(y)[bt])
            a, b, ends, lone = a[o], b[u], [*s[1:], len(at)], _one(x)
            sizes = np.diff([*t, len(bt)])
            for k, (start, end) in enumerate(zip(s, ends)):
                ahead = after(p[k], q)
                ok = ahead if lone else ahead | after(q, p[k])
                i, j = np.where(ahead[:, None], p[k], q)[ok], np.where(ahead[:, None], q, p[k])[ok]
                if not len(i):
                    continue
                limit = None if found is None else np.array([found.get((*m, *n), np.nan) for m, n in zip(i.tolist(), j.tolist())])
                # only the blocks that are asked for, whose points lie side by side
                take = np.repeat(ok, sizes)
                some, begins = (b, t) if ok.all() else (b[take], np.concatenate([[0], np.cumsum(sizes[ok])[:-1]]))
                step = max(1, VALUES // len(some))
                for r in range(start, end, step):
                    value = kernels.table(measure, a[r : min(r + step, end)], some, **options)
                    out.append(told(i, j, value, begins, None if limit is None else (limit, sizes[ok])))
        return pa.concat_tables(out) if out else told(np.empty((0, 3), np.int64), np.empty((0, 3), np.int64), None, None, None)

    return run


def _ends(value: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest and largest value and their count in each run of columns, NaN left out."""
    bad = np.isnan(value)
    if not bad.any():
        n = np.diff([*begins, value.shape[1]]) * len(value)
        return np.minimum.reduceat(value.min(0), begins), np.maximum.reduceat(value.max(0), begins), n
    low, high = np.where(bad, np.inf, value).min(0), np.where(bad, -np.inf, value).max(0)
    return np.minimum.reduceat(low, begins), np.maximum.reduceat(high, begins), np.add.reduceat((~bad).sum(0), begins)


def _largest(i, j, value, begins, limit) -> pa.Table:
    low, high, n = _ends(value, begins) if len(i) else (np.empty(0), np.empty(0), np.empty(0, int))
    some = n > 0
    return rows_of(i[some], j[some], value=np.where(high >= -low, high, low)[some], n=n[some].astype(np.int64))


def largest(points: DataFrame, measure: str, **options) -> DataFrame:
    """(i, j, value, n): the value of largest magnitude among all n pairs of points (id, p, v) of each pair of blocks i > j."""
    a = dealt(points, POINTS, F.xxhash64("p"))
    parts = met(a, None, _told(measure, _largest, None, options), f"{PAIR}, value double, n long")
    best = parts.groupBy("i", "j").agg(F.max(F.struct(F.abs("value").alias("size"), "value")).alias("best"), F.sum("n").alias("n"))
    return best.select("i", "j", F.col("best.value").alias("value"), "n")


def _below(i, j, value, begins, limit) -> pa.Table:
    if not len(i):
        low, high, n, below = np.empty(0), np.empty(0), np.empty(0, int), np.empty(0, int)
    else:
        (most, sizes), value = limit, np.abs(value)
        low, high, n = _ends(value, begins)
        # products of one pair of points differ by rounding in the two plans that meet here
        below = np.add.reduceat((value < np.repeat(most * (1 - 1e-12), sizes)).sum(0), begins)
        some = (n > 0) & ~np.isnan(most)
        i, j, low, high, n, below = (c[some] for c in (i, j, low, high, n, below))
    return rows_of(i, j, low=low, high=high, n=n.astype(np.int64), below=below.astype(np.int64))


def _limits(x: pa.Table) -> dict[tuple, float]:
    """The magnitudes that the tile's pairs of blocks are compared with."""
    x = x.filter(pc.is_null(x["v"]))
    return dict(zip(map(tuple, np.hstack([places(x), places(x, "j")]).tolist()), x["f"].to_pylist()))


def compared(points: DataFrame, found: DataFrame, measure: str, **options) -> DataFrame:
    """(i, j, f, low, high, n, below) of all pairs of points (id, p, v): smallest and largest magnitude, count, and how many are below f, of the pairs found (i, j, f)."""
    rows, n = dealt(points, POINTS, F.xxhash64("p"))
    homes = rows.select("id", "g").distinct()
    found = checkpointed(found.select(F.col("i").cast(ID).alias("i"), F.col("j").cast(ID).alias("j"), "f"))
    of = lambda c: homes.select(F.col("id").alias(c), F.col("g").alias(f"g{c}"))
    asked = found.join(of("i"), "i").join(of("j"), "j")
    asked = asked.select(F.greatest("gi", "gj").alias("ga"), F.least("gi", "gj").alias("gb"), F.col("i").alias("id"), "j", "f").distinct()
    parts = met((rows, n), None, _told(measure, _below, _limits, options), f"{PAIR}, low double, high double, n long, below long", asked)
    parts = parts.groupBy("i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.sum("below").alias("below"))
    return parts.join(found, ["i", "j"])
