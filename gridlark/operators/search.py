"""Bayesian search for the strongest pair of points of two regions.

For each pair of regions, a Gaussian process over six coordinates, three in
each, learns from the points asked so far where a large magnitude is likely;
the next pair of points is the candidate with the largest upper confidence
bound. The process grows by a row of its Cholesky factor for each answer.
Regions meet by tiles of two groups of them, and the searches of a tile's
pairs run side by side, a step of all of them at once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.functions import kernels
from gridlark.functions.sequences import plastic_steps
from gridlark.operators import regions, tiles

#: Candidates of a step, kernel length, noise, and weight of the deviation in the bound.
CANDIDATES, LENGTH, NOISE, KAPPA = 512, 0.35, 1e-4, 1.5
_ID = tiles.ID


def initial(samples: int) -> int:
    """Points asked before the process says anything."""
    return min(max(math.ceil(samples / 2), 1), 20)


def matern(a: np.ndarray, b: np.ndarray, length: float = LENGTH) -> np.ndarray:
    """Matern 5/2 covariances of the rows of a and b."""
    r = np.sqrt(5 * np.maximum(((a[:, None] - b[None]) ** 2).sum(2), 0)) / length
    return (1 + r + r * r / 3) * np.exp(-r)


def searched(value, d: int, samples: int, seed: int = 17) -> tuple[np.ndarray, float]:
    """The place in the unit cube, and the value there, of the largest magnitude that ``samples`` calls of ``value`` find; NaN where none is a number."""
    steps = np.array(plastic_steps(d))
    first = (0.5 + np.outer(np.arange(1, initial(samples) + 1), steps)) % 1.0
    rng = np.random.default_rng(seed)
    places, found = np.empty((samples, d)), np.empty(samples)
    # the inverse of the Cholesky factor grows by a row as the factor does
    inverse = np.zeros((samples, samples))
    best, at = math.nan, first[0]
    count = 0
    for n in range(samples):
        if n < len(first) or not count:
            x = first[n] if n < len(first) else rng.random(d)
        else:
            y = found[:count]
            mean, spread = y.mean(), max(y.std(), 1e-6)
            tries = np.concatenate([rng.random((CANDIDATES // 2, d)), np.clip(at + rng.normal(0, 0.15, (CANDIDATES // 2, d)), 0, 1 - 1e-9)])
            cross = matern(tries, places[:count])
            half = inverse[:count, :count] @ cross.T
            back = inverse[:count, :count] @ ((y - mean) / spread)
            bound = half.T @ back + KAPPA * np.sqrt(np.maximum(1 - (half * half).sum(0), 0))
            x = tries[bound.argmax()]
        v = value(x)
        if math.isnan(v):
            continue
        row = inverse[:count, :count] @ matern(places[:count], x[None])[:, 0]
        end = math.sqrt(max(1 + NOISE - row @ row, NOISE))
        inverse[count, :count], inverse[count, count] = -(row @ inverse[:count, :count]) / end, 1 / end
        places[count], found[count] = x, abs(v)
        count += 1
        if math.isnan(best) or abs(v) > abs(best):
            best, at = v, x
    return at, best


#: Searches whose candidates are weighed together, and numbers of the inverse factors that are held at a time.
TOGETHER, HELD = 16, 1 << 23


def _matern(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``matern`` of stacks of rows, from products."""
    r = (a * a).sum(-1)[..., :, None] + (b * b).sum(-1)[..., None, :] - 2 * (a @ np.swapaxes(b, -1, -2))
    np.maximum(r, 0, out=r)
    r *= 5 / LENGTH**2
    np.sqrt(r, out=r)
    out = r / 3
    out += 1
    out *= r
    out += 1
    np.negative(r, out=r)
    out *= np.exp(r, out=r)
    return out


class _Searches:
    """Searches that take their steps together, from the same first places and by the same random numbers.

    So the covariances of first places with each other, and with candidates
    drawn anywhere or around a first place, are one table for all searches.
    Only places found later are a search's own, and the rows of the inverse of
    the Cholesky factor that belong to them: ``own`` on the first places,
    ``later`` on the later ones.
    """

    def __init__(self, first: np.ndarray, samples: int, count: int):
        self.first, m = first, len(first)
        self.base = np.zeros((m, m))
        for n in range(m):
            row = self.base[:n, :n] @ _matern(first[:n], first[n : n + 1])[:, 0]
            end = math.sqrt(max(1 + NOISE - row @ row, NOISE))
            self.base[n, :n], self.base[n, n] = -(row @ self.base[:n, :n]) / end, 1 / end
        self.places = np.empty((count, samples - m, first.shape[1]))
        self.own, self.later = np.zeros((count, samples - m, m)), np.zeros((count, samples - m, samples - m))
        self.k = 0

    def told(self, y: np.ndarray) -> None:
        """Take the values of all places so far, relative to their mean."""
        m, k = len(self.first), self.k
        own, later = self.own[:, :k], self.later[:, :k, :k]
        self.back = y[:, :m] @ self.base.T, (own @ y[:, :m, None] + later @ y[:, m:, None])[:, :, 0]

    def bounds(self, tries: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        """Upper bounds at the candidates of ``rows``, which are one table for all of them or one for each."""
        k, each = self.k, tries.ndim == 3
        if not each:
            cross = _matern(tries, self.first)
            half = cross @ self.base.T
            sure = (half * half).sum(-1)
        for at in range(0, len(rows), TOGETHER):
            some = rows[at : at + TOGETHER]
            t = tries[at : at + TOGETHER] if each else tries
            if each:
                cross = _matern(t, self.first)
                half = cross @ self.base.T
                sure = np.einsum("pck,pck->pc", half, half)
            more = cross @ np.swapaxes(self.own[some, :k], 1, 2)
            more += _matern(t, self.places[some, :k]) @ np.swapaxes(self.later[some, :k, :k], 1, 2)
            left = np.maximum(1 - sure - np.einsum("pck,pck->pc", more, more), 0)
            mean = (half @ self.back[0][some, :, None] + more @ self.back[1][some, :, None])[:, :, 0]
            out[some] = mean + KAPPA * np.sqrt(left)

    def add(self, x: np.ndarray) -> None:
        k = self.k
        own, later = self.own[:, :k], self.later[:, :k, :k]
        cross = _matern(x, self.first)
        row = cross @ self.base.T
        more = (own @ cross[:, :, None] + later @ _matern(self.places[:, :k], x[:, None]))[:, :, 0]
        end = np.sqrt(np.maximum(1 + NOISE - (row * row).sum(1) - (more * more).sum(1), NOISE))[:, None]
        self.own[:, k] = -(row @ self.base + (more[:, None] @ own)[:, 0]) / end
        self.later[:, k, :k], self.later[:, k, k] = -(more[:, None] @ later)[:, 0] / end, 1 / end[:, 0]
        self.places[:, k] = x
        self.k = k + 1


def searched_many(value, d: int, samples: int, searches: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """``searched`` for many searches: ``value`` takes their numbers and a place for each.

    All draw the same numbers, so one step of them is one step of arrays. A
    search in which some value is no number draws others, and is done alone.
    """
    steps = np.array(plastic_steps(d))
    first = (0.5 + np.outer(np.arange(1, initial(samples) + 1), steps)) % 1.0
    m, half = len(first), CANDIDATES // 2
    at, best = np.empty((searches, d)), np.empty(searches)
    portion = max(TOGETHER, HELD // samples**2)
    for start in range(0, searches, portion):
        rows = np.arange(start, min(start + portion, searches))
        rng, p = np.random.default_rng(seed), len(rows)
        each, found, known = np.arange(p), np.empty((p, samples)), _Searches(first, samples, p)
        top, where, told = np.full(p, -1.0), np.zeros(p, int), np.empty(p)
        odd, bound = np.zeros(p, bool), np.empty((2, p, half))
        for n in range(samples):
            if n < m:
                x = np.broadcast_to(first[n], (p, d))
            else:
                y = found[:, :n]
                known.told((y - y.mean(1)[:, None]) / np.maximum(y.std(1), 1e-6)[:, None])
                anywhere, near = rng.random((half, d)), rng.normal(0, 0.15, (half, d))
                known.bounds(anywhere, each, bound[0])
                for k in np.unique(where[where < m]):
                    known.bounds(np.clip(first[k] + near, 0, 1 - 1e-9), np.flatnonzero(where == k), bound[1])
                on = np.flatnonzero(where >= m)
                for some in (on[k : k + 64] for k in range(0, len(on), 64)):
                    centres = known.places[some, where[some] - m]
                    known.bounds(np.clip(centres[:, None] + near, 0, 1 - 1e-9), some, bound[1])
                one, two = bound.argmax(2)
                centres = np.where((where < m)[:, None], first[np.minimum(where, m - 1)], known.places[each, np.maximum(where - m, 0)])
                around = bound[1, each, two] > bound[0, each, one]
                x = np.where(around[:, None], np.clip(centres + near[two], 0, 1 - 1e-9), anywhere[one])
            v = np.asarray(value(rows, x), float)
            odd |= np.isnan(v)
            if odd.all():
                break
            v = np.where(odd, 0.0, v)
            if n >= m:
                known.add(x)
            found[:, n] = np.abs(v)
            more = found[:, n] > top
            top, where, told = np.where(more, found[:, n], top), np.where(more, n, where), np.where(more, v, told)
            at[rows[more]] = x[more]
        best[rows] = told
        for k in np.flatnonzero(odd):
            at[rows[k]], best[rows[k]] = searched(lambda u: float(value(rows[k : k + 1], u[None])[0]), d, samples, seed)
    return at, best


def _points(df: DataFrame, factor: int, measure: str) -> DataFrame:
    """(id, at, v): each point's block, offset in the block and vector as the measure wants it."""
    cell = F.struct(*[F.floor(F.col(a) / factor).alias(f"b{a}") for a in "zyx"])
    place = (F.pmod("z", F.lit(factor)) * factor + F.pmod("y", F.lit(factor))) * factor + F.pmod("x", F.lit(factor))
    return regions.point_vectors(df, measure).select(cell.alias("id"), place.cast("int").alias("at"), "v")


def _found(samples: int, factor: int, sizes: tuple, measure: str, equal: bool, listed: bool, cells: tuple | None, clicked: tuple | None, options: dict):
    def side(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Blocks and their extents, and the number of the row of each of their points, -1 where there is none."""
        blocks, k = np.unique(tiles.places(table), axis=0, return_inverse=True)
        rows = np.full((len(blocks), factor**3), -1)
        rows[k.ravel(), table["at"].to_numpy()] = np.arange(table.num_rows)
        return blocks, np.minimum(factor, np.array(sizes)[::-1] - blocks * factor)[:, ::-1], rows

    def vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list]:
        """Length of each row's vector and its number among those of that length, which are matrices."""
        length, number, matrices = np.zeros(table.num_rows, int), np.zeros(table.num_rows, int), {}
        for d, (at, v) in tiles.by_length(table).items():
            length[at], number[at], matrices[d] = d, np.arange(len(at)), v
        return length, number, matrices

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        asked = None
        if listed:
            # rows without a vector name the pairs that are asked for
            pairs = x.filter(pc.is_null(x["v"]))
            x, asked = x.filter(pc.is_valid(x["v"])), np.hstack([tiles.places(pairs), tiles.places(pairs, "j")])
        if not x.num_rows or not y.num_rows:
            return tiles.rows_of(np.empty((0, 3), np.int64), np.empty((0, 3), np.int64), value=np.empty(0))
        (p, np_, rp), (q, nq, rq) = side(x), side(y)
        if listed:
            numbers = [{tuple(b): k for k, b in enumerate(blocks.tolist())} for blocks in (p, q)]
            known = [(numbers[0].get(tuple(r[:3])), numbers[1].get(tuple(r[3:]))) for r in asked.tolist()]
            i, j = np.array([k for k in known if None not in k], int).reshape(-1, 2).T
        else:
            i, j = np.nonzero(tiles.after(p[:, None], q[None], equal))
        wanted = np.ones(len(i), bool)
        if cells is not None:
            far = np.sqrt(((p[i] - q[j]) ** 2).sum(1))
            wanted &= (far >= cells[0]) & (far <= cells[1])
        if clicked is not None:
            at = np.array(clicked)[::-1]
            wanted &= (p[i] == at).all(1) | (q[j] == at).all(1)
        i, j = i[wanted], j[wanted]
        (lx, ax, mx), (ly, ay, my) = vectors(x), vectors(y)

        def value(k: np.ndarray, u: np.ndarray) -> np.ndarray:
            out, rows = np.full(len(k), np.nan), []
            for places, extent, known in ((u[:, :3], np_[i[k]], rp[i[k]]), (u[:, 3:], nq[j[k]], rq[j[k]])):
                cx, cy, cz = np.minimum((places * extent).astype(int), extent - 1).T
                rows.append(known[np.arange(len(k)), (cz * factor + cy) * factor + cx])
            a, b = rows
            ok = (a >= 0) & (b >= 0)
            for d in np.unique(lx[a[ok]]):
                at = np.flatnonzero(ok & (lx[a] == d) & (ly[b] == d))
                if not len(at) or not d:
                    continue
                one, two = mx[int(d)][ax[a[at]]], my[int(d)][ay[b[at]]]
                out[at] = (one * two).sum(1) if measure == "pearson" else kernels.all_values(measure, list(one), list(two), **options)
            return out

        best = searched_many(value, 6, samples, len(i))[1]
        return tiles.rows_of(p[i], q[j], value=best)

    return run


def bayesian_pairs(
    df: DataFrame, factor: int, sizes: tuple, samples: int, measure: str = "pearson", second: DataFrame | None = None, diagonal: bool = False,
    low: float | None = None, high: float | None = None, absolute: bool = False, cells: tuple | None = None, clicked: tuple | None = None,
    listed: DataFrame | None = None, **options,
) -> DataFrame:
    """(i, j, value): the value of largest magnitude that a Bayesian search with ``samples`` pairs of points finds for each pair of blocks.

    i is a block of df, j one of df too, or of the field ``second``. Pairs are
    i > j, i >= j with ``diagonal`` or a second field, or those ``listed``.
    """
    a = tiles.dealt(_points(df, factor, measure), tiles.POINTS)
    b = a if second is None else tiles.dealt(_points(second, factor, measure), tiles.POINTS)
    asked = None
    if listed is not None:
        home = lambda side, c: side[0].select(F.col("id").alias(c), F.col("g").alias(f"g{c}")).distinct()
        asked = listed.select(*[F.col(c).cast(_ID).alias(c) for c in "ij"]).join(home(a, "i"), "i").join(home(b, "j"), "j")
        asked = asked.select(F.col("gi").alias("ga"), F.col("gj").alias("gb"), F.col("i").alias("id"), "j")
    run = _found(samples, factor, tuple(sizes), measure, diagonal or second is not None, listed is not None, cells, clicked, options)
    out = tiles.met(a, b, run, f"{tiles.PAIR}, value double", asked)
    out = out.withColumn("value", F.abs("value")) if absolute else out
    return regions.within(out, low, high)


bayesian_pairs.initial = initial
