"""Fitting a transfer function: losses and gradients as grouped sums, small systems solved in the driver.

Rows have j and f (see grid.transfer_weights) and a target. A transfer
function has at most MOST_ENTRIES entries, so its normal equations, one
number for each entry and pair of neighbours, are all that leaves Spark.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlark.operators.grid import normal_equations
from gridlark.session import checkpointed

MOST_ENTRIES = 256


def system(df: DataFrame, target: Column, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """A'A and A'b of the rows, as arrays of at most MOST_ENTRIES squared numbers."""
    if entries > MOST_ENTRIES:
        raise ValueError(f"a transfer function has at most {MOST_ENTRIES} entries, not {entries}")
    a, b = np.zeros((entries, entries)), np.zeros(entries)
    for r in normal_equations(df, target).collect():
        if r["right"]:
            b[r["i"]] = r["ata"]
        else:
            a[r["i"], r["j"]] = a[r["j"], r["i"]] = r["ata"]
    return a, b


def boxed(a: np.ndarray, b: np.ndarray, low: float, high: float, tolerance: float = 1e-12) -> np.ndarray:
    """The x in [low, high] of smallest x'ax / 2 - b'x, for a positive definite a, by active sets.

    Entries at a bound are fixed there and the others solved for. A solution
    that leaves the box is followed as far as the first bound, which then
    holds its entry; an entry is let go where the slope points back inside.
    """
    n = len(b)
    x = np.full(n, float(low))
    free = np.zeros(n, bool)
    scale = tolerance * max(1.0, np.abs(b).max(initial=0), np.abs(a).max(initial=0))
    for _ in range(100 * n + 100):
        slope = a @ x - b
        # the steepest bound entry whose slope points inside
        gain = np.where(free, 0, np.where(x <= low, -slope, slope))
        gain[(x <= low) & (x >= high)] = 0
        k = int(gain.argmax()) if n else 0
        if not n or gain[k] <= scale:
            return x
        free[k] = True
        while free.any():
            at = np.flatnonzero(free)
            step = np.linalg.solve(a[np.ix_(at, at)], (b - a @ x)[at])
            room = np.where(step > 0, high - x[at], low - x[at])
            part = np.divide(room, step, out=np.full(len(at), np.inf), where=step != 0)
            if part.min() >= 1:
                x[at] += step
                break
            first = part.argmin()
            x[at] += max(part[first], 0.0) * step
            x[at[first]] = high if step[first] > 0 else low
            free[at[first]] = False
    raise RuntimeError("the active sets did not settle")


def conjugate(a: np.ndarray, b: np.ndarray, ridge: float = 0.0, tolerance: float = 1e-12, rounds: int | None = None) -> np.ndarray:
    """The x of (a + ridge) x = b by conjugate gradients on the normal equations (CGLS), whose products a sums up once."""
    x, r = np.zeros(len(b)), b.astype(float).copy()
    p, size = r.copy(), r @ r
    for _ in range(rounds or 10 * len(b)):
        if size <= tolerance**2 * (b @ b):
            break
        q = a @ p + ridge * p
        step = size / (p @ q)
        x, r = x + step * p, r - step * q
        size, before = r @ r, size
        p = r + size / before * p
    return x


def solved(df: DataFrame, target: Column, entries: int, ridge: float = 1e-3, box: tuple | None = (0.0, 1.0), solver: str = "direct") -> DataFrame:
    """(j, value): the least-squares transfer function with a ridge, within the box if one is given.

    Without a box, the ``solver`` is "direct" or "cgls". The rows are read
    once: all solvers start from the normal equations.
    """
    a, b = system(df, target, entries)
    if box is not None:
        x = boxed(a + ridge * np.eye(entries), b, *map(float, box))
    elif solver == "cgls":
        x = conjugate(a, b, ridge)
    else:
        x = np.linalg.lstsq(a + ridge * np.eye(entries), b, rcond=None)[0]
    return df.sparkSession.createDataFrame(list(enumerate(map(float, x))), "j int, value double")


def fitted(table: list[float]) -> Column:
    """The value of a transfer function at j and f."""
    entries = F.array(*[F.lit(float(v)) for v in table])
    return F.get(entries, F.col("j")) * (1 - F.col("f")) + F.get(entries, F.col("j") + 1) * F.col("f")


def losses(df: DataFrame, target: Column, table: list[float]) -> DataFrame:
    """One row: mean absolute (l1) and mean square (l2) difference from the target."""
    apart = fitted(table) - target
    return df.agg(F.avg(F.abs(apart)).alias("l1"), F.avg(apart * apart).alias("l2"))


def gradient(df: DataFrame, target: Column, table: list[float], loss: str = "l2", times: Column | None = None) -> DataFrame:
    """(i, value): the derivative of the loss by each entry; a row counts ``times``, once by default."""
    times = F.lit(1) if times is None else times
    apart = fitted(table) - target
    slope = 2 * apart if loss == "l2" else F.when(apart >= 0, 1.0).otherwise(-1.0)
    rows = df.select(F.explode(F.array(
        F.struct(F.col("j").alias("i"), (times * slope * (1 - F.col("f"))).alias("g"), times.alias("k")),
        F.struct((F.col("j") + 1).alias("i"), (times * slope * F.col("f")).alias("g"), times.alias("k")),
    )).alias("r"))
    # every row has two parts: their number is twice that of the rows
    total = rows.groupBy("r.i").agg(F.sum("r.g").alias("g"), F.sum("r.k").alias("n"))
    return total.select("i", (F.col("g") / (F.sum("n").over(Window.partitionBy()) / 2)).alias("value"))


def descended(df: DataFrame, target: Column, entries: int, loss: str = "l2", adam: bool = True, epochs: int = 200, rate: float = 0.4, beta: tuple = (0.9, 0.999), eps: float = 1e-8, smooth: float = 0.0) -> DataFrame:
    """(j, value): the transfer function after gradient descent from 0.5, kept in [0, 1] in every step.

    The gradient of the square loss follows from the normal equations, which
    are summed once; that of the absolute loss is a grouped sum in every epoch
    over a table of its own, in which equal rows are one.
    """
    x, m, v = np.full(entries, 0.5), np.zeros(entries), np.zeros(entries)
    if loss == "l2":
        a, b = system(df, target, entries)
        n = df.count()
    else:
        rows = df.select("j", "f", target.alias("target")).filter("j IS NOT NULL AND NOT isnan(target)").groupBy("j", "f", "target").agg(F.count("*").alias("times"))
        rows = checkpointed(rows)
    for t in range(1, epochs + 1):
        if loss == "l2":
            g = 2 * (a @ x - b) / max(n, 1)
        else:
            g = np.zeros(entries)
            for r in gradient(rows, F.col("target"), x.tolist(), loss, F.col("times")).collect():
                g[r["i"]] = r["value"]
        if smooth:
            g = g + smooth * prior(x)
        if adam:
            m, v = beta[0] * m + (1 - beta[0]) * g, beta[1] * v + (1 - beta[1]) * g * g
            g = (m / (1 - beta[0] ** t)) / (np.sqrt(v / (1 - beta[1] ** t)) + eps)
        x = np.clip(x - rate * g, 0.0, 1.0)
    return df.sparkSession.createDataFrame(list(enumerate(map(float, x))), "j int, value double")


def prior(x: np.ndarray) -> np.ndarray:
    """What the smoothing prior adds to the gradient of each entry."""
    d = np.diff(x)
    g = np.zeros(len(x))
    g[1:] += d
    g[:-1] -= d
    return g / (2.0 * max(len(x) - 1, 1))


def smoothing_prior(table: DataFrame, weight: float = 1.0) -> DataFrame:
    """(j, value): the same of a table (j, value) of at most MOST_ENTRIES rows."""
    w = Window.orderBy("j")
    v = F.col("value")
    part = F.coalesce(v - F.lag("value").over(w), F.lit(0.0)) + F.coalesce(v - F.lead("value").over(w), F.lit(0.0))
    n = F.greatest(F.count("*").over(Window.partitionBy()) - 1, F.lit(1))
    return table.select("j", (weight * part / (2.0 * n)).alias("value"))
