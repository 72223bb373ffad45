"""Dependence of two vectors in numpy, run over Arrow batches of packed vectors.

A vector with NaN gives NaN, a single member gives 1, a constant side NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlark.functions.measures import default_k, psi

NAN = float("nan")


def pearson(a: np.ndarray, b: np.ndarray) -> float:
    x, y = a - a.mean(), b - b.mean()
    size = np.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / size) if size > 0 else NAN


def ranks(a: np.ndarray) -> np.ndarray:
    """Fractional ranks: ties share the mean of their ranks."""
    _, at, n = np.unique(a, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def spearman(a: np.ndarray, b: np.ndarray) -> float:
    return pearson(ranks(a), ranks(b))


def inversions(r: np.ndarray) -> int:
    """Pairs of whole numbers that stand in falling order; each doubling of the runs is one search in numpy."""
    n = len(r)
    size, w, total = 1 << max(n - 1, 0).bit_length(), 1, 0
    top = int(r.max()) + 1 if n else 0
    x = np.full(size, top, np.int64)
    x[:n] = r
    while w < size:
        runs = x.reshape(-1, 2 * w)
        left, right = np.sort(runs[:, :w], axis=1), runs[:, w:]
        row = np.arange(len(runs), dtype=np.int64)[:, None]
        at = np.searchsorted((left + row * (top + 1)).ravel(), (right + row * (top + 1)).ravel(), side="right")
        total += int((w - (at.reshape(right.shape) - row * w)).sum())
        w *= 2
    return total


def _tied(x: np.ndarray) -> int:
    return sum(int(c) * (int(c) - 1) // 2 for c in np.unique(x, return_counts=True, axis=0)[1])


def kendall(a: np.ndarray, b: np.ndarray, variant: str = "tau_b") -> float:
    """Kendall's tau: tau_b counts joint ties, plain_ties leaves them out of the numerator, tau_a knows no ties."""
    n = len(a)
    order = np.lexsort((b, a))
    swapped = inversions(np.unique(b[order], return_inverse=True)[1])
    n0 = n * (n - 1) // 2
    if variant == "tau_a":
        return (n0 - 2 * swapped) / n0
    n1, n2 = _tied(a), _tied(b)
    n3 = _tied(np.column_stack((a, b))) if variant == "tau_b" else 0
    if n0 == n1 or n0 == n2:
        return NAN
    return float((n0 - n1 - n2 + n3 - 2 * swapped) / np.sqrt(float(n0 - n1) * float(n0 - n2)))


def mi_binned(a: np.ndarray, b: np.ndarray, bins: int = 80, low: float | None = None, high: float | None = None) -> float:
    """Mutual information of the joint histogram, in nats; bins span both vectors unless bounds are given."""
    low = min(a.min(), b.min()) if low is None else low
    high = max(a.max(), b.max()) if high is None else high
    if not high > low:
        return 0.0
    i, j = (np.clip(np.floor((x - low) / (high - low) * bins), 0, bins - 1).astype(int) for x in (a, b))
    joint = np.bincount(i * bins + j, minlength=bins * bins).reshape(bins, bins) / len(a)
    p, q = joint.sum(1, keepdims=True), joint.sum(0, keepdims=True)
    full = joint > 0
    return float((joint[full] * np.log(joint[full] / (p * q)[full])).sum())


def mi_ksg(a: np.ndarray, b: np.ndarray, k: int | None = None, estimator: int = 1, noise: float = 0.0, block: int = 256) -> float:
    """Kraskov's estimate from k-th neighbour distances, ``block`` rows of distances at once.

    ``noise`` adds seeded uniform noise of that size, which breaks ties.
    """
    n = len(a)
    if noise:
        rng = np.random.default_rng(617)
        a, b = a + noise * rng.random(n), b + noise * rng.random(n)
    kk = min(k or default_k(n), n - 1)
    dig = np.cumsum(np.concatenate(([psi(1)], 1 / np.arange(1, n + 1))))
    total = 0.0
    for s in range(0, n, block):
        rows = np.arange(s, min(s + block, n))
        dx, dy = np.abs(a[rows, None] - a), np.abs(b[rows, None] - b)
        far = np.maximum(dx, dy)
        far[np.arange(len(rows)), rows] = np.inf
        if estimator == 1:
            d = np.partition(far, kk - 1, axis=1)[:, kk - 1 : kk]
            nx, ny = (np.maximum((x < d).sum(1), 1) for x in (dx, dy))
        else:
            near = np.argpartition(far, kk - 1, axis=1)[:, :kk]
            nx, ny = (np.maximum((x <= np.take_along_axis(x, near, 1).max(1)[:, None]).sum(1) - 1, 1) for x in (dx, dy))
        total += float(dig[nx - 1].sum() + dig[ny - 1].sum())
    more = 1 / kk if estimator == 2 else 0.0
    return float(max(0.0, dig[kk - 1] - more + dig[n - 1] - total / n))


def coefficient(kernel: Callable) -> Callable:
    """The mutual information of a kernel as a correlation coefficient."""
    return lambda a, b, **more: float(np.sqrt(1 - np.exp(-2 * kernel(a, b, **more))))


#: Members up to which vectors of equal length are taken together, and elements of an array at once.
TOGETHER, ELEMENTS = 256, 1 << 22


def _pearson_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    size = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    return np.where(size > 0, (x * y).sum(1) / np.where(size > 0, size, 1), NAN)


def _signs(a: np.ndarray) -> np.ndarray:
    """Signs of the differences of all pairs of members."""
    return (a[:, :, None] > a[:, None, :]).view(np.int8) - (a[:, :, None] < a[:, None, :]).view(np.int8)


def _ranks_rows(a: np.ndarray) -> np.ndarray:
    return (_signs(a).sum(2, dtype=np.int64) + a.shape[1] + 1) / 2


def _kendall_rows(a: np.ndarray, b: np.ndarray, variant: str = "tau_b") -> np.ndarray:
    sa, sb = _signs(a), _signs(b)
    both, n = sa * sb, a.shape[1]
    n0 = n * (n - 1) // 2
    falls = (both < 0).sum((1, 2)) // 2
    if variant == "tau_a":
        return (n0 - 2 * falls) / n0
    tied = lambda s: ((s == 0).sum((1, 2)) - n) // 2
    n1, n2 = tied(sa), tied(sb)
    n3 = tied(np.abs(sa) + np.abs(sb)) if variant == "tau_b" else 0
    ok = (n1 < n0) & (n2 < n0)
    return np.where(ok, (n0 - n1 - n2 + n3 - 2 * falls) / np.sqrt(np.where(ok, (n0 - n1).astype(float) * (n0 - n2), 1)), NAN)


def _mi_binned_rows(a: np.ndarray, b: np.ndarray, bins: int = 80, low: float | None = None, high: float | None = None) -> np.ndarray:
    n, m = a.shape
    lo = np.minimum(a.min(1), b.min(1))[:, None] if low is None else np.full((n, 1), float(low))
    hi = np.maximum(a.max(1), b.max(1))[:, None] if high is None else np.full((n, 1), float(high))
    wide = hi > lo
    i, j = (np.clip(np.floor((x - lo) / np.where(wide, hi - lo, 1) * bins), 0, bins - 1).astype(int) for x in (a, b))
    at = (np.arange(n)[:, None] * bins + i) * bins + j
    joint = np.bincount(at.ravel(), minlength=n * bins * bins).reshape(n, bins, bins) / m
    pq = joint.sum(2, keepdims=True) * joint.sum(1, keepdims=True)
    full = joint > 0
    part = np.zeros_like(joint)
    part[full] = joint[full] * np.log(joint[full] / pq[full])
    return np.where(wide[:, 0], part.sum((1, 2)), 0.0)


def _mi_ksg_rows(a: np.ndarray, b: np.ndarray, k: int | None = None, estimator: int = 1, noise: float = 0.0) -> np.ndarray:
    n = a.shape[1]
    if noise:
        rng = np.random.default_rng(617)
        a, b = a + noise * rng.random(n), b + noise * rng.random(n)
    kk = min(k or default_k(n), n - 1)
    dig = np.cumsum(np.concatenate(([psi(1)], 1 / np.arange(1, n + 1))))
    dx, dy = np.abs(a[:, :, None] - a[:, None, :]), np.abs(b[:, :, None] - b[:, None, :])
    far = np.maximum(dx, dy)
    far[:, np.arange(n), np.arange(n)] = np.inf
    if estimator == 1:
        d = np.partition(far, kk - 1, axis=2)[:, :, kk - 1 : kk]
        nx, ny = (np.maximum((x < d).sum(2), 1) for x in (dx, dy))
    else:
        near = np.argpartition(far, kk - 1, axis=2)[:, :, :kk]
        nx, ny = (np.maximum((x <= np.take_along_axis(x, near, 2).max(2)[:, :, None]).sum(2) - 1, 1) for x in (dx, dy))
    more = 1 / kk if estimator == 2 else 0.0
    return np.maximum(0.0, dig[kk - 1] - more + dig[n - 1] - (dig[nx - 1] + dig[ny - 1]).sum(1) / n)


#: Of many pairs of vectors of one length at once: (rows, members) arrays to a value for each row.
ROWS = {
    "pearson": _pearson_rows, "spearman": lambda a, b: _pearson_rows(_ranks_rows(a), _ranks_rows(b)), "kendall": _kendall_rows,
    "mi_binned": _mi_binned_rows, "mi_ksg": _mi_ksg_rows,
}


KERNELS = {
    "pearson": pearson, "spearman": spearman, "kendall": kendall, "mi_binned": mi_binned, "mi_ksg": mi_ksg,
    "mi_binned_coefficient": coefficient(mi_binned), "mi_ksg_coefficient": coefficient(mi_ksg),
}


def all_values(measure: str, xs: list, ys: list, **options) -> np.ndarray:
    """The measure of each pair of vectors; those of one length are taken together, long ones one by one."""
    out, together = np.full(len(xs), NAN), {}
    for k, (x, y) in enumerate(zip(xs, ys)):
        if x is None or y is None or not len(x) or len(x) != len(y):
            continue
        x, y = np.asarray(x, float), np.asarray(y, float)
        if len(x) == 1:
            out[k] = 1.0
        elif not (np.isnan(x).any() or np.isnan(y).any()):
            together.setdefault(len(x), []).append((k, x, y))
    name = measure.removesuffix("_coefficient")
    for n, rows in together.items():
        at = [k for k, _, _ in rows]
        if n > TOGETHER:
            out[at] = [KERNELS[name](x, y, **options) for _, x, y in rows]
            continue
        step = max(1, ELEMENTS // max(n * n, options.get("bins", 80) ** 2 if name == "mi_binned" else 1))
        for s in range(0, len(rows), step):
            part = rows[s : s + step]
            out[at[s : s + step]] = ROWS[name](np.stack([x for _, x, _ in part]), np.stack([y for _, _, y in part]), **options)
    if name != measure:
        many = np.array([x is not None and len(x) > 1 for x in xs], bool)
        out[many] = np.sqrt(1 - np.exp(-2 * out[many]))
    return out


def _spearman_table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = (np.stack([ranks(v) for v in side]) - (side.shape[1] + 1) / 2 for side in (a, b))
    size = np.sqrt(np.outer((x * x).sum(1), (y * y).sum(1)))
    return np.where(size > 0, x @ y.T / np.where(size > 0, size, 1), NAN)


def _kendall_table(a: np.ndarray, b: np.ndarray, variant: str = "tau_b") -> np.ndarray:
    """Signs of the differences of all pairs of members are vectors: their products count, exactly, what rises less what falls."""
    first, then = np.triu_indices(a.shape[1], 1)
    sa, sb = ((v[:, first] > v[:, then]).astype("f4") - (v[:, first] < v[:, then]).astype("f4") for v in (a, b))
    n0, rises = len(first), (sa @ sb.T).astype(float)
    if variant == "tau_b":
        untied = rises
    else:
        # pairs that are tied on no side: those that rise, and those that fall
        both = (np.abs(sa) @ np.abs(sb).T).astype(float)
        falls = (both - rises) / 2
        if variant == "tau_a":
            return (n0 - 2 * falls) / n0
    na, nb = np.abs(sa).sum(1, dtype=float)[:, None], np.abs(sb).sum(1, dtype=float)[None]
    if variant != "tau_b":
        untied = na + nb - n0 - 2 * falls
    ok = (na > 0) & (nb > 0)
    return np.where(ok, untied / np.sqrt(np.where(ok, na * nb, 1)), NAN)


def _mi_binned_table(a: np.ndarray, b: np.ndarray, bins: int = 80, low: float | None = None, high: float | None = None) -> np.ndarray:
    """The mean over members of the logarithms of their bins' counts, which are few whole numbers."""
    n, out = a.shape[1], np.zeros((len(a), len(b)))
    logs = np.log(np.maximum(np.arange(n + 1), 1))
    step = max(1, min(ELEMENTS // (bins * bins), 256))
    ends = [(v.min(1), v.max(1)) for v in (a, b)]
    for s in range(0, len(b), step):
        y = b[s : s + step]
        row = np.arange(len(y))[:, None]
        for k, x in enumerate(a):
            lo = np.minimum(ends[0][0][k], ends[1][0][s : s + step])[:, None] if low is None else np.full((len(y), 1), float(low))
            hi = np.maximum(ends[0][1][k], ends[1][1][s : s + step])[:, None] if high is None else np.full((len(y), 1), float(high))
            width = np.where(hi > lo, hi - lo, 1)
            i, j = (np.clip(np.floor((v - lo) / width * bins), 0, bins - 1).astype(np.int64) for v in (x, y))
            i, j = i + row * bins, j + row * bins
            at = i * bins + (j - row * bins)
            told = logs[np.bincount(at.ravel(), minlength=len(y) * bins * bins)[at]]
            for side in (i, j):
                told -= logs[np.bincount(side.ravel(), minlength=len(y) * bins)[side]]
            out[k, s : s + step] = np.where((hi > lo)[:, 0], told.sum(1) / n + logs[n], 0.0)
    return out


def _mi_ksg_table(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Kraskov's first estimate: the k smallest distances of each member are kept while its neighbours pass by."""
    n, out, step = a.shape[1], np.empty((len(a), len(b))), 64
    dig = np.cumsum(np.concatenate(([psi(1)], 1 / np.arange(1, n + 1))))
    count = np.uint8 if n < 256 else np.uint16
    for s in range(0, len(b), step):
        y = b[s : s + step]
        dy = np.abs(y.T[:, :, None] - y[None])  # (neighbour, row, member)
        far, spare = np.empty(y.shape), np.empty(y.shape)
        for r, x in enumerate(a):
            dx = np.abs(x[:, None] - x)
            other = dx.copy()
            np.fill_diagonal(other, np.inf)
            least = [np.full(y.shape, np.inf) for _ in range(k)]
            for t in range(n):
                np.maximum(dy[t], other[t], out=far)
                for m in range(k):
                    np.minimum(least[m], far, out=spare)
                    if m < k - 1:
                        np.maximum(least[m], far, out=far)
                    least[m], spare = spare, least[m]
            d = least[-1]
            nx, ny = ((v < d).view(np.uint8).sum(0, dtype=count) for v in (dx[:, None], dy))
            told = dig[np.maximum(nx, 1) - 1] + dig[np.maximum(ny, 1) - 1]
            out[r, s : s + step] = np.maximum(0.0, dig[k - 1] + dig[n - 1] - told.sum(1) / n)
    return out


#: Neighbours that are kept one by one.
FEW = 8


def table(measure: str, a: np.ndarray, b: np.ndarray, **options) -> np.ndarray:
    """The measure of every row of a with every row of b, all of one length and without NaN; ``product`` is their product."""
    if measure == "product":
        return a @ b.T
    n, name = a.shape[1], measure.removesuffix("_coefficient")
    if n == 1 or not len(a) or not len(b):
        return np.ones((len(a), len(b)))
    if name == "spearman":
        out = _spearman_table(a, b)
    elif name == "kendall" and n <= TOGETHER:
        out = _kendall_table(a, b, **options)
    elif name == "mi_binned":
        out = _mi_binned_table(a, b, **options)
    elif name == "mi_ksg" and n <= TOGETHER and options.get("estimator", 1) == 1 and not options.get("noise") and min(options.get("k") or default_k(n), n - 1) <= FEW:
        out = _mi_ksg_table(a, b, min(options.get("k") or default_k(n), n - 1))
    else:
        out = np.stack([all_values(name, [x] * len(b), list(b), **options) for x in a])
    return out if name == measure else np.sqrt(1 - np.exp(-2 * out))


def of_vectors(measure: str, a: str = "a", b: str = "b", absolute: bool = False, **options) -> Column:
    """The measure of two array columns, in Arrow batches."""

    @F.pandas_udf("double")
    def told(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            found = all_values(measure, list(x), list(y), **options)
            yield pd.Series(np.abs(found) if absolute else found, dtype=float)

    return told(a, b)
