"""Kendall's tau and Kraskov's estimate of whole fields against the kernels of one vector."""

import numpy as np
import pytest

from gridlark.functions import kernels
from gridlark.functions.measures import psi
from gridlark.operators import similarity, whole


def _frame(spark, a, b, parts=4):
    return spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double").repartition(parts)


def _shapes(kind, n=700):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=n), rng.normal(size=n)
    if kind == "dependent":
        b = a + 0.3 * b
    if kind == "ties":
        a, b = np.round(a), np.round(b * 2)
    if kind == "one value holds a third":
        a[: n // 3] = 0.25
        b[n // 2 : n // 2 + n // 3] = -1.0
    if kind == "outliers":
        a[:9] *= 1e6
        b[3:12] *= -1e4
    if kind == "copies":
        a[: n // 2], b[: n // 2] = a[0], b[0]
    return a, b


KINDS = ("plain", "dependent", "ties", "one value holds a third", "outliers", "copies")


@pytest.mark.parametrize("kind", KINDS)
def test_kendall_over_ranges(spark, monkeypatch, kind):
    a, b = _shapes(kind)
    monkeypatch.setattr(whole, "RANGE", 60)  # several ranges, and ranges of ranges
    for variant in ("tau_b", "plain_ties", "tau_a"):
        got = whole.kendall(_frame(spark, a, b), variant)
        assert got == pytest.approx(kernels.kendall(a, b, variant), abs=1e-12)


def test_no_task_counts_more_than_a_range(spark, monkeypatch):
    a, b = _shapes("one value holds a third", 3000)
    seen = []
    real = whole._summed

    def noting(groups, key):
        seen.append(groups.groupBy(key).count().agg({"count": "max"}).first()[0])
        return real(groups, key)

    monkeypatch.setattr(whole, "_summed", noting)
    monkeypatch.setattr(whole, "RANGE", 200)
    assert whole.kendall(_frame(spark, a, b)) == pytest.approx(kernels.kendall(a, b), abs=1e-12)
    assert len(seen) >= 3 and max(seen) <= 3 * 200


def test_weights_beyond_64_bits():
    r, w = np.array([2, 0, 1]), np.array([5 * 10**9, 7 * 10**9, 3 * 10**9])
    assert whole.weighted_inversions(r, w) == 5 * 10**9 * (7 + 3) * 10**9


@pytest.mark.parametrize("estimator", [1, 2])
@pytest.mark.parametrize("kind", KINDS)
def test_kraskov_over_cells(spark, monkeypatch, kind, estimator):
    a, b = _shapes(kind, 400)
    if estimator == 2 and kind in ("ties", "copies", "one value holds a third"):
        pytest.skip("which of several nearest points count is not defined")
    monkeypatch.setattr(whole, "CELL", 30)
    monkeypatch.setattr(whole, "RANGE", 90)
    for k in (1, 4):
        got = whole.mi_ksg(_frame(spark, a, b), k=k, estimator=estimator)
        assert got == pytest.approx(kernels.mi_ksg(a, b, k=k, estimator=estimator), abs=1e-9), k


def test_squares_of_a_wide_field_meet_few_cells(spark):
    rng = np.random.default_rng(8)
    a, b = 1000 * rng.normal(size=4000), rng.normal(size=4000)
    d = np.concatenate([np.partition(np.maximum(np.abs(a[s, None] - a), np.abs(b[s, None] - b)), 10, axis=1)[:, 10] for s in np.array_split(np.arange(4000), 8)])
    points = spark.createDataFrame([(float(x), float(y), 1, k) for k, (x, y) in enumerate(zip(a, b))], "a double, b double, w long, id long")
    cells = whole._cut(points, 4000, 200).toPandas()
    at, of = cells["id"].to_numpy(), cells["cell"].to_numpy()
    met = 0
    for cell, g in cells.groupby("cell"):
        near = (g["a"].min() - a[at] < d[at]) & (a[at] - g["a"].max() < d[at]) & (g["b"].min() - b[at] < d[at]) & (b[at] - g["b"].max() < d[at])
        met += int((near & (of != cell)).sum())
    assert len(np.unique(of)) >= 10 and met < 4000 / 2


@pytest.mark.parametrize("estimator", [1, 2])
def test_kraskov_of_a_wide_field(spark, monkeypatch, estimator):
    monkeypatch.setattr(whole, "CELL", 12)
    monkeypatch.setattr(whole, "RANGE", 40)
    rng = np.random.default_rng(9)
    a, b = 1000 * rng.normal(size=300), rng.normal(size=300)
    # cells with fewer points than neighbours, and many ends in few parts
    if estimator == 1:
        b = np.round(b)
    got = whole.mi_ksg(_frame(spark, a, b), k=3, estimator=estimator)
    assert got == pytest.approx(kernels.mi_ksg(a, b, k=3, estimator=estimator), abs=1e-9)


@pytest.mark.parametrize("kind", KINDS)
def test_points_within_a_distance(kind):
    a, b = _shapes(kind)
    a, b = np.unique(np.column_stack([a, b]), axis=0).T
    far = np.maximum(np.abs(a[:, None] - a), np.abs(b[:, None] - b))
    strips = whole._Strips(a, b, 40)
    for k in (1, 7):
        bound = strips.bounds(k)
        parts = list(strips.within(a, b, bound, most=500))
        assert (bound >= np.sort(far, axis=1)[:, k]).all() and len(parts) > 1
        i, at, dx, dy = (np.concatenate(v) for v in zip(*parts))
        assert (np.diff(i) >= 0).all() and len(i) == (far <= bound[:, None]).sum()
        assert (np.maximum(dx, dy) == far[i, at]).all() and (far[i, at] <= bound[i]).all()


def test_default_k_and_small_fields(spark):
    a, b = _shapes("dependent", 150)
    assert whole.mi_ksg(_frame(spark, a, b)) == pytest.approx(kernels.mi_ksg(a, b), abs=1e-9)
    for n in (1, 2, 3):
        got = whole.mi_ksg(_frame(spark, a[:n], b[:n]), k=5)
        assert got == pytest.approx(1.0 if n == 1 else kernels.mi_ksg(a[:n], b[:n], k=5), abs=1e-9)
    assert whole.kendall(_frame(spark, a[:1], b[:1])) == 1.0
    assert np.isnan(whole.kendall(_frame(spark, a, 0 * b)))


def test_nan_rows_are_left_out_and_coefficients(spark):
    a, b = _shapes("dependent", 120)
    df = _frame(spark, [*a, float("nan"), 1.0], [*b, 1.0, float("nan")])
    value = lambda m, **o: similarity.field_similarity(df, "a", "b", m, **o).first().value
    assert value("kendall") == pytest.approx(kernels.kendall(a, b), abs=1e-12)
    assert value("mi_ksg_coefficient", k=3) == pytest.approx(kernels.KERNELS["mi_ksg_coefficient"](a, b, k=3), abs=1e-9)


def test_digamma_of_large_numbers(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(n,) for n in (1, 2, 31, 32, 33, 100, 5000)], "n long").select("n", whole.digamma(F.col("n")).alias("v"))
    assert all(r.v == pytest.approx(psi(r.n), abs=1e-13) and whole._digamma(r.n) == pytest.approx(r.v, abs=1e-14) for r in df.collect())
