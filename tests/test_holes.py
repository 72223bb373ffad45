"""Values that clean tables don't have: NaN, infinite and far ones in bounds, bins, cells and transfer entries; long windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark import twins
from gridlark.functions.measures import bin_of
from gridlark.operators import dependence, ensemble, fitting, grid

NAN, INF = float("nan"), float("inf")


def _values(spark, v):
    return spark.createDataFrame([(float(x),) for x in v], "value double")


def test_bins_of_far_values(spark):
    v = [-INF, -1e300, -1.0, 0.0, 0.49, 0.5, 1.0, 1e12, 1e300, INF, NAN]
    got = [r.b for r in _values(spark, v).select(bin_of(F.col("value"), F.lit(0.0), F.lit(1.0), 4).alias("b")).collect()]
    assert got == [0, 0, 0, 0, 1, 2, 3, 3, 3, 3, 0]
    assert {r.b for r in _values(spark, v).select(bin_of(F.col("value"), F.lit(2.0), F.lit(2.0), 4).alias("b")).collect()} == {0}
    counts = {r.bin: r.n for r in ensemble.histogram(_values(spark, v), 0.0, 1.0, 4).collect()}
    assert counts == {0: 4, 1: 1, 2: 1, 3: 4}


def test_binned_information_of_far_values(spark):
    rng = np.random.default_rng(2)
    a, b = rng.random(60), rng.random(60)
    a[0], b[1], a[2] = 1e12, -1e12, INF
    df = spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in enumerate(zip(a, b))], "point_id long, m int, a double, b double")
    clipped = np.clip(np.floor(np.clip([a, b], -1, 2) * 5), 0, 4).astype(int)
    joint = np.bincount(clipped[0] * 5 + clipped[1], minlength=25).reshape(5, 5) / 60
    p, q = joint.sum(1, keepdims=True), joint.sum(0, keepdims=True)
    want = (joint[joint > 0] * np.log(joint[joint > 0] / (p * q)[joint > 0])).sum()
    assert dependence.mi_binned(df, 0.0, 1.0, 5).first().value == pytest.approx(want)


def test_bounds_leave_nan_out(spark):
    assert twins.bounds(_values(spark, [NAN, 3.0, -2.0, NAN])) == (-2.0, 3.0)
    assert twins.bounds(_values(spark, [NAN])) == (None, None)


def test_a_nan_corner_crosses_nothing(spark):
    corners = [(0, x, y, z, NAN if (x, y, z) == (1, 1, 1) else 0.0) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    corners += [(1, x, y, z, float(x)) for x in (0, 1, 2) for y in (0, 1) for z in (0, 1)]
    corners[-1] = (*corners[-1][:4], NAN)
    df = spark.createDataFrame(corners, "m int, x int, y int, z int, value double")
    assert [tuple(r) for r in grid.crossing_cells(df, 0.5).collect()] == [(1, 0, 0, 0)]


def test_transfer_entries_beyond_the_bounds(spark):
    v = np.array([-3.0, 0.0, 0.3, 1.7, 2.0, 9.0, NAN, INF, -INF])
    df = grid.transfer_weights(_values(spark, v), 0.0, 2.0, 4)
    rows = {str(r.value): (r.j, r.f) for r in df.collect()}
    assert rows["-3.0"] == rows["0.0"] == rows["-inf"] == (0, 0.0) and rows["9.0"] == rows["2.0"] == rows["inf"] == (2, 1.0)
    assert rows["nan"] == (None, None)
    # the plain form: both entries of a value clamped, NaN left out
    ok = ~np.isnan(v)
    at = np.clip(v[ok] / 2 * 3, 0, 3)
    a = np.zeros((ok.sum(), 4))
    for k, u in enumerate(at):
        low, high = int(np.floor(u)), int(np.ceil(u))
        a[k, low] += 1 - (u - low)
        a[k, high] += u - low
    target = F.when(F.col("value") == 0.3, NAN).otherwise(F.lit(1.5))
    keep = v[ok] != 0.3
    got_a, got_b = fitting.system(df, target, 4)
    assert got_a == pytest.approx(a[keep].T @ a[keep]) and got_b == pytest.approx(a[keep].T @ np.full(keep.sum(), 1.5))


@pytest.mark.parametrize("measure", ["pearson", "spearman"])
@pytest.mark.parametrize("length", [4, 16, 17, 20, 40])
def test_windows_over_several_chunks(spark, monkeypatch, length, measure):
    monkeypatch.setattr(dependence, "CHUNK", 16)
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=60), rng.normal(size=60)
    rows = [(s, t, float(v)) for s, x in (("a", a), ("b", b)) for t, v in enumerate(x)]
    got = dependence.windowed(spark.createDataFrame(rows, "sidx string, t long, value double"), "a", length, measure).collect()
    assert len(got) == 2 * (60 - length + 1) == len({(r.sidx, r.t) for r in got})
    rank = lambda x: np.argsort(np.argsort(x)) if measure == "spearman" else x
    for r in got:
        part = slice(r.t - length + 1, r.t + 1)
        assert r.value == pytest.approx(np.corrcoef(rank(a[part]), rank((a if r.sidx == "a" else b)[part]))[0, 1])


def test_velocities_by_name(spark):
    rows = [(0, 0, p, p, 0, 0, n, float(10 * k + p)) for k, n in enumerate(("U", "velocityY", "w", "other")) for p in range(3)]
    df = spark.createDataFrame(rows, "t int, e int, point_id long, x int, y int, z int, variable string, value double")
    got = {r.point_id: (r.u, r.v, r.w) for r in grid.named_velocity(df).collect()}
    assert got == {p: (p, 10.0 + p, 20.0 + p) for p in range(3)}
    assert grid.named_velocity(df, ("other", "U", "U")).filter("point_id = 1").first().u == 31.0
    with pytest.raises(ValueError, match="components v, w"):
        grid.named_velocity(df.filter("variable IN ('U', 'other')"))
