"""Measures on vectors that the tables don't have: NaN, constants, ties, single members; kernels against slow forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.functions import kernels
from gridlark.functions.measures import largest_k, max_mi_ksg, value_range
from gridlark.operators import dependence, ensemble, grid, learned, regions, similarity

NAN = float("nan")


def pairs(spark, vectors):
    rows = [(p, m, float(a), float(b)) for p, (x, y) in vectors.items() for m, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "point_id long, m int, a double, b double")


def values(df):
    return {r.point_id: r.value for r in df.collect()}


def bad(v):
    return v is None or math.isnan(v)


@pytest.mark.parametrize("measure", list(dependence.MEASURES))
def test_nan_constant_and_single_members(spark, measure):
    rng = random.Random(3)
    x, y = [rng.gauss(0, 1) for _ in range(20)], [rng.gauss(0, 1) for _ in range(20)]
    got = values(dependence.measured(pairs(spark, {1: (x, y), 2: ([NAN] + x[1:], y), 3: (x, [NAN] + y[1:]), 4: ([0.5], [0.7]), 5: ([2.0] * 20, y)}), measure))
    assert not bad(got[1]) and bad(got[2]) and bad(got[3]) and got[4] == 1.0
    if not measure.startswith("mi_"):
        assert bad(got[5])


def test_kernels_agree_with_plans(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 6, 40).astype(float), rng.integers(0, 6, 40).astype(float)
    df = pairs(spark, {1: (x, y)})
    for measure in dependence.MEASURES:
        assert values(dependence.measured(df, measure))[1] == pytest.approx(kernels.KERNELS[measure](x, y), abs=1e-9), measure


def test_kendall_with_ties():
    rng = np.random.default_rng(5)
    for n in (2, 3, 17, 64, 100):
        x, y = rng.integers(0, 5, n), rng.integers(0, 5, n)
        sx, sy = (np.sign(v[:, None] - v)[np.triu_indices(n, 1)] for v in (x, y))
        down = int(((sx * sy) < 0).sum())
        n0, n1, n2, n3 = n * (n - 1) // 2, int((sx == 0).sum()), int((sy == 0).sum()), int(((sx == 0) & (sy == 0)).sum())
        size = math.sqrt((n0 - n1) * (n0 - n2))
        if size:
            assert kernels.kendall(x, y) == pytest.approx((sx * sy).sum() / size)
            assert kernels.kendall(x, y, "plain_ties") == pytest.approx((n0 - n1 - n2 - 2 * down) / size)
        assert kernels.kendall(x, y, "tau_a") == pytest.approx((n0 - 2 * down) / n0)


def test_ksg_in_blocks_and_with_noise():
    rng = np.random.default_rng(6)
    x = rng.standard_normal(300)
    y = x + 0.5 * rng.standard_normal(300)
    for e in (1, 2):
        assert kernels.mi_ksg(x, y, 3, e, block=7) == pytest.approx(kernels.mi_ksg(x, y, 3, e, block=1000))
        assert 0.4 < kernels.mi_ksg(x, y, 3, e) < 1.3
    assert kernels.mi_ksg(x, x, 3) <= max_mi_ksg(3, 300) + 0.5
    assert kernels.mi_ksg(x, y, 3, noise=1e-10) == pytest.approx(kernels.mi_ksg(x, y, 3), abs=1e-3)
    assert largest_k(100) == 20 and largest_k(1000) == 70
    assert value_range("pearson") == (-1, 1) and value_range("pearson", True) == (0, 1) and value_range("mi_ksg") == (0, None)


def test_kl_of_constant_tied_and_nan_members(spark):
    rng = random.Random(7)
    fine = [rng.gauss(0, 1) for _ in range(16)]
    vectors = {1: fine, 2: [3.0] * 16, 3: [1.0, 2.0, 3.0, 4.0] * 4, 4: [NAN] + fine[1:], 5: [1.0]}
    df = spark.createDataFrame([(p, m, v) for p, x in vectors.items() for m, v in enumerate(x)], "point_id long, m int, value double")
    knn = {r.point_id: r.kl for r in ensemble.kl_knn(df, 3).collect()}
    binned = {r.point_id: r.kl for r in ensemble.kl_binned(df).collect()}
    assert not bad(knn[1]) and bad(knn[2]) and bad(knn[3]) and bad(knn[4]) and knn[5] == 1.0
    assert not bad(binned[1]) and bad(binned[2]) and not bad(binned[3]) and bad(binned[4]) and binned[5] == 1.0


def test_constant_fields(spark):
    df = spark.createDataFrame([(p, 0, 2.0) for p in range(5)], "point_id long, m int, value double")
    assert [r.n for r in ensemble.histogram(df, 2.0, 2.0, 4).orderBy("bin").collect()] == [5, 0, 0, 0]
    assert {(r.j, r.f) for r in grid.transfer_weights(df, 2.0, 2.0, 4).collect()} == {(0, 0.0)}


def test_extremes_with_nan(spark):
    df = spark.createDataFrame([(1.0, NAN), (NAN, 1.0), (1.0, 2.0)], "a double, b double")
    made = grid.binary(F.col("a"), F.col("b"))
    got = df.select(made["maximum"].alias("hi"), made["minimum"].alias("lo")).collect()
    assert got[0].hi == 1.0 and got[0].lo == 1.0 and math.isnan(got[1].hi) and math.isnan(got[1].lo) and tuple(got[2]) == (2.0, 1.0)


def test_constant_window_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(dependence, "CHUNK", 10)
    rng = random.Random(8)
    rows = [(s, t, 1.0 if s == "b" and t < 8 else rng.random()) for s in "ab" for t in range(60) if (s, t) != ("b", 33)]
    got = {(r.sidx, r.t): r.value for r in dependence.windowed(spark.createDataFrame(rows, "sidx string, t long, value double"), "a", 5).collect()}
    v = {(s, t): x for s, t, x in rows}
    want = {(s, t) for s in "ab" for t in range(4, 60) if all((s, t - k) in v for k in range(5))}
    assert set(got) == want
    for (s, t), x in got.items():
        a, b = ([v[c, t - k] for k in range(5)] for c in ("a", s))
        assert x is None if len(set(b)) == 1 else x == pytest.approx(float(np.corrcoef(a, b)[0, 1]))


def test_blocks_far_out_keep_their_names(spark):
    rng = random.Random(9)
    rows = [(bx, by, 0, m, rng.random()) for bx, by in ((1000, 0), (0, 1), (0, 0)) for m in range(8)]
    df = spark.createDataFrame(rows, "bx long, by long, bz long, m int, value double")
    assert regions.mean_pairs(df).count() == 3


def test_pairs_leave_out_blocks_with_gaps(spark):
    rng = random.Random(10)
    rows = [(bx, 0, 0, m, NAN if (bx, m) == (1, 3) else rng.random()) for bx in range(4) for m in range(8)]
    df = spark.createDataFrame(rows, "bx long, by long, bz long, m int, value double")
    for measure in ("pearson", "kendall"):
        assert {(r.i.bx, r.j.bx) for r in regions.mean_pairs(df, measure=measure).collect()} == {(2, 0), (3, 0), (3, 2)}


def test_derivatives_keep_members_apart(spark):
    rows = [(m, x, 0, 0, float(x * (m + 1)), 0.0, float(x * x)) for m in range(2) for x in range(4)]
    df = spark.createDataFrame(rows, "m int, x int, y int, z int, u double, v double, w double")
    got = {(r.m, r.x): r.cv for r in grid.vorticity(df, keys=["m"]).collect()}
    assert {k: got[0, k] for k in range(4)} == {0: -1.0, 1: -2.0, 2: -4.0, 3: -5.0} and all(got[0, x] == got[1, x] for x in range(4))


def test_global_ranks(spark):
    rng = random.Random(11)
    v = [rng.randint(0, 50) / 7 for _ in range(400)]
    got = similarity.global_ranks(spark.createDataFrame([(x,) for x in v], "a double"), "a", "r").collect()
    s = sorted(v)
    assert len(got) == 400 and all(r.r == s.index(r.a) + (s.count(r.a) + 1) / 2 for r in got)


def test_similarity_drops_pairs_with_nan(spark):
    rng = np.random.default_rng(12)
    x, y = rng.standard_normal(50), rng.standard_normal(50)
    df = spark.createDataFrame([(float(a), NAN if k == 7 else float(b)) for k, (a, b) in enumerate(zip(x, y))], "a double, b double")
    keep = np.arange(50) != 7
    for measure in ("pearson", "spearman", "kendall", "mi_ksg", "mi_binned"):
        got = similarity.field_similarity(df, "a", "b", measure).first().value
        assert got == pytest.approx(kernels.KERNELS[measure](x[keep], y[keep]), abs=1e-9), measure


def test_permuted_members(spark):
    df = spark.createDataFrame([(p, m, float(10 * p + m)) for p in range(3) for m in range(20)], "point_id long, m int, value double")
    got = learned.permuted(df).collect()
    assert len(got) == 60
    for p in range(3):
        assert sorted(r.shuffled for r in got if r.point_id == p) == [float(10 * p + m) for m in range(20)]
    assert any(r.shuffled != r.value for r in got) and sorted(map(tuple, learned.permuted(df).collect())) == sorted(map(tuple, got))


def test_network(spark):
    rng = np.random.default_rng(13)
    x = rng.standard_normal((30, 4))
    layers = [(rng.standard_normal((24, 8)), rng.standard_normal(8)), (rng.standard_normal((8, 1)), rng.standard_normal(1))]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, f array<double>")
    got = {r.id: r.y for r in df.select("id", learned.network(F.col("f"), layers, "snake", 3).alias("y")).collect()}
    h = learned.frequencies(x, 3) @ layers[0][0] + layers[0][1]
    want = (h + np.sin(h) ** 2) @ layers[1][0] + layers[1][1]
    assert [got[k] for k in range(30)] == pytest.approx(want[:, 0].tolist())


@pytest.mark.parametrize("measure", ["pearson", "spearman", "kendall", "mi_binned", "mi_ksg", "mi_binned_coefficient", "mi_ksg_coefficient"])
def test_many_vectors_at_once_have_the_values_of_each(monkeypatch, measure):
    monkeypatch.setattr(kernels, "ELEMENTS", 9000)  # several portions
    rng = np.random.default_rng(6)
    xs = [rng.normal(size=n) for n in [30] * 12 + [7] * 5 + [300] * 2] + [np.round(rng.normal(size=30)) for _ in range(6)] + [np.ones(30)]
    ys = [x * rng.normal() + rng.normal(size=len(x)) for x in xs[:19]] + [np.round(rng.normal(size=30)) for _ in range(6)] + [rng.normal(size=30)]
    choices = {"kendall": [{"variant": v} for v in ("tau_b", "plain_ties", "tau_a")], "mi_binned": [{}, {"bins": 5, "low": -1.0, "high": 1.5}]}
    choices["mi_ksg"] = [{"k": 3}, {"k": 2, "estimator": 2, "noise": 1e-3}, {}]
    for options in choices.get(measure, [{}]):
        got = kernels.all_values(measure, xs, ys, **options)
        want = [kernels.KERNELS[measure](x, y, **options) for x, y in zip(xs, ys)]
        # a root magnifies what is left of zero
        assert got == pytest.approx(want, abs=1e-7 if measure.endswith("coefficient") else 1e-12, nan_ok=True)
    odd = kernels.all_values(measure, [None, [], [1.0], [1.0, 2.0], [NAN, 1.0]], [[1.0], [], [2.0], [1.0], [1.0, 2.0]])
    assert [str(v) for v in odd] == ["nan", "nan", "1.0", "nan", "nan"]
