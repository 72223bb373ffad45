"""Density clusters by cells against a plain search."""

import random

import numpy as np
import pytest

from gridlark.operators import density


def brute(xy, eps, least):
    near = []
    for x, y in xy:
        d = np.array([(x - u, y - v) for u, v in xy])
        near.append(set(np.flatnonzero(np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]) <= eps)))
    cores, want = {k for k, n in enumerate(near) if len(n) >= least}, {}
    for k in sorted(cores):
        todo = [k] if k not in want else []
        while todo:
            c = todo.pop()
            if c not in want:
                want[c] = k
                todo += near[c] & cores
    return want | {k: min(want[c] for c in n & cores) for k, n in enumerate(near) if k not in cores and n & cores}


def _frame(spark, xy):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "id long, px double, py double")


def _shape(kind):
    rng = random.Random(7)
    if kind == "uniform":
        return [(rng.uniform(0, 6), rng.uniform(-3, 3)) for _ in range(400)]
    if kind == "lattice":  # distances that are eps to the last digit
        return [(k % 20 * 0.5, k // 20 * 0.5) for k in range(300)]
    if kind == "chain":
        return [(0.3 * k, 0.01 * (k % 3)) for k in range(200)]
    if kind == "hot cell":
        return [(1 + rng.random() * 1e-3, 1 + rng.random() * 1e-3) for _ in range(300)] + [(1.4 + 0.01 * k, 1.0) for k in range(30)] + [(9.0, 9.0)] * 3
    return [(rng.gauss(c, 0.4), rng.gauss(0, 0.4)) for c in (0, 3, 9) for _ in range(120)] + [(0.0, 0.0)] * 50


@pytest.mark.parametrize(
    "kind, compared", [("uniform", 1 << 20), ("lattice", 1 << 20), ("chain", 1 << 20), ("hot cell", 1 << 20), ("hot cell", 4), ("blobs", 4)]
)
def test_labels(spark, monkeypatch, kind, compared):
    monkeypatch.setattr(density, "COMPARED", compared)  # 4: boxes are halved again and again
    xy = _shape(kind)
    for eps, least in ((0.5, 6), (0.25, 2)) if kind == "uniform" else ((0.5, 6),):
        got = {r.id: r.cluster for r in density.dbscan(_frame(spark, xy), eps, least).collect()}
        assert got == brute(xy, eps, least), (eps, least)


def test_a_dense_square_makes_rows_in_proportion(spark, monkeypatch):
    made = []
    real = density._met

    def noting(*more):
        out = real(*more)
        made.append(out.count())
        return out

    monkeypatch.setattr(density, "_met", noting)
    rng = np.random.default_rng(1)
    rows = {}
    for n in (2000, 4000):
        made.clear()
        got = density.dbscan(_frame(spark, rng.random((n, 2))), 0.1, 8).collect()
        rows[n] = sum(made)
        assert len(got) == n and {r.cluster for r in got} == {0}
    # every cell but those cut by the border is full: pairs within eps would be some 400,000
    assert rows[4000] <= 4 * 4000


def test_nothing_and_nan(spark):
    assert density.dbscan(_frame(spark, []), 0.5, 3).collect() == []
    xy = [(0, 0), (0, 0.1), (float("nan"), 0)]
    assert {r.id: r.cluster for r in density.dbscan(_frame(spark, xy), 0.5, 2).collect()} == {0: 0, 1: 0}
