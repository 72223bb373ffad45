"""Fitted transfer functions against numpy, and clusters against a plain search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.operators import density, fitting, grid


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    v = rng.random(300)
    return grid.transfer_weights(spark.createDataFrame([(float(x),) for x in v], "value double"), 0.0, 1.0, 6).cache(), v


def design(v, n=6):
    at = v * (n - 1)
    j = np.minimum(np.floor(at), n - 2).astype(int)
    a = np.zeros((len(v), n))
    a[np.arange(len(v)), j], a[np.arange(len(v)), j + 1] = 1 - (at - j), at - j
    return a


def test_solved(rows):
    df, v = rows
    a, b = design(v), np.sin(v)
    want = np.clip(np.linalg.solve(a.T @ a + 1e-3 * np.eye(6), a.T @ b), 0, 1)
    got = fitting.solved(df, F.sin("value"), 6).orderBy("j").collect()
    assert [r.value for r in got] == pytest.approx(want.tolist())


@pytest.mark.parametrize("loss,adam,rate,smooth", [("l2", True, 0.4, 0.0), ("l2", False, 1.0, 0.5), ("l1", True, 0.1, 0.0)])
def test_descended(rows, loss, adam, rate, smooth):
    df, v = rows
    a, b, x = design(v), np.sin(v), np.full(6, 0.5)
    m, s = np.zeros(6), np.zeros(6)
    for t in range(1, 6):
        d = a @ x - b
        g = a.T @ (2 * d if loss == "l2" else np.where(d >= 0, 1.0, -1.0)) / len(v) + smooth * fitting.prior(x)
        if adam:
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            g = (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        x = np.clip(x - rate * g, 0, 1)
    got = fitting.descended(df, F.sin("value"), 6, loss, adam, 5, rate, smooth=smooth).orderBy("j").collect()
    assert [r.value for r in got] == pytest.approx(x.tolist(), abs=1e-7)


def test_dbscan(spark):
    rng = random.Random(3)
    xy = [(rng.gauss(c, 0.3), rng.gauss(0, 0.3)) for c in (0, 4, 9) for _ in range(60)] + [(rng.uniform(-5, 15), rng.uniform(3, 9)) for _ in range(20)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(xy)], "id long, px double, py double")
    got = {r.id: r.cluster for r in density.dbscan(df, 0.3, 6).collect()}
    near = [{j for j, q in enumerate(xy) if np.hypot(p[0] - q[0], p[1] - q[1]) <= 0.3} for p in xy]
    cores, want = {k for k, n in enumerate(near) if len(n) >= 6}, {}
    for k in sorted(cores):
        if k not in want:
            todo = [k]
            while todo:
                c = todo.pop()
                if c not in want:
                    want[c] = k
                    todo += near[c] & cores
    for k, n in enumerate(near):
        if k not in cores and n & cores:
            want[k] = min(want[c] for c in n & cores)
    assert got == want and len(set(got.values())) >= 3


@pytest.mark.parametrize("seed", range(6))
def test_boxed_meets_the_conditions_of_optimality(seed):
    rng = np.random.default_rng(seed)
    n = [1, 3, 8, 20, 40, 0][seed]
    m = rng.normal(size=(n + 5, n))
    a, b = m.T @ m + 1e-3 * np.eye(n), m.T @ rng.normal(size=n + 5) * 3
    x = fitting.boxed(a, b, 0.0, 1.0)
    slope = a @ x - b
    assert ((x >= 0) & (x <= 1)).all()
    assert (np.abs(slope[(x > 0) & (x < 1)]) < 1e-8).all() and (slope[x == 0] > -1e-8).all() and (slope[x == 1] < 1e-8).all()
    # a clipped solution is another point, and no better one
    cost = lambda u: u @ a @ u / 2 - b @ u
    assert not n or cost(x) <= cost(np.clip(np.linalg.solve(a, b), 0, 1)) + 1e-9


def test_box_and_krylov_of_rows(rows):
    df, v = rows
    a, target = design(v), 2.5 * v - 0.6  # leaves the box on both sides
    gram, right = a.T @ a + 1e-3 * np.eye(6), a.T @ target
    got = [r.value for r in fitting.solved(df, 2.5 * F.col("value") - 0.6, 6).orderBy("j").collect()]
    assert got == pytest.approx(fitting.boxed(gram, right, 0, 1).tolist(), abs=1e-9) and min(got) == 0.0 and max(got) == 1.0
    free = [r.value for r in fitting.solved(df, 2.5 * F.col("value") - 0.6, 6, box=None, solver="cgls").orderBy("j").collect()]
    assert free == pytest.approx(np.linalg.solve(gram, right).tolist(), abs=1e-8)
