"""Pairs of unit vectors by bounds against all pairs in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.operators import unit_pairs


def _vectors(kind, n=230, d=12):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, d))
    if kind == "clustered":
        x = rng.normal(size=(9, d))[rng.integers(0, 9, n)] * rng.choice([1, -1], n)[:, None] + 0.15 * x
    if kind == "tight":
        x = rng.normal(size=(9, d))[rng.integers(0, 9, n)] + 0.02 * x
    if kind == "copies":
        x[: n // 2] = x[0]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _frame(spark, x, first=0):
    rows = [(((k + first) // 20, k % 20 // 5, k % 5), [float(v) for v in u]) for k, u in enumerate(x)]
    return spark.createDataFrame(rows, f"id {unit_pairs._ID}, v array<double>").repartition(3), [r[0] for r in rows]


def _told(df):
    rows = [((tuple(r.i), tuple(r.j)), r.value) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


ASKED = ({}, {"low": 0.4}, {"low": -0.2, "high": 0.1}, {"high": -0.5}, {"least": 0.5}, {"low": 0.3, "high": 0.6, "absolute": True}, {"diagonal": True, "low": 0.9})


@pytest.mark.parametrize("kind", ["plain", "clustered", "copies"])
def test_the_values_of_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(unit_pairs, "GROUP", 16)
    x = _vectors(kind)
    df, ids = _frame(spark, x)
    every = x @ x.T
    for asked in ASKED if kind == "clustered" else ASKED[4:6]:
        got = _told(unit_pairs.unit_pairs(df, **asked))
        v = np.abs(every) if asked.get("absolute") else every
        ok = (v >= asked.get("low", -9)) & (v <= asked.get("high", 9)) & (np.abs(v) >= asked.get("least", 0))
        want = {(ids[i], ids[j]): v[i, j] for i in range(len(x)) for j in range(i + bool(asked.get("diagonal"))) if ok[i, j]}
        assert got.keys() == want.keys(), asked
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_two_tables_and_vectors_of_other_lengths(spark, monkeypatch):
    monkeypatch.setattr(unit_pairs, "GROUP", 16)
    x, y = _vectors("clustered", 60), _vectors("plain", 45)
    a, ia = _frame(spark, x)
    b, ib = _frame(spark, y, 100)
    a = a.unionByName(spark.createDataFrame([((99, 0, 0), [0.6, 0.8])], a.schema))
    got = _told(unit_pairs.unit_pairs(a, b, low=0.3))
    want = {(ia[i], ib[j]): (x @ y.T)[i, j] for i in range(60) for j in range(45) if (x @ y.T)[i, j] >= 0.3}
    assert got.keys() == want.keys()


@pytest.mark.parametrize("kind", ["clustered", "copies"])
def test_strongest(spark, monkeypatch, kind):
    monkeypatch.setattr(unit_pairs, "GROUP", 16)
    x = _vectors(kind)
    df, ids = _frame(spark, x)
    every = {(ids[i], ids[j]): (x @ x.T)[i, j] for i in range(len(x)) for j in range(i)}
    for k in (25,):
        got = [(tuple(r.i), tuple(r.j), r.value) for r in unit_pairs.strongest(df, k).collect()]
        best = sorted((abs(v) for v in every.values()), reverse=True)[:k]
        assert [abs(v) for _, _, v in got] == pytest.approx(best) and all(abs(every[i, j] - v) < 1e-12 for i, j, v in got)


def test_bounds_drop_pairs_of_groups(spark, monkeypatch):
    monkeypatch.setattr(unit_pairs, "GROUP", 16)
    rows = []
    real = unit_pairs._met

    def noting(pairs, *more):
        rows.append(pairs.count())
        return real(pairs, *more)

    monkeypatch.setattr(unit_pairs, "_met", noting)
    df, _ = _frame(spark, _vectors("tight", 400))
    unit_pairs.unit_pairs(df).count()
    unit_pairs.unit_pairs(df, low=0.8).count()
    assert rows[1] < rows[0] / 3


def test_hot_groups_are_cut(spark, monkeypatch):
    monkeypatch.setattr(unit_pairs, "GROUP", 16)
    df, _ = _frame(spark, _vectors("copies", 300))
    sizes = [r.n for r in unit_pairs.grouped(df).select(F.size("ids").alias("n")).collect()]
    assert sum(sizes) == 300 and max(sizes) <= 4 * 16


def test_nothing(spark):
    df, _ = _frame(spark, np.empty((0, 3)))
    assert unit_pairs.unit_pairs(df, low=0.1).collect() == [] and unit_pairs.strongest(df, 3).collect() == []
