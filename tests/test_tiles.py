"""Pairs by tiles: what they give is what plain loops over all pairs give, however rows are dealt."""

import numpy as np
import pytest

from gridlark.functions import kernels
from gridlark.operators import regions, search, tiles

FACTOR, SIZES = 4, (9, 8, 6)


@pytest.fixture(scope="module")
def field(spark):
    """9 x 8 x 6 points with 12 members; a missing member, a missing point and a constant one."""
    rng = np.random.default_rng(3)
    rows = []
    for x in range(9):
        for y in range(8):
            for z in range(6):
                v = rng.normal(size=12) if (x, y, z) != (2, 2, 2) else np.ones(12)
                rows += [(x, y, z, m, float("nan") if (x, y, z, m) == (3, 3, 3, 5) else float(u)) for m, u in enumerate(v) if (x, y, z) != (5, 1, 1)]
    return spark.createDataFrame(rows, "x long, y long, z long, m int, value double").cache()


def _truth(field):
    """Values of all pairs of points of each pair of blocks."""
    points = {}
    for r in field.collect():
        points.setdefault((r.x, r.y, r.z), {})[r.m] = r.value
    blocks = {}
    for (x, y, z), v in points.items():
        v = np.array([v[m] for m in sorted(v)])
        if not np.isnan(v).any() and v.std() > 0:
            blocks.setdefault((z // FACTOR, y // FACTOR, x // FACTOR), []).append(v)
    return {(i, j): np.array([kernels.pearson(a, b) for a in blocks[i] for b in blocks[j]]) for i in blocks for j in blocks if i > j}

def test_searches_side_by_side_are_those_of_one(field):
    """Many searches in step give what each gives alone, and those that miss a point are redone alone."""
    rng = np.random.default_rng(5)
    at = rng.random((7, 6))
    value = lambda k, u: np.cos(3 * (u - at[k])).prod(-1)
    places, best = search.searched_many(lambda rows, u: value(rows, u), 6, 30, 7)
    for k in range(7):
        place, one = search.searched(lambda u: float(value(k, u)), 6, 30)
        assert best[k] == pytest.approx(one, abs=1e-9) and np.allclose(places[k], place)
    # nothing is a number for the second one
    best = search.searched_many(lambda rows, u: np.where(rows == 1, np.nan, value(rows, u)), 6, 12, 3)[1]
    assert np.isnan(best[1]) and not np.isnan(best[[0, 2]]).any()
    got = search.bayesian_pairs(field, FACTOR, SIZES, 12).collect()
    truth = _truth(field)
    assert {(tuple(r.i), tuple(r.j)) for r in got} == truth.keys()
    assert all(np.isclose(truth[tuple(r.i), tuple(r.j)], r.value, atol=1e-9).any() for r in got)

def test_all_points_in_small_groups(field, spark, monkeypatch):
    """Blocks of 64 points are cut over groups of 50, and the parts put together."""
    monkeypatch.setattr(tiles, "POINTS", 50)
    monkeypatch.setattr(tiles, "VALUES", 100)
    truth = _truth(field)
    got = {(tuple(r.i), tuple(r.j)): r for r in regions.exhaustive_pairs(field, FACTOR).collect()}
    assert got.keys() == truth.keys()
    for k, v in truth.items():
        assert got[k].n == len(v) and got[k].value == pytest.approx(v[np.abs(v).argmax()], abs=1e-12)
    # half of the pairs are found, at one of their values
    found = {k: float(np.sort(np.abs(v))[len(v) // 3]) for k, v in list(truth.items())[::2]}
    told = regions.exhaustive_errors(field, FACTOR, spark.createDataFrame([(*k, v) for k, v in found.items()], f"{tiles.PAIR}, value double")).first()
    sizes = {k: np.abs(truth[k]) for k in found}
    assert told.quantile == pytest.approx(np.mean([1 - (sizes[k] < f - 1e-12).mean() for k, f in found.items()]), abs=1e-12)
    assert told.linear == pytest.approx(np.mean([1 - (f - sizes[k].min()) / np.ptp(sizes[k]) for k, f in found.items()]), abs=1e-9)
    assert told.absolute == pytest.approx(np.mean([sizes[k].max() - f for k, f in found.items()]), abs=1e-9)

@pytest.mark.parametrize("measure, options", [
    ("spearman", {}), ("kendall", {}), ("kendall", {"variant": "tau_a"}), ("kendall", {"variant": "plain_ties"}), ("mi_binned", {"bins": 10}),
    ("mi_binned", {"bins": 7, "low": -1.0, "high": 1.0}), ("mi_ksg", {}), ("mi_ksg", {"k": 5}), ("mi_ksg", {"estimator": 2}), ("mi_ksg_coefficient", {}),
])
def test_tables_hold_the_values_of_single_pairs(measure, options):
    rng = np.random.default_rng(4)
    for draw in (rng.normal, lambda size: rng.integers(0, 6, size).astype(float)):
        a, b = draw(size=(5, 64)), draw(size=(70, 64))
        b[3] = 2.0
        want = np.stack([kernels.all_values(measure, [x] * len(b), list(b), **options) for x in a])
        assert np.allclose(kernels.table(measure, a, b, **options), want, rtol=0, atol=1e-12, equal_nan=True)


def test_means_in_small_groups(field, monkeypatch):
    """Groups of a few blocks: every pair is met once, and those with a missing member are left out."""
    monkeypatch.setattr(tiles, "BLOCKS", 2)
    blocks = field.filter("x % 4 = 0 AND y % 2 = 0 AND z % 3 = 0").selectExpr("x AS bx", "y AS by", "z AS bz", "m", "value")
    vectors = {}
    for r in sorted(blocks.collect(), key=lambda r: r.m):
        vectors.setdefault((r.bz, r.by, r.bx), []).append(r.value)
    for diagonal in (False, True):
        got = {(tuple(r.i), tuple(r.j)): r.value for r in regions.mean_pairs(blocks, measure="kendall", diagonal=diagonal).collect()}
        assert got.keys() == {(i, j) for i in vectors for j in vectors if i > j or diagonal and i == j}
        assert all(v == pytest.approx(kernels.kendall(np.array(vectors[i]), np.array(vectors[j])), abs=1e-12) for (i, j), v in got.items())

def test_samples_are_asked_once_for_each_block(field, monkeypatch):
    """Vectors are joined to the samples of a block, not to those of each pair of blocks; values are those of the listed pairs."""
    samples, blocks = 15, 3 * 2 * 2
    side = regions._samples(field, FACTOR, SIZES, samples, "halton", "pearson", 1)
    assert 0 < side.count() <= blocks * samples
    ids = side.select("id").distinct()
    listed = ids.selectExpr("id AS i").join(ids.selectExpr("id AS j")).filter("i > j")
    told = lambda df: {(tuple(r.i), tuple(r.j)): round(r.value, 9) for r in df.collect()}
    for measure in ("pearson", "spearman"):
        plain = told(regions.sampled_pairs(field, FACTOR, SIZES, samples, "halton", measure, listed=listed))
        assert told(regions.sampled_pairs(field, FACTOR, SIZES, samples, "halton", measure)) == plain and len(plain) == blocks * (blocks - 1) // 2
