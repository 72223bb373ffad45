"""The Bayesian search of region pairs: its process against plain algebra, and its errors against sampling's."""

import numpy as np
import pytest

from gridlark.operators import regions, search

FACTOR = 4


@pytest.fixture(scope="module")
def field(spark):
    """A smooth field of 12 x 8 x 4 points with 24 members, and one missing member at a point."""
    rng = np.random.default_rng(8)
    waves = rng.normal(size=(6, 3)) * 0.35
    phase, weight = rng.uniform(0, 6, 6), rng.normal(size=(6, 24))
    rows = []
    for x in range(12):
        for y in range(8):
            for z in range(4):
                v = np.cos(waves @ [x, y, z] + phase) @ weight
                rows += [(x, y, z, m, float("nan") if (x, y, z, m) == (3, 3, 3, 5) else float(u)) for m, u in enumerate(v)]
    return spark.createDataFrame(rows, "x long, y long, z long, m int, value double").cache()


def _values(df):
    return {(tuple(r.i), tuple(r.j)): r.value for r in df.collect()}


def test_it_errs_less_than_sampling(field):
    sizes = (12, 8, 4)
    every = regions.cell_pairs(field, FACTOR).cache()
    plain = regions.sampling_errors(every, regions.sampled_pairs(field, FACTOR, sizes, 40)).first()
    found = search.bayesian_pairs(field, FACTOR, sizes, 40)
    told = regions.sampling_errors(every, found).first()
    assert told.absolute < 0.7 * plain.absolute and told.quantile < plain.quantile
    most, got = _values(regions.exhaustive_pairs(field, FACTOR)), _values(found)
    assert got.keys() == most.keys() and all(abs(got[k]) <= abs(most[k]) + 1e-9 for k in got)


def test_second_fields_diagonals_and_lists(field, spark):
    sizes, other = (12, 8, 4), field.selectExpr("x", "y", "z", "m", "-value AS value")
    blocks = 3 * 2 * 1
    own = _values(search.bayesian_pairs(field, FACTOR, sizes, 25, diagonal=True))
    assert len(own) == blocks * (blocks + 1) // 2 and all(abs(own[i, j]) > 0.85 for i, j in own if i == j)
    # near points of a field and of its negative are strongly dependent
    both = _values(search.bayesian_pairs(field, FACTOR, sizes, 25, second=other))
    assert len(both) == len(own) and all(abs(both[i, j]) > 0.85 for i, j in both if i == j)
    listed = spark.createDataFrame([((0, 1, 2), (0, 0, 0))], f"i {search._ID}, j {search._ID}")
    assert set(_values(search.bayesian_pairs(field, FACTOR, sizes, 5, listed=listed, measure="kendall"))) == {((0, 1, 2), (0, 0, 0))}


def test_it_finds_a_peak_and_survives_nothing():
    at = np.array([0.7, 0.2])
    place, value = search.searched(lambda u: float(np.exp(-8 * ((u - at) ** 2).sum())), 2, 40)
    assert value > 0.97 and np.abs(place - at).max() < 0.1
    assert np.isnan(search.searched(lambda u: float("nan"), 2, 6)[1])
    assert [search.initial(n) for n in (1, 2, 9, 40, 400)] == [1, 1, 5, 20, 20]


def test_covariances_are_those_of_matern():
    a = np.random.default_rng(1).random((9, 3))
    k = search.matern(a, a)
    r = np.sqrt(5) * np.linalg.norm(a[0] - a[1]) / search.LENGTH
    assert k[0, 1] == pytest.approx((1 + r + r * r / 3) * np.exp(-r)) and np.allclose(np.diag(k), 1) and np.linalg.eigvalsh(k).min() > 0


def test_benchmark_as_csv(field, spark, tmp_path):
    methods = {"Plastic": regions.sampled_pairs, "Bayesian": search.bayesian_pairs}
    regions.sampling_benchmark(field, FACTOR, (12, 8, 4), [4, 12], methods).coalesce(1).write.csv(f"{tmp_path}/b", header=True)
    rows = spark.read.csv(f"{tmp_path}/b", header=True, inferSchema=True)
    assert tuple(rows.columns) == regions.BENCHMARK
    told = {(r["Sampling Method"], r["Samples"]): r for r in rows.collect()}
    assert set(told) == {(m, n) for m in methods for n in (4, 12)} and all(r["Time"] > 0 and 0 <= r["Absolute"] <= 2 for r in told.values())
    assert [told["Bayesian", n]["Init Samples"] for n in (4, 12)] == [2, 6] and told["Plastic", 4]["Init Samples"] == 0
    assert told["Plastic", 12]["Absolute"] <= told["Plastic", 4]["Absolute"]


def test_searches_side_by_side_share_their_tables(monkeypatch):
    """Each finds what it finds alone, also where values are missing, with fewer covariances than one by one."""
    count, samples = 48, 40
    table = np.random.default_rng(5).normal(size=(count, *[3] * 6))
    table[7, 0, 1], table[9] = np.nan, np.nan
    value = lambda k, u: table[(k, *(u * 3).astype(int).T)]
    alone = [search.searched(lambda u, k=k: float(value(np.array([k]), u[None])[0]), 6, samples) for k in range(count)]
    plain, made = search._matern, []

    def counted(a, b):
        out = plain(a, b)
        made.append(out.size)
        return out

    monkeypatch.setattr(search, "_matern", counted)
    for held in (search.HELD, 10 * samples**2):
        monkeypatch.setattr(search, "HELD", held)
        at, best = search.searched_many(value, 6, samples, count)
        assert np.isnan(best[9]) and np.isnan(alone[9][1])
        assert np.allclose(best, [v for _, v in alone], equal_nan=True) and np.allclose(np.delete(at, 9, 0), [x for k, (x, _) in enumerate(alone) if k != 9])
        if held > 10 * samples**2:
            assert sum(made) < 0.6 * count * search.CANDIDATES * sum(range(search.initial(samples), samples))
