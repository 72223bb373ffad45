"""The tree over blocks against a walk down it, bundles, and regions inside a block."""

import random

import pytest
from pyspark.sql import functions as F

from gridlark.operators import hierarchy


def walked(at, counts):
    """The code of a leaf, found by halving boxes."""
    low, n, code = [0, 0, 0], list(counts), 0
    for _ in range(hierarchy.height(counts)):
        for k in range(3):
            first = (n[k] + 1) // 2
            second = at[k] - low[k] >= first
            code += second << k
            low[k], n[k] = (low[k] + first, n[k] - first) if second else (low[k], first)
        code <<= 3
    return code >> 3


@pytest.mark.parametrize("counts", [(1, 1, 1), (4, 4, 2), (5, 3, 1), (7, 1, 9)])
def test_codes(spark, counts):
    every = [(x, y, z) for x in range(counts[0]) for y in range(counts[1]) for z in range(counts[2])]
    got = hierarchy.coded(spark.createDataFrame(every, "bx int, by int, bz int"), counts).collect()
    assert {(r.bx, r.by, r.bz): r.code for r in got} == {at: walked(at, counts) for at in every}
    assert len({r.code for r in got}) == len(every)


def test_paths(spark):
    counts = (4, 4, 4)
    rows = [((0, 0, 0), (1, 0, 0)), ((0, 0, 0), (3, 3, 3)), ((2, 0, 0), (0, 0, 0))]
    ends = "struct<bz:int,by:int,bx:int>"
    df = spark.createDataFrame([(i[::-1], j[::-1]) for i, j in rows], f"i {ends}, j {ends}")
    got = {((r.i.bx, r.i.by, r.i.bz), (r.j.bx, r.j.by, r.j.bz)): [tuple(p) for p in r.path] for r in hierarchy.bundled(df, counts).collect()}
    # siblings keep their parent; others climb to below the common ancestor
    assert got[rows[0]] == [(2, 0), (1, 0), (2, 1)]
    assert got[rows[1]] == [(2, 0), (1, 0), (1, 7), (2, 63)]
    assert got[rows[2]] == [(2, 8), (1, 1), (1, 0), (2, 0)]


def test_straightened(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (1.0, 4.0), (4.0, 0.0)],), ([(1.0, 2.0)],)], "p array<struct<x:double,y:double>>")
    got = [[tuple(p) for p in r.p] for r in df.select(hierarchy.straightened(F.col("p")).alias("p")).collect()]
    assert got == [[(0.0, 0.0), (1.25, 3.0), (4.0, 0.0)], [(1.0, 2.0)]]


def test_drilled(spark):
    rows = [(z * 35 + y * 7 + x, x, y, z, 0, 1.0) for x in range(7) for y in range(5) for z in range(2)]
    df = spark.createDataFrame(rows, "point_id long, x int, y int, z int, m int, value double")
    got, sizes = hierarchy.drilled(df, (1, 0, 0), 4, (7, 5, 2))
    assert sizes == (3, 4, 2) and {(r.x, r.y, r.z) for r in got.collect()} == {(x, y, z) for x in range(3) for y in range(4) for z in range(2)}
    assert hierarchy.block_counts(sizes, 4) == ((3, 4, 2), 1) and hierarchy.block_counts((7, 5, 2), 4) == ((2, 2, 1), 4)
    with pytest.raises(ValueError, match="outside"):
        hierarchy.drilled(df, (2, 0, 0), 4, (7, 5, 2))
    with pytest.raises(ValueError, match="levels"):
        hierarchy.height((1 << 21, 1, 1))


def spline(x, k, points):
    """By the recursion of basis functions."""
    m = len(points) - k + 2
    t = [0.0] * (k - 1) + [i / (m - 1) for i in range(m)] + [1.0] * (k - 1)

    def basis(i, k):
        if k == 1:
            return float(t[i] <= x < t[i + 1])
        left = (x - t[i]) / (t[i + k - 1] - t[i]) * basis(i, k - 1) if t[i + k - 1] > t[i] else 0.0
        return left + ((t[i + k] - x) / (t[i + k] - t[i + 1]) * basis(i + 1, k - 1) if t[i + k] > t[i + 1] else 0.0)

    return [sum(basis(i, k) * p[c] for i, p in enumerate(points)) for c in (0, 1)]


def test_curves(spark):
    rng = random.Random(4)
    lines = [[(rng.random(), rng.random()) for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 6, 9, 20)] + [[(1.0, 1.0)] * 5]
    df = spark.createDataFrame(list(enumerate(lines)) + [(99, None)], "id int, p array<struct<x:double,y:double>>")
    got = {r.id: r.c for r in df.select("id", hierarchy.curved(F.col("p"), 11).alias("c")).collect()}
    assert got[0] is None and got[99] is None and [tuple(p) for p in got[1]] == lines[1] * 11
    for k, points in enumerate(lines[2:], 2):
        assert [tuple(got[k][0]), tuple(got[k][-1])] == [pytest.approx(points[0]), pytest.approx(points[-1])]
        for i, p in enumerate(got[k][:-1]):
            assert list(p) == pytest.approx(spline(i / 10, min(4, len(points)), points), abs=1e-9)
