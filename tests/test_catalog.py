"""Every registered field query against its DuckDB twin."""

import math
import os
import random

import duckdb
import pytest

from gridlark.catalog import ORACLE_SQL, QUERIES
from gridlark.functions.measures import psi
from gridlark.operators import ensemble

SF = "/root/testdata/sf0.001"
TABLES = ("embeddings", "lineitem", "events")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def told(v):
    return "-" if v is None or isinstance(v, float) and math.isnan(v) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_matches_duckdb(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(([told(r[c]) for c in cols] for r in df.collect()), key=str)
    res = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(([told(r[names.index(c)]) for c in cols] for r in res.fetchall()), key=str)
    # full windows need every step, which the smallest tables don't have; totals are one row
    assert len(got) == len(want) and (got or name.startswith("window"))
    key = lambda r: [v for v in r if not isinstance(v, float)]
    for g, w in zip(sorted(got, key=lambda r: str(key(r))), sorted(want, key=lambda r: str(key(r)))):
        assert key(g) == key(w)
        assert [v for v in g if isinstance(v, float)] == pytest.approx([v for v in w if isinstance(v, float)], abs=2e-9)


def test_sizes_come_from_the_table(spark, tmp_path):
    rng = random.Random(1)
    for size, members in ((700, 4), (40, 4), (0, 4)):
        df = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(members)]) for k in range(size)], "vec_id long, embedding array<float>")
        df.write.parquet(f"{tmp_path}/{size}/embeddings.parquet")
    inside = lambda n: {(k, m) for k in range(n) for m in range(4) if 0 < k % 10 < 9 and 0 < k // 10 % 10 < 9 and 0 < k // 100 < (n - 1) // 100}
    for size in (700, 40, 0):
        got = QUERIES["inner_points"](spark, f"{tmp_path}/{size}").collect()
        assert len(got) == len(inside(size)) and {(r.point_id, r.m) for r in got} == inside(size)


def test_kl_knn_counts_each_points_members(spark):
    rng = random.Random(2)
    values = {p: [rng.gauss(0, 1) for _ in range(n)] for p, n in ((0, 20), (1, 64), (2, 150))}
    df = spark.createDataFrame([(p, m, v) for p, x in values.items() for m, v in enumerate(x)], "point_id long, m int, value double")
    got = {r.point_id: r.kl for r in ensemble.kl_knn(df, 3).collect()}
    for p, x in values.items():
        n, mean = len(x), sum(x) / len(x)
        u = [(v - mean) / (sum((w - mean) ** 2 for w in x) / n) ** 0.5 for v in x]
        near = [sorted(abs(a - b) for j, b in enumerate(u) if j != i)[2] for i, a in enumerate(u)]
        entropy = sum(map(math.log, near)) / n + psi(n) - psi(3) + math.log(2)
        assert got[p] == pytest.approx(max(0.5 * math.log(2 * math.pi) + 0.5 - entropy, 0), abs=1e-9)
