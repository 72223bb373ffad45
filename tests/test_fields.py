"""Fields made from tables, however these are split."""

import datetime
import os
import random

import pytest

from gridlark import catalog
from gridlark.fields import ordered_lineitem_field


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A lineitem table of six files, in which the rows of each mean are spread, and the rows in their order."""
    rng, rows = random.Random(3), []
    for k in range(6000):
        year = datetime.datetime(1995 + rng.randrange(7), 3, 1 + rng.randrange(20))
        rows.append((rng.randrange(1, 13), year, rng.randrange(1, 8), *(rng.randrange(n) / 100 for n in (5000, 10**7, 11, 9))))
    top = tmp_path_factory.mktemp("fields")
    schema = "l_suppkey long, l_shipdate timestamp, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    for k in range(6):
        spark.createDataFrame(rows[k * 1000 : (k + 1) * 1000], schema).coalesce(1).write.parquet(f"{top}/made/{k}")
        os.makedirs(f"{top}/lineitem.parquet", exist_ok=True)
        (part,) = [f for f in os.listdir(f"{top}/made/{k}") if f.startswith("part-")]
        os.link(f"{top}/made/{k}/{part}", f"{top}/lineitem.parquet/part-{k}.parquet")
    return str(top), rows


def means(rows):
    out = {}
    for point, day, m, *values in rows:
        out.setdefault((point, day.year - 1995, m), []).append(values)
    total = lambda x: sum_in_order(x) / len(x)
    return {k: tuple(total([v[c] for v in x]) for c in range(4)) for k, x in out.items()}


def sum_in_order(x):
    total = 0.0
    for v in x:
        total += v
    return total


def test_sums_run_in_the_tables_order(spark, folder):
    got = ordered_lineitem_field(spark, folder[0]).collect()
    want = means(folder[1])
    assert len(got) == len(want) and {(r.point_id, r.t, r.m): (r.quantity, r.extendedprice, r.discount, r.tax) for r in got} == want


def ranked(v):
    return [sum(w < x for w in v) + (sum(w == x for w in v) + 1) / 2 for x in v]


def spearman(pairs):
    a, b = (ranked(v) for v in zip(*pairs))
    mean = (len(a) + 1) / 2
    over = sum((x - mean) * (y - mean) for x, y in zip(a, b))
    under = (sum((x - mean) ** 2 for x in a) * sum((y - mean) ** 2 for y in b)) ** 0.5
    return over / under if under else None


def agree(df, keys, vectors):
    got = {tuple(r[k] for k in keys): r.value for r in df.collect()}
    assert got.keys() == vectors.keys()
    for k, pairs in vectors.items():
        want = 1.0 if len(pairs) == 1 else spearman(pairs)
        assert got[k] == (want if want is None else pytest.approx(want, abs=2e-9))


def test_same_point_spearman_of_a_split_table(spark, folder):
    vectors = {}
    for (point, t, _), v in means(folder[1]).items():
        vectors.setdefault((point, t), []).append((v[0], v[3]))
    agree(catalog.QUERIES["same_point_spearman"](spark, folder[0]), ("point_id", "t"), vectors)


def test_time_axis_spearman_of_a_split_table(spark, folder):
    found, vectors = means(folder[1]), {}
    for (point, t, m), v in found.items():
        if (1, t, m) in found:
            vectors.setdefault((point, m), []).append((found[1, t, m][3], v[3]))
    agree(catalog.QUERIES["time_axis_spearman"](spark, folder[0]), ("point_id", "member"), vectors)
