"""Binned information of all pairs of columns in one pass: what is left out of one pair stays in the others."""

import numpy as np
import pytest

from gridlark.functions import kernels
from gridlark.operators import similarity


def test_binned_matrix_leaves_out_rows_of_one_pair_only(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(200, 3))
    v[5, 1], v[9, 2] = np.nan, np.nan
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in v], "a double, b double, c double")
    got = {(r.a, r.b): r.value for r in similarity.binned_matrix(df, [("b", "a"), ("c", "a"), ("c", "b")], 9).collect()}
    for (p, q), value in got.items():
        x, y = v[:, "abc".index(p)], v[:, "abc".index(q)]
        ok = ~np.isnan(x) & ~np.isnan(y)
        assert value == pytest.approx(kernels.mi_binned(x[ok], y[ok], 9), abs=1e-12)
    assert len(got) == 3
    assert similarity.binned_matrix(df.limit(0), [("b", "a")]).first().value is None
