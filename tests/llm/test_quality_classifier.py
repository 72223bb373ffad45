import random
import zlib

import pytest
from conftest_llm import prose

from gridlark.llm import quality_classifier as Q


def test_held_out_accuracy_and_folds(spark):
    rng = random.Random(4)
    good = lambda: ". ".join(prose(rng, 12, 3000).translate({48 + k: 97 + k for k in range(10)}).capitalize() for _ in range(9))
    bad = lambda: "BUY NOW!!! $$$ " * rng.randint(3, 30) + prose(rng, 9)
    rows = [(k, good() if k % 2 else bad(), "en") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string").repartition(4)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(400)], "doc_id long, quality int, toxic int")
    got = Q.scores(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(got) == 400 and sum(r.predicted == r.doc_id % 2 for r in held) >= 0.95 * len(held)


def test_nulls_repeats_and_no_labels(docs, rows, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.scores(docs, none).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.5}
    few = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(1, None), (1, 1), (None, 1)], "doc_id long, quality int")
    got = Q.scores(docs, few).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert Q.scores(no_docs, few).collect() == []


def test_score_is_that_of_two_gaussians():
    import numpy as np

    rng = np.random.default_rng(1)
    x = {0: rng.standard_normal((50, 3)), 1: rng.standard_normal((70, 3)) + 1}
    sums = {k: np.column_stack([np.ones(len(v)), v]).T @ np.column_stack([np.ones(len(v)), v]) for k, v in x.items()}
    model = Q.fitted(sums, scale=1.0)
    at = rng.standard_normal((5, 3))
    density = []
    for mean, low in zip(model.means, model.factors):
        d, cov = at - mean, low @ low.T
        density.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    assert model.score(at) == pytest.approx(1 / (1 + np.exp(density[0] - density[1] - np.log(70 / 50))))
