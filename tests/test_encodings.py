"""Encodings of positions against loops in numpy, and files of weights byte by byte."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.operators import encodings, learned


def looped(p, values, grids, width, nearest, hashed):
    out, start = [], 0
    for g in grids:
        at = [float(c) * g.scale + 0.5 for c in p]
        low = [int(np.floor(c)) for c in at]
        total = np.zeros(width)
        for corner in range(1 if nearest else 8):
            up = [corner >> k & 1 for k in range(3)]
            v = [(i + u) % 2**32 for i, u in zip(low, up)]
            w = 1.0 if nearest else np.prod([c - i if u else 1 - (c - i) for c, i, u in zip(at, low, up)])
            if g.vertices**3 > g.slots:
                a, b, c = (i * q % 2**32 for i, q in zip(v, encodings.PRIMES[hashed]))
                n = a ^ b ^ c
            else:
                n = (v[0] + g.vertices * v[1] + g.vertices**2 * v[2]) % 2**32
            total += w * values[start + n % g.slots]
        start += g.slots
        out += list(total)
    return out


@pytest.mark.parametrize("nearest, hashed, log2_slots", [(False, "prime", 6), (False, "coherent_prime", 7), (True, "reversed_prime", 6), (False, "prime", None)])
def test_grids(spark, nearest, hashed, log2_slots):
    rng = np.random.default_rng(3)
    grids = encodings.levels(3, 3, 1.5, log2_slots)
    values = rng.normal(size=(sum(g.slots for g in grids), 2))
    table = encodings.grid_table(spark, values.ravel(), grids, 2)
    places = [[0.0, 0.0, 0.0], [1.0, 1.0, 1.0], [0.5, 1.0, 0.25], [-0.4, 0.2, 1.3]] + rng.random((40, 3)).tolist()
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(places)], "id long, px double, py double, pz double")
    got = {r.id: r.features for r in encodings.grid_encoded(df, table, grids, 2, ["id"], nearest=nearest, hashed=hashed).collect()}
    assert len(got) == len(places)
    for k, p in enumerate(places):
        assert got[k] == pytest.approx(looped(p, values, grids, 2, nearest, hashed), abs=1e-12)


def test_levels():
    got = encodings.levels(3, 16, 2.0, 14)
    assert [(g.scale, g.vertices, g.slots) for g in got] == [(15, 16, 4096), (31, 32, 16384), (63, 64, 16384)]
    assert encodings.levels(1, 3, 1.0, None)[0].slots == 32


def test_holes_and_empty_tables(spark):
    grids = encodings.levels(2, 2, 2.0, 3)
    none = spark.createDataFrame([], "level int, slot long, features array<double>")
    df = spark.createDataFrame([(1, 0.5, None, 0.5), (2, float("nan"), 0.0, 0.0), (3, 0.1, 0.1, 0.1)], "id long, px double, py double, pz double")
    got = {r.id: r.features for r in encodings.grid_encoded(df, none, grids, 1, ["id"]).collect()}
    assert np.isnan(got[1]).all() and np.isnan(got[2]).all() and got[3] == [0.0, 0.0]
    assert encodings.grid_encoded(df.limit(0), none, grids, 1, ["id"]).collect() == []


def test_dictionary(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "entry long, features array<double>")
    df = spark.createDataFrame([(1, [1.0, 0.9]), (2, [7.0]), (3, [])], "id long, ids array<double>")
    got = {r.id: r.features for r in encodings.dictionary_encoded(df, table, 2, ["id"]).collect()}
    assert got[1] == [3.0, 4.0, 1.0, 2.0] and np.isnan(got[2]).all() and len(got[2]) == 2 and got[3] == []


def test_composed(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 5.0])], "a array<double>, b array<double>")
    told = lambda *more, **kw: df.select(encodings.composed([F.col("a"), F.col("b")], *more, **kw).alias("c")).first().c
    assert told() == [1, 2, 3, 5] and told("sum") == [4, 7] and told("product") == [3, 10]
    assert told("sum", multiple=8, length=2) == [4, 7, 1, 1, 1, 1, 1, 1]


@pytest.mark.parametrize("kind", [0, 1])
def test_a_model_from_its_file(spark, tmp_path, kind):
    rng = np.random.default_rng(5)
    grids = encodings.levels(2, 2, 2.0, 4)
    shape = [(2, 3), (3, 1)]
    numbers = rng.normal(size=2 * 3 + 3 + sum(g.slots for g in grids)).astype(encodings.FORMATS[kind])
    body = np.array([kind, len(numbers)], "<u4").tobytes() + numbers.tobytes()
    with zipfile.ZipFile(tmp_path / "model.zip", "w") as z:
        z.writestr("config.json", json.dumps({"encoding": {"n_levels": 2}}))
        z.writestr("network_encoder.bin", body)
    said, files = encodings.model(spark, f"{tmp_path}/model.zip")
    layers, rest = encodings.unpacked(files["network_encoder.bin"], shape)
    assert said == {"config.json": {"encoding": {"n_levels": 2}}}
    assert layers[0].shape == (2, 3) and layers[0][1, 0] == float(numbers[1])
    df = spark.createDataFrame([(k, *map(float, rng.random(3))) for k in range(20)], "id long, px double, py double, pz double")
    coded = encodings.grid_encoded(df, encodings.grid_table(spark, rest, grids, 1), grids, 1, ["id"])
    net = [(w, np.zeros(w.shape[1])) for w in layers]
    got = {r.id: r.v for r in coded.select("id", learned.network(F.col("features"), net).alias("v")).collect()}
    for r in df.collect():
        x = np.array(looped((r.px, r.py, r.pz), np.asarray(rest).reshape(-1, 1), grids, 1, False, "prime"))
        assert got[r.id] == pytest.approx(float((np.maximum(x @ layers[0], 0) @ layers[1])[0]), abs=1e-9)
    for bad, what in ((body[:-1], "fill"), (body[:4], "header"), (b"\x07" + body[1:], "format")):
        with pytest.raises(ValueError, match=what):
            encodings.unpacked(bad, shape)
    with pytest.raises(ValueError, match="at most"):
        encodings.model(spark, f"{tmp_path}/model.zip", most=10)
