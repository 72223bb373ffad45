"""Fields that are calculated from each other: order, sharing, and what is refused."""

import json

import pytest
from pyspark.sql import functions as F

from gridlark.plans import calculators
from gridlark.plans.calculators import Fields


@pytest.fixture
def source(spark, tmp_path):
    rows = [(k, [float(k), float(k * k), 1.0]) for k in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return {"field": "embeddings", "folder": str(tmp_path)}


def _said(source, *each):
    return {"sources": {"a": source, "first": source | {"where": "m = 0"}}, "calculators": list(each)}


def test_chains_in_any_order(spark, source):
    said = _said(
        source,
        {"name": "far", "op": "difference", "inputs": ["twice", "mean"]},
        {"name": "twice", "op": "sum", "inputs": ["a", "a"]},
        {"name": "mean", "op": "mean", "inputs": ["a"]},
        {"name": "never", "op": "correlation", "inputs": ["far"], "point": 5},
    )
    made = Fields(spark, json.dumps(said))
    assert made.order("never") == ["twice", "mean", "far", "never"]
    got = {(r.point_id, r.m): r.value for r in made["far"].collect()}
    value = lambda p, m: float((p, p * p, 1)[m])
    assert got == pytest.approx({(p, m): 2 * value(p, m) - (p + p * p + 1) / 3 for p in range(300) for m in range(3)})
    # what isn't asked for isn't built, and what is shared is one
    assert set(made.built) == {"a", "twice", "mean", "far"} and made["mean"] is made["mean"]
    again = Fields(spark, made.saved())
    assert again.order("never") == made.order("never")


def test_vectors_and_correlation(spark, source):
    said = _said(
        source,
        {"name": "size", "op": "magnitude", "inputs": ["first", "first", "first"]},
        {"name": "like", "op": "correlation", "inputs": ["a"], "point": 7, "measure": "kendall"},
        {"name": "smooth mean", "op": "smoothed", "inputs": ["mean"]},
        {"name": "mean", "op": "mean", "inputs": ["a"]},
    )
    made = Fields(spark, said)
    assert {r.point_id: r.value for r in made["size"].collect()} == pytest.approx({p: p * 3**0.5 for p in range(300)})
    assert made["like"].filter("point_id = 7").first().value == 1.0 and made["like"].columns == ["point_id", "x", "y", "z", "value"]
    assert made["smooth mean"].count() == 300 and "m" not in made["smooth mean"].columns


def test_what_is_refused(spark, source):
    one = lambda name, *inputs, op="sum": {"name": name, "op": op, "inputs": list(inputs)}
    for wrong, why in (
        ([one("p", "q", "a"), one("q", "r", "a"), one("r", "p", "a")], "p > q > r > p"),
        ([one("p", "p", "a")], "p > p"),
        ([one("p", "nobody", "a")], "nobody, which p needs"),
        ([one("p", "a", "a"), one("p", "a", "a")], "there already"),
        ([one("a", "first", "first")], "there already"),
        ([one("p", "a", op="guess")], "guess"),
    ):
        with pytest.raises(ValueError, match=why):
            Fields(spark, _said(source, *wrong))
    with pytest.raises(ValueError, match="no source"):
        Fields(spark, {"sources": {"s": {"field": "none"}}})["s"]


def test_fields_of_a_variable(spark, tmp_path):
    from gridlark.sources import datasets

    (tmp_path / "f.dat").write_text("ObjectFileName: f.raw\nResolution: 2 1 1\nFormat: UCHAR\n")
    (tmp_path / "f.raw").write_bytes(bytes([3, 4]))
    catalog = datasets.catalog('{"datasets": [{"name": "d", "filename": "f.dat"}]}', str(tmp_path))
    said = {"sources": {n: {"dataset": "d", "variable": n} for n in ("Scalar Attribute", "other")}}
    made = Fields(spark, said, catalog)
    assert sorted(r.value for r in made["Scalar Attribute"].collect()) == [3.0, 4.0] and made["other"].count() == 0


def test_registered_calculators(spark, source):
    @calculators.calculator("halved")
    def halved(field, by=2):
        return field.withColumn("value", F.col("value") / by)

    try:
        made = Fields(spark, _said(source, {"name": "h", "op": "halved", "inputs": ["a"], "by": 4}))
        assert made["h"].filter("point_id = 8 AND m = 0").first().value == 2.0
        with pytest.raises(ValueError):
            calculators.calculator("halved")(halved)
    finally:
        del calculators.CALCULATORS["halved"]
