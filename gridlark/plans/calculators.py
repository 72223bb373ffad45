"""Named fields that are calculated from each other: a catalog of lazy DataFrames, resolved by their names.

A field is (point_id, x, y, z, m, value), without m where it has one value a
point. A calculator names its inputs, which are fields of a source or other
calculators, in any order; what isn't asked for is never built, and an input
that several calculators share is one DataFrame. Cycles, unknown names and
names that are given twice are refused.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators import dependence, ensemble, grid
from gridlark.plans.described import SOURCES
from gridlark.sources import datasets

PLACE = ["point_id", "x", "y", "z"]
Calculator = Callable[..., DataFrame]
CALCULATORS: dict[str, Calculator] = {}


def calculator(name: str) -> Callable[[Calculator], Calculator]:
    """Register a function of fields (and options) under a name, for descriptions to use."""

    def put(f: Calculator) -> Calculator:
        if name in CALCULATORS:
            raise ValueError(f"a calculator {name} is there already")
        CALCULATORS[name] = f
        return f

    return put


def _together(*fields: DataFrame) -> DataFrame:
    """The fields' values as v0, v1, ... at the points and members that all have; one without members meets every member."""
    first = sorted(fields, key=lambda df: "m" not in df.columns)[0]
    keys = [*PLACE, *(["m"] if "m" in first.columns else [])]
    out = None
    for k, df in enumerate(fields):
        at = [c for c in ("point_id", "m") if c in df.columns]
        one = df.select(*at, F.col("value").alias(f"v{k}"))
        out = first.select(*keys).join(one, at) if out is None else out.join(one, at)
    return out


def _binary(kind: str) -> Calculator:
    def calculate(first: DataFrame, second: DataFrame) -> DataFrame:
        both = _together(first, second)
        return both.withColumn("value", grid.binary(F.col("v0"), F.col("v1"))[kind]).drop("v0", "v1")

    return calculate


for _kind in ("sum", "difference", "absolute_difference", "product", "maximum", "minimum"):
    CALCULATORS[_kind] = _binary(_kind)


@calculator("smoothed")
def smoothed(field: DataFrame, radius: int = 1, sigma: float = 1.0) -> DataFrame:
    with_members = field if "m" in field.columns else field.withColumn("m", F.lit(0))
    out = field.select(*PLACE).distinct().join(grid.smoothed(with_members, radius, sigma), "point_id")
    return out if "m" in field.columns else out.drop("m")


def _of_members(column: str) -> Calculator:
    def calculate(field: DataFrame) -> DataFrame:
        told = ensemble.mean_and_spread(field).select("point_id", F.col(column).alias("value"))
        return field.select(*PLACE).distinct().join(told, "point_id")

    return calculate


CALCULATORS |= {"mean": _of_members("mean"), "spread": _of_members("spread")}


@calculator("correlation")
def correlation(field: DataFrame, point: int, measure: str = "pearson", absolute: bool = False, **options) -> DataFrame:
    """The measure of every point with a reference point."""
    told = dependence.correlation_field(field, point, measure, absolute, options)
    return field.select(*PLACE).distinct().join(told, "point_id")


def _of_vectors(column: str) -> Calculator:
    def calculate(u: DataFrame, v: DataFrame, w: DataFrame) -> DataFrame:
        both = _together(u, v, w).withColumnsRenamed({"v0": "u", "v1": "v", "v2": "w"})
        keys = ["m"] if "m" in both.columns else []
        return grid.vorticity(both, keys=keys).select(*PLACE, *keys, F.col(column).alias("value"))

    return calculate


CALCULATORS |= {"magnitude": _of_vectors("speed"), "vorticity magnitude": _of_vectors("curl"), "helicity": _of_vectors("helicity")}


class Fields:
    """The fields of a description by name, each built when it is first asked for."""

    def __init__(self, spark: SparkSession, said: dict | str, catalog: dict[str, datasets.Dataset] | None = None):
        said = json.loads(said) if isinstance(said, str) else said
        self.spark, self.catalog, self.sources = spark, catalog or {}, said.get("sources", {})
        self.calculators: dict[str, dict] = {}
        for one in said.get("calculators", []):
            name = one.get("name")
            if not name or name in self.calculators or name in self.sources:
                raise ValueError(f"a field {name} is there already, or has no name")
            if one.get("op") not in CALCULATORS:
                raise ValueError(f"{name}: no calculator {one.get('op')}")
            self.calculators[name] = one
        self.built: dict[str, DataFrame] = {}
        for name in self.calculators:
            self.order(name)

    def order(self, name: str, above: tuple[str, ...] = ()) -> list[str]:
        """The calculators that a field needs, inputs first; a field that needs itself is refused."""
        if name in self.sources:
            return []
        if name in above:
            raise ValueError("fields that need each other: " + " > ".join([*above[above.index(name) :], name]))
        if name not in self.calculators:
            raise ValueError(f"no field {name}" + (f", which {above[-1]} needs" if above else ""))
        out: list[str] = []
        for other in self.calculators[name].get("inputs", []):
            out += [n for n in self.order(other, (*above, name)) if n not in out]
        return [*out, name]

    def _source(self, said: dict) -> DataFrame:
        if "dataset" in said:
            if said["dataset"] not in self.catalog:
                raise ValueError(f"no data set {said['dataset']}")
            df = datasets.read(self.spark, self.catalog[said["dataset"]]).withColumn("m", F.col("e"))
            df = df.filter(F.col("variable") == said["variable"]) if "variable" in said else df
        elif said.get("field") in SOURCES:
            df = SOURCES[said["field"]](self.spark, said["folder"])
            df = df.withColumn("value", F.col(said["variable"])) if "variable" in said else df
        else:
            raise ValueError(f"no source {said}")
        df = df.filter(F.expr(said["where"])) if "where" in said else df
        return df.select(*PLACE, "m", F.col("value").cast("double").alias("value"))

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.sources:
            for each in self.order(name)[:-1]:
                self[each]
        if name not in self.built:
            if name in self.sources:
                self.built[name] = self._source(self.sources[name])
            else:
                said = dict(self.calculators[name])
                inputs = [self[n] for n in said.get("inputs", [])]
                options = {k: v for k, v in said.items() if k not in ("name", "op", "inputs")}
                self.built[name] = CALCULATORS[said["op"]](*inputs, **options)
        return self.built[name]

    def saved(self) -> str:
        return json.dumps({"sources": self.sources, "calculators": list(self.calculators.values())}, indent=1)
