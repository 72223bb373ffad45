"""An analysis as data: a source and named operators with their arguments, saved and replayed as JSON.

Each operator takes a DataFrame and gives one, so a description is a chain of
lazy DataFrames; Spark optimises it as a whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark import fields
from gridlark.operators import dependence, ensemble, features, grid, regions
from gridlark.sources import datasets

Operator = Callable[..., DataFrame]

SOURCES: dict[str, Callable[..., DataFrame]] = {
    "embeddings": fields.embedding_field, "lineitem": fields.lineitem_field, "events": fields.event_series,
}
OPERATORS: dict[str, Operator] = {
    "mean_and_spread": ensemble.mean_and_spread, "set_predicate": ensemble.set_predicate, "kl_binned": ensemble.kl_binned, "kl_knn": ensemble.kl_knn,
    "block_means": ensemble.block_means, "block_spread": ensemble.block_spread, "block_abs_max": ensemble.block_abs_max, "divergent_range": ensemble.divergent_range,
    "velocity": grid.velocity, "vorticity": grid.vorticity, "smoothed": grid.smoothed, "region": grid.region, "sphere": grid.sphere, "cube": grid.cube,
    "subsampled": grid.subsampled, "transposed": grid.transposed, "crossing_cells": grid.crossing_cells, "slice_range": grid.slice_range,
    "correlation_field": dependence.correlation_field, "windowed": dependence.windowed, "mean_pairs": regions.mean_pairs, "strongest": regions.strongest,
    "matrix": regions.matrix, "point_features": features.point_features, "member_features": features.member_features,
}


def operator(name: str) -> Callable[[Operator], Operator]:
    """Register a function of a DataFrame under a name, for descriptions to use."""

    def put(f: Operator) -> Operator:
        if name in OPERATORS:
            raise ValueError(f"an operator {name} is there already")
        OPERATORS[name] = f
        return f

    return put


def filtered(df: DataFrame, where: str) -> DataFrame:
    return df.filter(F.expr(where))


OPERATORS["filter"] = filtered


def saved(source: dict, *steps: dict) -> str:
    """The description as JSON."""
    return json.dumps({"source": source, "steps": list(steps)}, indent=1)


def run(spark: SparkSession, description: str | dict, catalog: dict[str, datasets.Dataset] | None = None) -> DataFrame:
    """The DataFrame that a description stands for.

    ``source`` names a table's field with its folder, or a data set of the
    catalog; each step has ``op`` and its arguments. Unknown names are refused.
    """
    said = json.loads(description) if isinstance(description, str) else description
    source = said["source"]
    if "dataset" in source:
        if not catalog or source["dataset"] not in catalog:
            raise ValueError(f"no data set {source['dataset']}")
        df = datasets.read(spark, catalog[source["dataset"]])
    elif source.get("field") in SOURCES:
        df = SOURCES[source["field"]](spark, source["folder"])
    else:
        raise ValueError(f"no source {source}")
    for step in said.get("steps", []):
        step = dict(step)
        name = step.pop("op", None)
        if name not in OPERATORS:
            raise ValueError(f"no operator {name}")
        df = OPERATORS[name](df, **step)
    return df


def vector_chain(df: DataFrame, keys: list[str] = ()) -> dict[str, DataFrame]:
    """What follows from a velocity field (keys, x, y, z, u, v, w), by name: magnitudes, vorticity, helicity."""
    if not {"u", "v", "w"} <= set(df.columns):
        return {}
    whole = grid.vorticity(df, keys=keys)
    place = [*keys, "x", "y", "z"]
    one = lambda c: whole.select(*place, F.col(c).alias("value"))
    return {
        "velocity": df.select(*place, "u", "v", "w"), "velocity magnitude": one("speed"), "vorticity": whole.select(*place, "cu", "cv", "cw"),
        "vorticity magnitude": one("curl"), "helicity": one("helicity"),
    }
