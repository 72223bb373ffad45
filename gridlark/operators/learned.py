"""What learned estimators need around their networks, and small networks over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["point_id"]


def combined(df: DataFrame, low: float, high: float, sizes: tuple) -> DataFrame:
    """Add ``features``: the value as a part of its range, and the place in [-1, 1] along each axis."""
    value = F.coalesce(F.try_divide(F.col("value") - low, F.lit(high - low)), F.lit(0.0))
    places = [F.col(a) / float(max(n - 1, 1)) * 2 - 1 for a, n in zip("xyz", sizes)]
    return df.withColumn("features", F.array(value, *places))


def permuted(df: DataFrame, column: str = "value", keys: list[str] = KEY, seed: int = 5) -> DataFrame:
    """Add the column as ``shuffled``: each key's members in another order, drawn by a hash of seed, key and member."""
    own = Window.partitionBy(*keys)
    places = df.withColumn("place", F.row_number().over(own.orderBy("m")))
    drawn = df.withColumn("place", F.row_number().over(own.orderBy(F.xxhash64(F.lit(seed), *keys, "m"), "m")))
    return places.join(drawn.select(*keys, "place", F.col(column).alias("shuffled")), [*keys, "place"]).drop("place")


def symmetrised(reference: Column, query: Column, kind: str = "add") -> Column:
    """Two feature vectors as one that doesn't know their order: sum, sum with absolute difference, or product."""
    if kind == "mul":
        return F.zip_with(reference, query, lambda r, q: r * q)
    total = F.zip_with(reference, query, lambda r, q: r + q)
    return total if kind == "add" else F.concat(total, F.zip_with(reference, query, lambda r, q: F.abs(r - q)))


def divergence_bound(df: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """(keys, value): the bound on mutual information from a network's outputs ``joint`` and ``shuffled``.

    max(0, mean of joint - log of the mean of exp(shuffled)), with the largest output taken out of the exponent.
    """
    top = F.max("shuffled").over(Window.partitionBy(*keys))
    df = df.withColumns({"top": top, "e": F.exp(F.col("shuffled") - top)})
    value = F.avg("joint") - (F.first("top") + F.log(F.avg("e")))
    return df.groupBy(*keys).agg(F.greatest(value, F.lit(0.0)).alias("value"))


def outputs(v: Column) -> dict[str, Column]:
    """What a network's output stands for: information, a coefficient, its magnitude."""
    return {"information": F.greatest(v, F.lit(0.0)), "coefficient": v, "magnitude": F.abs(v)}


def on_valid(df: DataFrame, estimate: Callable[[DataFrame], DataFrame], keys: list[str] = KEY) -> DataFrame:
    """estimate, which gives (keys, value), of the keys without NaN; the others come back with NaN."""
    whole = df.groupBy(*keys).agg(F.bool_or(F.isnan("value")).alias("bad"))
    good = df.join(whole.filter("NOT bad").select(*keys), keys, "left_semi")
    nan = F.lit(float("nan"))
    return whole.select(*keys).join(estimate(good), keys, "left").withColumn("value", F.coalesce("value", nan))


def frequencies(x: np.ndarray, octaves: int) -> np.ndarray:
    """Sines and cosines of the features at doubling frequencies."""
    at = x[:, :, None] * np.pi * 2.0 ** np.arange(octaves)
    return np.concatenate((np.sin(at), np.cos(at)), axis=2).reshape(len(x), -1)


ACTIVATIONS = {
    "relu": lambda x: np.maximum(x, 0.0), "snake": lambda x: x + np.sin(x) ** 2, "snake_alt": lambda x: 0.5 * (x + 1 - np.cos(2 * x)), "none": lambda x: x,
}


def network(features: Column, layers: list[tuple[np.ndarray, np.ndarray]], activation: str = "relu", octaves: int = 0) -> Column:
    """The first output of a fully connected network (weights, biases) over a column of feature arrays.

    Weights travel with the function, so they must fit in a task's memory several times.
    """

    @F.pandas_udf("double")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=float)
                continue
            x = np.stack([np.asarray(v, float) for v in batch])
            x = frequencies(x, octaves) if octaves else x
            for k, (w, b) in enumerate(layers):
                x = x @ w + b
                x = ACTIVATIONS[activation](x) if k + 1 < len(layers) else x
            yield pd.Series(x[:, 0])

    return told(features)
