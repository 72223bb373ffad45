"""Pairs of unit vectors by their products, without a list of all pairs.

Vectors are dealt to groups around some of them, so that a group is a cap of
the sphere with a middle and an angle. The angle between two vectors is at
least that of the middles less both groups' angles, and at most their sum:
pairs of groups that can hold no value asked for are dropped before vectors
meet. Those that are left are multiplied as matrices, in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.session import checkpointed

#: Vectors of a group, and groups at the most: their middles go to every task.
GROUP, MOST_GROUPS = 256, 20_000
#: Angles are rounded: so much is added to a group's.
_SLACK = 1e-7
_ID = "struct<bz:bigint,by:bigint,bx:bigint>"


def _matrix(column, n: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(n, -1)


def _assigned(middles):
    """mapInArrow function: (id, v) to (id, v, d, g), g the nearest middle of the vector's length d."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = middles.value
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column(1)], dtype="i4")
            for d in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == d)))
                near = (_matrix(part.column(1), part.num_rows) @ known[int(d)].T).argmax(1)
                more = [pa.array(np.full(part.num_rows, d, "i4")), pa.array(near.astype("i4"))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=["id", "v", "d", "g"])

    return run


def grouped(vectors: DataFrame, size: int | None = None) -> DataFrame:
    """(d, g, part, ids, flat, middle, angle) of vectors (id, v): each group's ids and vectors in one row."""
    vectors = checkpointed(vectors.select("id", "v"))
    n = vectors.count()
    size = max(size or GROUP, math.ceil(n / MOST_GROUPS))
    share = min(1.0, 1.0 / size)
    # about n / size vectors, by the hash of their id; of each length at least one
    chance = (F.xxhash64("id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))) < share
    some = vectors.select(F.size("v").alias("d"), "v", chance.alias("on"), F.xxhash64("id").alias("h"))
    first = some.groupBy("d").agg(F.min_by("v", "h").alias("v"))
    middles: dict[int, list] = {}
    for d, v in first.unionByName(some.filter("on").select("d", "v")).toPandas().itertuples(index=False):
        middles.setdefault(int(d), []).append(np.asarray(v, float))
    shared = vectors.sparkSession.sparkContext.broadcast({d: np.stack(v) for d, v in middles.items()})
    dealt = checkpointed(vectors.mapInArrow(_assigned(shared), f"id {_ID}, v array<double>, d int, g int"))
    # a group of more vectors than ``size`` is several
    parts = dealt.groupBy("d", "g").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    dealt = dealt.join(parts, ["d", "g"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    rows = dealt.groupBy("d", "g", "part").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    rows = rows.select("d", "g", "part", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("flat"))
    return checkpointed(rows.mapInArrow(_capped, f"d int, ids array<{_ID}>, flat array<double>, middle array<double>, angle double")
                        .withColumn("name", F.monotonically_increasing_id()))


def _capped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        middles, angles = [], []
        for d, flat in zip(batch.column("d").to_pylist(), batch.column("flat")):
            x = flat.values.to_numpy(zero_copy_only=False).reshape(-1, d)
            middle = x.sum(0)
            size = np.linalg.norm(middle)
            middle = middle / size if size > 1e-9 else x[0]
            middles.append(middle)
            angles.append(float(np.arccos(np.clip((x @ middle).min(), -1, 1))) + _SLACK)
        columns = [batch.column("d"), batch.column("ids"), batch.column("flat"), pa.array(middles, pa.list_(pa.float64())), pa.array(angles)]
        yield pa.RecordBatch.from_arrays(columns, names=["d", "ids", "flat", "middle", "angle"])


def _possible(others: pd.DataFrame, same: bool, low: float | None, high: float | None, least: float | None):
    """mapInArrow function: groups (name, d, middle, angle) to the pairs of groups (a, b) that may hold a value asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = others.value
        by_length = {d: (g["name"].to_numpy(), np.stack(g["middle"].to_numpy()), g["angle"].to_numpy()) for d, g in known.groupby("d")}
        for batch in batches:
            a, b = [], []
            for name, d, middle, angle in zip(*(c.to_pylist() for c in batch.columns)):
                if d not in by_length:
                    continue
                names, middles, angles = by_length[d]
                apart, reach = np.arccos(np.clip(middles @ np.asarray(middle), -1, 1)), angles + angle
                top = np.cos(np.maximum(apart - reach - _SLACK, 0))
                bottom = np.cos(np.minimum(apart + reach + _SLACK, np.pi))
                ok = np.ones(len(names), bool) if not same else names <= name
                if low is not None:
                    ok &= top >= low
                if high is not None:
                    ok &= bottom <= high
                if least is not None:
                    ok &= (top >= least) | (bottom <= -least)
                a += [name] * int(ok.sum())
                b.append(names[ok])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(np.concatenate(b) if b else [], pa.int64())], names=["a", "b"])

    return run


def _after(i: np.ndarray, j: np.ndarray, equal: bool) -> np.ndarray:
    """Rows of i (bz, by, bx) that come after those of j, or are the same."""
    last = i[:, 2] >= j[:, 2] if equal else i[:, 2] > j[:, 2]
    return (i[:, 0] > j[:, 0]) | ((i[:, 0] == j[:, 0]) & ((i[:, 1] > j[:, 1]) | ((i[:, 1] == j[:, 1]) & last)))


def _multiplied(same: bool, diagonal: bool, low: float | None, high: float | None, least: float | None, absolute: bool):
    def places(ids: pa.ListScalar) -> np.ndarray:
        return np.column_stack([ids.values.field(c).to_numpy(zero_copy_only=False) for c in ("bz", "by", "bx")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, a, b, one, ia, xa, ib, xb in zip(*batch.columns):
                x, y = (v.values.to_numpy(zero_copy_only=False).reshape(-1, d.as_py()) for v in (xa, xb))
                pa_, pb = places(ia), places(ib)
                step = max(1, (1 << 20) // max(1, len(y)))
                for s in range(0, len(x), step):
                    value = x[s : s + step] @ y.T
                    size = np.abs(value)
                    value = size if absolute else value
                    ok = np.ones(value.shape, bool)
                    for bound, test in ((low, value >= (low or 0)), (high, value <= (high or 0)), (least, size >= (least or 0))):
                        ok &= test if bound is not None else True
                    r, c = np.nonzero(ok)
                    i, j, v = pa_[s + r], pb[c], value[r, c]
                    if same:
                        ahead = _after(i, j, diagonal)
                        if not one.as_py():  # two groups: a pair is met once, in either order
                            i, j = np.where(ahead[:, None], i, j), np.where(ahead[:, None], j, i)
                        else:
                            i, j, v = i[ahead], j[ahead], v[ahead]
                    named = lambda p: pa.StructArray.from_arrays([pa.array(p[:, k]) for k in range(3)], ["bz", "by", "bx"])
                    yield pa.RecordBatch.from_arrays([named(i), named(j), pa.array(v)], names=["i", "j", "value"])

    return run


def _met(pairs: DataFrame, a: DataFrame, b: DataFrame, same: bool, *asked) -> DataFrame:
    side = lambda df, c: df.select(F.col("name").alias(c), F.col("ids").alias(f"i{c}"), F.col("flat").alias(f"x{c}"))
    met = pairs.join(side(a, "a").withColumn("d", F.size("xa") / F.size("ia")), "a").join(side(b, "b"), "b")
    met = met.select(F.col("d").cast("int").alias("d"), "a", "b", (F.col("a") == F.col("b")).alias("one"), "ia", "xa", "ib", "xb")
    return met.mapInArrow(_multiplied(same, *asked), f"i {_ID}, j {_ID}, value double")


def unit_pairs(
    first: DataFrame, second: DataFrame | None = None, diagonal: bool = False, low: float | None = None, high: float | None = None,
    least: float | None = None, absolute: bool = False,
) -> DataFrame:
    """(i, j, value) of unit vectors (id, v), whose value is the product, between ``low`` and ``high`` and of a magnitude of ``least``.

    Pairs i > j of one table (i >= j with ``diagonal``), or all pairs of two.
    With ``absolute`` the value is the magnitude. Vectors of different lengths
    have no value.
    """
    a, same = grouped(first), second is None
    b = a if same else grouped(second)
    if absolute and low is not None:
        least, low = max(low, least or 0.0), None
    # bounds on magnitudes say less: high ones are left to the values
    bounds = (low, None if absolute else high, least)
    middles = b.select("name", "d", "middle", "angle").toPandas()  # at most about 2 * MOST_GROUPS rows
    shared = a.sparkSession.sparkContext.broadcast(middles)
    pairs = a.select("name", "d", "middle", "angle").mapInArrow(_possible(shared, same, *bounds), "a long, b long")
    return _met(checkpointed(pairs), a, b, same, diagonal, low, high, least, absolute)


def strongest(vectors: DataFrame, k: int, second: DataFrame | None = None) -> DataFrame:
    """The k pairs (i, j, value) of largest magnitude, strongest first, ties in the order of i and j.

    Pairs inside groups and of neighbouring ones come first; the k-th
    magnitude among them bounds all others.
    """
    order = [F.desc(F.abs("value")), "i", "j"]
    if second is None:
        a = grouped(vectors)
        own = a.select(F.col("name").alias("a"), F.col("name").alias("b"))
        found = _met(own, a, a, True, False, None, None, None, False).orderBy(*order).limit(k).select(F.abs("value").alias("v")).collect()
        least = found[-1]["v"] if len(found) == k else None
    else:
        least = None
    pairs = unit_pairs(vectors, second, least=None if least is None else least * (1 - 1e-12))
    return pairs.orderBy(*order).limit(k)
