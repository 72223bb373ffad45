"""A JSON catalog of data sets: names, files, ranges of files over time or members, axes, scale, boxes."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators.grid import region, subsampled, transposed
from gridlark.sources import formats, grib, hdf5, slabs, stores, volumes


@dataclass
class Dataset:
    """A volume data set: its files with their time step and member."""

    name: str
    files: list[tuple[str, int, int]]
    axes: tuple[int, int, int] = (0, 1, 2)
    scale: tuple[float, float, float] = (1.0, 1.0, 1.0)
    subsampling: int = 1
    low: tuple[int, int, int] | None = None
    high: tuple[int, int, int] | None = None
    more: dict = field(default_factory=dict)


def placed(names: list[str], steps: int, members: int, time_first: bool = False) -> list[tuple[str, int, int]]:
    """(file, t, e): members of a step follow each other, or steps of a member with ``time_first``."""
    if len(names) != steps * members:
        raise ValueError(f"{len(names)} files for {steps} steps of {members} members")
    if time_first:
        return [(n, k % steps, k // steps) for k, n in enumerate(names)]
    return [(n, k // members, k % members) for k, n in enumerate(names)]


_KNOWN = {"type", "name", "filename", "filenames", "ensemble_range", "time_range", "range_exclusive", "range_inclusive", "axes", "scale", "subsampling_factor", "min", "max"}


def _dataset(said: dict, folder: str) -> Dataset:
    names = said.get("filenames", said.get("filename"))
    if names is None:
        raise ValueError(f"{said.get('name')}: no file is named")
    names = [n if n.startswith("/") or "://" in n else f"{folder}/{n}" for n in ([names] if isinstance(names, str) else names)]
    kinds = [k for k in ("ensemble_range", "time_range") if k in said]
    if len(kinds) > 1:
        raise ValueError(f"{said.get('name')}: a range of members and one of time steps can't go together")
    files = [(n, 0, 0) for n in names] if len(names) == 1 else placed(names, len(names), 1)
    if kinds:
        ends = [int(v) for v in str(said[kinds[0]]).split()]
        if len(ends) not in (2, 3):
            raise ValueError(f"{said.get('name')}: a range has a start, an end and maybe a step")
        inclusive = said.get("range_inclusive", False) if "range_exclusive" not in said else not said["range_exclusive"]
        each = [volumes.expanded(n, *ends, inclusive=bool(inclusive)) for n in names]
        files = [(n, i, 0) if kinds[0] == "time_range" else (n, 0, k) for one in each for k, (i, n) in enumerate(one)]
    box = {c: tuple(said[k]) if k in said else None for c, k in (("low", "min"), ("high", "max"))}
    more = {k: v for k, v in said.items() if k not in _KNOWN}
    scale = said.get("scale", 1.0)
    scale = (float(scale),) * 3 if isinstance(scale, int | float) else tuple(map(float, scale))
    return Dataset(said["name"], files, tuple(said.get("axes", (0, 1, 2))), scale, int(said.get("subsampling_factor", 1)), **box, more=more)


def catalog(text: str, folder: str = ".") -> dict[str, Dataset]:
    """The data sets of a JSON list by name; those of nodes as ``node/name``."""
    found: dict[str, Dataset] = {}

    def walk(children: list[dict], path: str) -> None:
        for said in children:
            kind = said.get("type", "volume")
            if kind == "node":
                walk(said.get("children", []), f"{path}{said['name']}/")
            elif kind == "volume":
                found[path + said["name"]] = _dataset(said, folder)
            else:
                raise ValueError(f"{said.get('name')}: unknown type {kind}")

    walk(json.loads(text)["datasets"], "")
    return found


def read(spark: SparkSession, data: Dataset) -> DataFrame:
    """The rows of a data set (see formats), in its box, subsampled and transposed as it says."""
    many = len(data.files) > 1
    # one load for all files that are read by slabs, whose plan the filters below reach
    sliced = [(n, *((t, e) if many else (None, None))) for n, t, e in data.files if slabs.readable(n)]
    parts = [slabs.read_slabs(spark, sliced)] if sliced else []
    for name, t, e in data.files:
        kind = name.rpartition(".")[2].lower()
        if slabs.readable(name):
            continue
        if kind in ("cvol", "dat"):
            rows = (volumes.read_cvol if kind == "cvol" else volumes.read_dat)(spark, name)
            rows = rows.withColumns({"variable": F.lit(formats.ATTRIBUTE), "e": F.lit(0)})
            rows = rows if "t" in rows.columns else rows.withColumn("t", F.lit(0))
            rows = rows.select(formats.NAMES)
        elif kind in grib.ENDINGS:
            rows = grib.read_grib(spark, name)
        elif kind in hdf5.ENDINGS:
            rows = hdf5.read_hdf5(spark, name)
        elif kind in formats.READERS:
            rows = formats.READERS[kind](spark, name)
        elif kind in stores.READERS:
            rows = stores.READERS[kind](spark, name)
        else:
            raise ValueError(f"{name}: no reader for .{kind} files")
        parts.append(rows.withColumns({"t": F.lit(t), "e": F.lit(e)}) if many else rows)
    df = reduce(DataFrame.unionByName, parts)
    if data.low is not None or data.high is not None:
        top = 1 << 31
        df = region(df, data.low or (0, 0, 0), data.high or (top, top, top))
    df = subsampled(df, data.subsampling) if data.subsampling > 1 else df
    return df if data.axes == (0, 1, 2) else transposed(df, data.axes)
