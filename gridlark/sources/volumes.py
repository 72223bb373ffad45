"""Volume files as rows of (path, point_id, x, y, z, component, value), x running fastest.

Files are found and read by Spark's binaryFile source, so any store that
Spark reaches will do. A file is one row of that source (up to 2 GB) and one
task's work; its values leave in Arrow batches of bounded size.
"""

from __future__ import annotations

import os
import posixpath
import re
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.sources.blocks import Block

SCHEMA = "path string, point_id long, x int, y int, z int, component int, value double"
CHUNK = 1 << 16
MOST_BYTES = 1 << 30
# The header of a cvol file (magic, sizes, voxel sizes, type, padding), its types
# in order of their numbers, and the format names of .dat files with their components.
CVOL = "<4s3Q3diQ"
CVOL_BYTES = struct.calcsize(CVOL)
CVOL_TYPES = ("u1", "u2", "f4")
DAT_FORMATS = {"float": ("f4", 1), "uchar": ("u1", 1), "byte": ("u1", 1), "ushort": ("u2", 1), "float3": ("f4", 3), "float4": ("f4", 4)}


def _batches(path: str, data: np.ndarray, sizes: tuple[int, int, int], components: int) -> Iterator[pa.RecordBatch]:
    xs, ys, zs = sizes
    total = xs * ys * zs * components
    if len(data) != total:
        raise ValueError(f"{path} holds {len(data)} values, {total} are announced")
    for first in range(0, total, CHUNK):
        at = np.arange(first, min(first + CHUNK, total))
        p = at // components
        cols = [p, (p % xs).astype("i4"), (p // xs % ys).astype("i4"), (p // (xs * ys)).astype("i4"), (at % components).astype("i4"), data[at].astype("f8")]
        names = ["path", "point_id", "x", "y", "z", "component", "value"]
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(at)), *map(pa.array, cols)], names=names)


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def cvol_blocks(path: str, head: bytes | memoryview, size: int) -> list[Block]:
    """The one block of a cvol file of ``size`` bytes that begins with ``head``."""
    if len(head) < CVOL_BYTES or bytes(head[:4]) != b"cvol":
        raise ValueError(f"{path} is no cvol file")
    _, xs, ys, zs, _, _, _, kind, _ = struct.unpack(CVOL, head[:CVOL_BYTES])
    if not 0 <= kind < len(CVOL_TYPES) or (size - CVOL_BYTES) % np.dtype(CVOL_TYPES[kind]).itemsize:
        raise ValueError(f"{path} has a type ({kind}) or size that cvol files don't have")
    return [Block(path, "Scalar Attribute", 0, 0, CVOL_BYTES, "<" + CVOL_TYPES[kind], (xs, ys, zs))]


def read_cvol(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The values of cvol files, as stored (integers are not scaled)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = memoryview(content.as_buffer())
                for b in cvol_blocks(path, raw, len(raw)):
                    yield from _batches(path, np.frombuffer(raw, b.kind, offset=b.offset), b.sizes, 1)

    return _files(spark, paths).mapInArrow(run, SCHEMA)


def _contents(df: DataFrame, sizes: tuple[int, int, int], encode: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(m, content): a file's bytes for each member; cells without a row are NaN.

    A member's grid is put together in one task, so its size is checked.
    """
    total = int(np.prod(sizes))
    if total * 4 > MOST_BYTES:
        raise ValueError(f"a grid of {total} cells is larger than {MOST_BYTES} bytes")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        grid = np.full(total, np.nan, "<f4")
        grid[rows["point_id"].to_numpy()] = rows["value"].to_numpy()
        return pd.DataFrame({"m": [rows["m"].iloc[0]], "content": [encode(grid)]})

    return df.select(F.col("m").cast("int"), "point_id", "value").groupBy("m").applyInPandas(run, "m int, content binary")


def cvol_contents(df: DataFrame, sizes: tuple[int, int, int], voxel: tuple = (1.0, 1.0, 1.0)) -> DataFrame:
    """(m, content): the bytes of a cvol file of floats for each member; cells without a row are NaN."""
    head = struct.pack(CVOL, b"cvol", *sizes, *voxel, CVOL_TYPES.index("f4"), 0)
    return _contents(df, sizes, lambda grid: head + grid.tobytes())


def dat_entries(text: str) -> dict[str, str]:
    """The ``key: value`` lines of a .dat file; keys in lower case, the first of equal ones counts."""
    found: dict[str, str] = {}
    for line in filter(str.strip, re.split("[\r\n]", text)):
        key, colon, value = line.partition(":")
        if not colon or ":" in value:
            raise ValueError(f"no entry of a .dat file: {line}")
        found.setdefault(key.strip().lower(), value.strip())
    return found


def expanded(pattern: str, start: int, stop: int, step: int = 1, inclusive: bool = False) -> list[tuple[int, str]]:
    """(index, file name) of a printf pattern for start, start + step, ... below stop, or up to it."""
    return [(k, pattern % k) for k in range(start, stop + inclusive, step)]


def dat_files(path: str, text: str) -> tuple[str, int, tuple[int, int, int], list[tuple[str, int]]]:
    """(type, components, sizes, [(raw file, t)]) of a .dat file's text; t is the index in ObjectIndices (start, stop included, step)."""
    said = dat_entries(text)
    sizes = tuple(int(x) for x in said["resolution"].split())
    kind, components = DAT_FORMATS[said["format"].lower()]
    files = [(0, said["objectfilename"])]
    if "objectindices" in said:
        files = expanded(files[0][1], *map(int, said["objectindices"].split()), inclusive=True)
    if not files:
        raise ValueError(f"{path} names no file")
    folder = path.rpartition("/")[0]
    return kind, components, sizes, [(posixpath.normpath(f"{folder}/{n}") if "://" not in folder else f"{folder}/{n}", t) for t, n in files]


def read_dat(spark: SparkSession, path: str, byte_order: str = "<") -> DataFrame:
    """The raw files that a .dat file names, with ``t``, the index of a file in ObjectIndices."""
    kind, components, sizes, files = dat_files(path, spark.read.text(path, wholetext=True).first()[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = memoryview(content.as_buffer())
                if len(raw) % np.dtype(kind).itemsize:
                    raise ValueError(f"{at} holds {len(raw)} bytes, no whole number of values are announced")
                # Spark names a file by its whole path: the longest name that this ends with is the file's
                t = max((len(n), t) for n, t in files if f"/{at}".endswith(f"/{n.lstrip('/')}"))[1]
                for rows in _batches(at, np.frombuffer(raw, byte_order + kind), sizes, components):
                    yield rows.append_column("t", pa.array(np.full(rows.num_rows, t, "i4")))

    return _files(spark, [n for n, _ in files]).mapInArrow(run, f"{SCHEMA}, t int")


def written_files(df: DataFrame, folder: str, sizes: tuple[int, int, int], ending: str, encode: Callable[[np.ndarray], bytes]) -> None:
    """A file ``<m>.<ending>`` for each member, in a folder that all executors share.

    A file is written under another name and then renamed, so a task that is
    run again replaces what it left.
    """

    def put(rows: Iterator) -> None:
        for r in rows:
            place = os.path.join(folder, f"{r['m']}.{ending}")
            part = f"{place}.{uuid.uuid4().hex}"
            with open(part, "wb") as out:
                out.write(bytes(r["content"]))
            os.replace(part, place)

    _contents(df, sizes, encode).foreachPartition(put)


def write_cvol(df: DataFrame, folder: str, sizes: tuple[int, int, int], voxel: tuple = (1.0, 1.0, 1.0)) -> None:
    """A file ``<m>.cvol`` for each member, in a folder that all executors share."""
    head = struct.pack(CVOL, b"cvol", *sizes, *voxel, CVOL_TYPES.index("f4"), 0)
    written_files(df, folder, sizes, "cvol", lambda grid: head + grid.tobytes())
