"""Volume files read by slabs: partitions are byte ranges, planned from the headers.

A Spark data source for files whose values lie in the file as they are: cvol,
dat/raw, MetaImage, NIfTI and classic NetCDF. A file of any size is many
tasks' work, and filters on x, y, z, t, e and variable are pushed into the
plan, so a box reads the bytes of its lines and no others. Headers are read by
the driver, values by the tasks, both through pyarrow's file systems: local or
shared folders, and the object stores and HDFS that pyarrow was built for.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from gridlark.sources import formats, stores, volumes
from gridlark.sources.blocks import Block

#: Bytes of a partition, of a part of a line that is worth leaving out, and of a header at first.
MOST, GAP, HEADER = 1 << 25, 1 << 16, 1 << 16


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _bytes(path: str, first: int, n: int) -> bytes:
    system, at = _opened(path)
    with system.open_input_file(at) as f:
        return f.read_at(n, first)


def _size(path: str) -> int:
    system, at = _opened(path)
    info = system.get_file_info(at)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def _nc_header(path: str) -> tuple[stores.NetcdfHeader, int]:
    total, n = _size(path), HEADER
    while True:
        try:
            return stores.NetcdfHeader(path, memoryview(_bytes(path, 0, n))), total
        except ValueError:
            if n >= total:
                raise
            n *= 8  # a header that is longer than what was read


def _nc_blocks(path: str) -> list[Block]:
    head, total = _nc_header(path)
    return list(head.blocks(total))


def _series_blocks(path: str) -> list[Block]:
    head, total = _nc_header(path)
    return [head.series(total)]


def _mhd_blocks(path: str) -> list[Block]:
    kind, sizes, name = formats.meta_image(path, _bytes(path, 0, _size(path)).decode())
    return [Block(name, formats.ATTRIBUTE, 0, 0, 0, kind, sizes)]


def _dat_blocks(path: str) -> list[Block]:
    kind, components, sizes, files = volumes.dat_files(path, _bytes(path, 0, _size(path)).decode())
    return [Block(name, formats.ATTRIBUTE, t, 0, 0, "<" + kind, sizes, components) for name, t in files]


LAYOUTS = {
    "cvol": lambda path: volumes.cvol_blocks(path, _bytes(path, 0, volumes.CVOL_BYTES), _size(path)),
    "nii": lambda path: formats.nifti_blocks(path, _bytes(path, 0, 352), _size(path)),
    "mhd": _mhd_blocks,
    "dat": _dat_blocks,
    "nc": _nc_blocks,
    "series": _series_blocks,
}


def layout(path: str, kind: str | None = None) -> list[Block]:
    """The blocks of a file by its kind, the ending of its name by default; each is checked to lie within its file, or to be all of it."""
    found = LAYOUTS[kind or path.rpartition(".")[2].lower()](path)
    for b in found:
        size = _size(b.path)
        whole = path.lower().endswith((".dat", ".mhd", ".cvol"))
        if b.offset + b.nbytes > size or whole and b.offset + b.nbytes != size:
            raise ValueError(f"{b.path} holds {size} bytes, {b.offset + b.nbytes} are announced")
    return found


@dataclass
class Slab(ds.InputPartition):
    """A box (half-open) of a block."""

    block: Block
    low: tuple[int, int, int]
    high: tuple[int, int, int]

    def reads(self) -> Iterator[tuple[int, int, tuple[int, int, int], int]]:
        """(first byte, bytes, (x, y, z) of the first value, points): runs that are read at once.

        Whole planes are one run; a box across lines is one run for each plane,
        the rest of its lines included, unless that is GAP bytes a line or more.
        """
        (x0, y0, z0), (x1, y1, z1) = self.low, self.high
        xs, ys, _ = self.block.sizes
        point = self.block.components * np.dtype(self.block.kind).itemsize
        run = lambda x, y, z, n: (self.block.offset + ((z * ys + y) * xs + x) * point, n * point, (x, y, z), n)
        if (xs - (x1 - x0)) * point >= GAP:
            yield from (run(x0, y, z, x1 - x0) for z in range(z0, z1) for y in range(y0, y1))
        elif (x0, y0, x1, y1) == (0, 0, xs, ys):
            yield run(0, 0, z0, (z1 - z0) * xs * ys)
        else:
            yield from (run(x0, y0, z, (y1 - y0 - 1) * xs + x1 - x0) for z in range(z0, z1))


def planned(block: Block, low: tuple, high: tuple, most: int = MOST) -> Iterator[Slab]:
    """The part of a block in a box (half-open), as slabs of about ``most`` bytes at the most."""
    low = tuple(max(0, v) for v in low)
    high = tuple(min(v, n) for v, n in zip(high, block.sizes))
    (x0, y0, z0), (x1, y1, z1) = low, high
    if x0 >= x1 or y0 >= y1 or z0 >= z1:
        return
    point = block.components * np.dtype(block.kind).itemsize
    line = (x1 - x0) * point if (block.sizes[0] - (x1 - x0)) * point >= GAP else block.sizes[0] * point
    lines = max(1, most // line)
    dz, dy = max(1, lines // (y1 - y0)), min(lines, y1 - y0)
    dx = x1 - x0 if line <= most else max(1, most // point)
    for z in range(z0, z1, dz):
        for y in range(y0, y1, dy):
            for x in range(x0, x1, dx):
                yield Slab(block, (x, y, z), (min(x + dx, x1), min(y + dy, y1), min(z + dz, z1)))


class _Bounds:
    """What pushed filters leave of the whole numbers x, y, z, t, e and of the variables; bounds are inclusive."""

    def __init__(self) -> None:
        self.low = dict.fromkeys(("x", "y", "z", "t", "e"), -(1 << 62))
        self.high = dict.fromkeys(self.low, 1 << 62)
        self.variables: set[str] | None = None

    def take(self, f: ds.Filter) -> None:
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if column == "variable" and isinstance(f, ds.EqualTo | ds.In):
            named = {f.value} if isinstance(f, ds.EqualTo) else set(f.value)
            self.variables = named if self.variables is None else self.variables & named
        if column not in self.low:
            return
        if isinstance(f, ds.EqualTo | ds.GreaterThanOrEqual):
            self.low[column] = max(self.low[column], f.value)
        if isinstance(f, ds.EqualTo | ds.LessThanOrEqual):
            self.high[column] = min(self.high[column], f.value)
        if isinstance(f, ds.GreaterThan):
            self.low[column] = max(self.low[column], f.value + 1)
        if isinstance(f, ds.LessThan):
            self.high[column] = min(self.high[column], f.value - 1)
        if isinstance(f, ds.In) and f.value:
            self.low[column] = max(self.low[column], min(f.value))
            self.high[column] = min(self.high[column], max(f.value))

    def has(self, block: Block) -> bool:
        named = self.variables is None or block.variable in self.variables
        return named and all(self.low[c] <= v <= self.high[c] for c, v in (("t", block.t), ("e", block.e)))

    def slabs(self, block: Block) -> Iterator[Slab]:
        if self.has(block):
            yield from planned(block, tuple(self.low[a] for a in "xyz"), tuple(self.high[a] + 1 for a in "xyz"))


def _rows(slab: Slab, first: tuple[int, int, int], values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of one run; what it read beside the slab's lines is left out."""
    b = slab.block
    xs, ys, _ = b.sizes
    start = (first[2] * ys + first[1]) * xs + first[0]
    for at in range(0, len(values), volumes.CHUNK):
        part = values[at : at + volumes.CHUNK]
        place = np.arange(at, at + len(part))
        p = start + place // b.components
        x, y, z = p % xs, p // xs % ys, p // (xs * ys)
        keep = (x >= slab.low[0]) & (x < slab.high[0])
        part = part.astype("f8")
        for fill in b.fills:
            part[part == fill] = np.nan
        n = int(keep.sum())
        fixed = [pa.array([v] * n) for v in (b.path, b.variable)] + [pa.array(np.full(n, v, "i4")) for v in (b.t, b.e)]
        places = [p[keep], *(c[keep].astype("i4") for c in (x, y, z, place % b.components))]
        yield pa.RecordBatch.from_arrays([*fixed, *map(pa.array, places), pa.array(part[keep])], names=formats.NAMES)


class _Reader(ds.DataSourceReader):
    def __init__(self, files: list[tuple[str, int | None, int | None]], kind: str | None = None):
        self.files, self.kind, self.bounds = files, kind, _Bounds()

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            self.bounds.take(f)
            yield f  # Spark tests the rows that are left again

    def partitions(self) -> list[Slab]:
        with ThreadPoolExecutor(16) as pool:
            found = pool.map(layout, [path for path, _, _ in self.files], [self.kind] * len(self.files))
            named = lambda b, t, e: replace(b, t=b.t if t is None else t, e=b.e if e is None else e)
            blocks = [named(b, t, e) for (_, t, e), each in zip(self.files, found) for b in each]
        return list(chain.from_iterable(map(self.bounds.slabs, blocks)))

    def read(self, slab: Slab | None) -> Iterator[pa.RecordBatch]:
        if slab is None:  # a plan without slabs
            return
        system, at = _opened(slab.block.path)
        with system.open_input_file(at) as f:
            for first, n, place, _ in slab.reads():
                yield from _rows(slab, place, np.frombuffer(f.read_at(n, first), slab.block.kind))


class VolumeSource(ds.DataSource):
    """``files``: a JSON list of [path, t, e]; t and e are null where the file says them. ``kind``: a layout other than that of the files' ending."""

    @classmethod
    def name(cls) -> str:
        return "gridlark_volume"

    def schema(self) -> str:
        return formats.SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader([tuple(f) for f in json.loads(self.options["files"])], self.options.get("kind"))


#: Schemes of the stores that pyarrow reads.
SCHEMES = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")


def readable(path: str) -> bool:
    """Whether the file is of a kind, and in a store, that this source reads."""
    scheme = path.partition("://")[0] if "://" in path else "file"
    return scheme in SCHEMES and path.rpartition(".")[2].lower() in LAYOUTS


def read_slabs(spark: SparkSession, files: str | list) -> DataFrame:
    """The rows (see formats) of files that are paths, or (path, t, e) with the step and member that a file stands for."""
    files = [files] if isinstance(files, str) else files
    said = [[f, None, None] if isinstance(f, str) else list(f) for f in files]
    for path, _, _ in said:
        if not readable(path):
            raise ValueError(f"{path}: files of this kind or store aren't read by slabs")
    return _load(spark, files=json.dumps(said))


def _load(spark: SparkSession, **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VolumeSource)
    return spark.read.format("gridlark_volume").options(**options).load()


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """(sidx, t, w, value) of a NetCDF file of time series: the first variable of floats over samples, time and maybe a window.

    w is the place in the window, 0 without one; fill values are NaN. Long
    files are many tasks' work.
    """
    df = _load(spark, files=json.dumps([[path, None, None]]), kind="series")
    return df.select(*[F.col(c).alias(n) for c, n in (("z", "sidx"), ("y", "t"), ("x", "w"))], "value")
