"""GRIB files of edition 2: fields on pressure levels and regular grids of longitude and latitude, in simple packing.

Messages are found by their lengths, a file in each task, which reads headers
only. Each field is then read and unpacked on its own, wherever there is room;
levels and dates become places along z and t by joins with the tables of all
that occur. Files are read through pyarrow's file systems (see slabs).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlark.session import bounded, checkpointed
from gridlark.sources import slabs
from gridlark.sources.formats import NAMES
from gridlark.sources.volumes import CHUNK

# Names of parameters by discipline, category and number, and codes of what is read.
PARAMETERS = {
    (0, 0, 0): "t", (0, 0, 2): "pt", (0, 1, 0): "q", (0, 1, 1): "r", (0, 2, 2): "u", (0, 2, 3): "v", (0, 2, 8): "w",
    (0, 2, 12): "vo", (0, 2, 13): "d", (0, 3, 4): "z", (0, 3, 5): "gh",
}
ISOBARIC, REGULAR, SIMPLE, NO_BITMAP, BITMAP = 100, 0, 0, 255, 0
ENSEMBLE_PRODUCTS, PRODUCTS = (1, 11), (0, 1, 8, 11)
ENDINGS = ("grib", "grib2", "grb", "grb2")
_INDEX = (
    "path string, variable string, date int, time int, e int, level double, xs int, ys int, reference double, binary int, decimal int, "
    "bits int, count long, bitmap long, data long, size long"
)


def _signed(raw: bytes) -> int:
    """A whole number whose first bit is its sign."""
    v = int.from_bytes(raw)
    top = 1 << (8 * len(raw) - 1)
    return -(v - top) if v >= top else v


def _level(body: bytes) -> float:
    """The pressure of a product's first surface in hPa."""
    if body[17] != ISOBARIC:
        raise ValueError(f"levels of type {body[17]}, only pressure levels ({ISOBARIC}) are supported")
    return int.from_bytes(body[19:23]) / 10.0 ** _signed(body[18:19]) / 100


def fields(path: str, opened, size: int) -> Iterator[tuple]:
    """A row of the index for each field; ``opened`` has read_at(n, first). Bodies of sections begin after length and number."""
    at = 0
    while at < size:
        head = opened.read_at(16, at)
        if len(head) < 16 or head[:4] != b"GRIB":
            raise ValueError(f"{path}: no message begins at byte {at}")
        if head[7] != 2:
            raise ValueError(f"{path}: edition {head[7]}, only edition 2 is supported")
        discipline, end = head[6], at + int.from_bytes(head[8:16])
        if end > size:
            raise ValueError(f"{path} ends within a message")
        date = grid = product = packing = bitmap = None
        at += 16
        while at < end - 4:
            start = opened.read_at(5, at)
            length, number = int.from_bytes(start[:4]), start[4]
            if length < 5 or at + length > end - 4:
                raise ValueError(f"{path}: section {number} at byte {at} is longer than its message")
            # data and bitmaps stay where they are
            body = opened.read_at(min(length - 5, 1 if number == 6 else 0 if number == 7 else length), at + 5)
            if number == 1:
                year, month, day, hour, minute = struct.unpack_from(">H4B", body, 7)
                date = (year * 10000 + month * 100 + day, hour * 100 + minute)
            elif number == 3:
                template = int.from_bytes(body[7:9])
                if template != REGULAR:
                    raise ValueError(f"{path}: grid template {template}, only regular grids ({REGULAR}) are supported")
                xs, ys = struct.unpack_from(">II", body, 25)
                if xs * ys != int.from_bytes(body[1:5]) or body[66] & 0x30:
                    raise ValueError(f"{path}: a grid of {xs} by {ys} has another number of points, or an order that isn't supported")
                grid = (xs, ys)
            elif number == 4:
                template = int.from_bytes(body[2:4])
                if template not in PRODUCTS:
                    raise ValueError(f"{path}: product template {template} isn't supported")
                code = (discipline, body[4], body[5])
                member = body[30] if template in ENSEMBLE_PRODUCTS else 0
                product = (PARAMETERS.get(code, ".".join(map(str, code))), _level(body), member)
            elif number == 5:
                count, template = struct.unpack_from(">IH", body)
                if template != SIMPLE:
                    raise ValueError(f"{path}: packing template {template}, only simple packing ({SIMPLE}) is supported")
                packing = (struct.unpack_from(">f", body, 6)[0], _signed(body[10:12]), _signed(body[12:14]), body[14], count)
            elif number == 6:
                if body[0] not in (NO_BITMAP, BITMAP):
                    raise ValueError(f"{path}: bitmaps of kind {body[0]} aren't supported")
                bitmap = at + 6 if body[0] == BITMAP else -1
            elif number == 7:
                if None in (date, grid, product, packing, bitmap):
                    raise ValueError(f"{path}: data at byte {at} without the sections that tell what they are")
                if grid[0] * grid[1] != packing[4] and bitmap < 0 or (packing[4] * packing[3] + 7) // 8 > length - 5:
                    raise ValueError(f"{path}: data at byte {at} hold fewer values than are announced")
                yield (path, product[0], *date, product[2], product[1], *grid, *packing, bitmap, at + 5, length - 5)
            at += length
        if opened.read_at(4, end - 4) != b"7777":
            raise ValueError(f"{path}: a message ends without its mark")
        at = end


def unpacked(raw: bytes, bits: int, count: int) -> np.ndarray:
    """``count`` whole numbers of ``bits`` bits, the highest first."""
    if bits == 0:
        return np.zeros(count)
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f">u{bits // 8}", count).astype("f8")
    weights = 2.0 ** np.arange(bits - 1, -1, -1)
    parts = []
    step = 8 * max(1, CHUNK // 8)  # whole bytes
    for first in range(0, count, step):
        n = min(step, count - first)
        part = np.frombuffer(raw, np.uint8, (n * bits + 7) // 8, first * bits // 8)
        parts.append(np.unpackbits(part)[: n * bits].reshape(n, bits) @ weights)
    return np.concatenate(parts) if parts else np.zeros(0)


def _indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [part.split()[0] for part in _INDEX.split(", ")]
    for batch in batches:
        for path in batch["path"]:
            system, at = slabs._opened(path)
            with system.open_input_file(at) as f:
                rows = list(fields(path, f, f.size()))
            yield pd.DataFrame(rows, columns=names)


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            system, at = slabs._opened(r["path"])
            with system.open_input_file(at) as f:
                raw = f.read_at(r["size"], r["data"])
                total = r["xs"] * r["ys"]
                marks = np.unpackbits(np.frombuffer(f.read_at((total + 7) // 8, r["bitmap"]), np.uint8))[:total].astype(bool) if r["bitmap"] >= 0 else np.ones(total, bool)
            if int(marks.sum()) != r["count"]:
                raise ValueError(f"{r['path']}: a bitmap marks {int(marks.sum())} values, {r['count']} are announced")
            value = np.full(total, np.nan)
            value[marks] = (r["reference"] + unpacked(raw, r["bits"], r["count"]) * 2.0 ** r["binary"]) / 10.0 ** r["decimal"]
            for first in range(0, total, CHUNK):
                p = np.arange(first, min(first + CHUNK, total))
                n = len(p)
                same = [pa.array([r[c]] * n) for c in ("path", "variable")] + [pa.array(np.full(n, r[c], "i4")) for c in ("t", "e", "z")]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(r["z"] * total + p), pa.array((p % r["xs"]).astype("i4")), pa.array((p // r["xs"]).astype("i4")), pa.array(value[p])],
                    names=["path", "variable", "t", "e", "z", "point_id", "x", "y", "value"],
                )


def read_grib(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The rows (see formats) of GRIB files: z counts the pressure levels of all files upwards from the smallest, t their dates and times.

    x and y follow the order of the message. Points that a bitmap leaves out
    are NaN. Every field must have one size.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 1000))
    index = checkpointed(files.mapInPandas(_indexed, _INDEX))
    shapes = index.select("xs", "ys").distinct().limit(2).count()
    if shapes > 1:
        raise ValueError("fields of different sizes can't be put together")
    # a row for each level, and for each date and time
    number = lambda cols, name: index.select(*cols).distinct().withColumn(name, F.row_number().over(Window.orderBy(*cols)) - 1)
    index = index.join(bounded(number(["level"], "z")), "level").join(bounded(number(["date", "time"], "t")), ["date", "time"])
    # a task for each field, as long as there are not too many
    parts = max(1, min(index.count(), 10_000))
    rows = index.repartition(parts).mapInArrow(_values, "path string, variable string, t int, e int, z int, point_id long, x int, y int, value double")
    return rows.withColumn("component", F.lit(0)).select(*NAMES)
