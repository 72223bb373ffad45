"""More volume files, as rows of (path, variable, t, e, point_id, x, y, z, component, value).

Formats that need no library: NIfTI, MetaImage, VTK legacy, GrADS ctl, field
and RBC bin. Headers that are files of their own are read in the driver, data
by Spark's binaryFile source: a file is one task's work, whose values leave in
Arrow batches of bounded size. Malformed files are refused.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridlark.sources.blocks import Block
from gridlark.sources.volumes import CHUNK

SCHEMA = "path string, variable string, t int, e int, point_id long, x int, y int, z int, component int, value double"
NAMES = ["path", "variable", "t", "e", "point_id", "x", "y", "z", "component", "value"]
# Data type codes of NIfTI, element types of MetaImage, types of VTK, the grid of RBC files,
# the name of fields of a format without names.
NIFTI_TYPES = {2: "u1", 4: "i2", 16: "f4", 64: "f8"}
META_TYPES = {"MET_FLOAT": "f4", "MET_UCHAR": "u1", "MET_USHORT": "u2", "MET_FLOAT16": "f2", "MET_HALF": "f2"}
VTK_TYPES = {"float": "f4", "double": "f8", "unsigned_char": "u1", "char": "i1", "short": "i2", "unsigned_short": "u2", "int": "i4"}
RBC_SIZES = (1024, 32, 1024)
ATTRIBUTE = "Scalar Attribute"

#: What a decoder yields: variable, t, e, values (components interleaved), sizes, components.
Part = tuple[str, int, int, np.ndarray, tuple[int, int, int], int]


def _rows(path: str, part: Part) -> Iterator[pa.RecordBatch]:
    variable, t, e, data, (xs, ys, zs), components = part
    total = xs * ys * zs * components
    if len(data) != total:
        raise ValueError(f"{path} holds {len(data)} values of {variable}, {total} are announced")
    for first in range(0, total, CHUNK):
        at = np.arange(first, min(first + CHUNK, total))
        p = at // components
        fixed = [pa.array([path] * len(at)), pa.array([variable] * len(at)), pa.array(np.full(len(at), t, "i4")), pa.array(np.full(len(at), e, "i4"))]
        places = [p, (p % xs).astype("i4"), (p // xs % ys).astype("i4"), (p // (xs * ys)).astype("i4"), (at % components).astype("i4")]
        yield pa.RecordBatch.from_arrays([*fixed, *map(pa.array, places), pa.array(data[first : first + len(at)].astype("f8"))], names=NAMES)


def _read(spark: SparkSession, paths: str | list[str], decode: Callable[[str, memoryview], Iterator[Part]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part in decode(path, memoryview(content.as_buffer())):
                    yield from _rows(path, part)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, SCHEMA)


def _values(path: str, raw: memoryview, kind: str) -> np.ndarray:
    if len(raw) % np.dtype(kind).itemsize:
        raise ValueError(f"{path} holds {len(raw)} bytes of data, no whole number of values")
    return np.frombuffer(raw, kind)


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def _beside(path: str, name: str) -> str:
    return name if name.startswith("/") or "://" in name else f"{path.rpartition('/')[0]}/{name}"


def nifti_blocks(path: str, head: bytes | memoryview, size: int) -> list[Block]:
    """A block for each time step of a NIfTI-1 file of ``size`` bytes that begins with ``head``."""
    order = next((o for o in "<>" if len(head) >= 348 and struct.unpack_from(f"{o}i", head)[0] == 348), None)
    if order is None or bytes(head[344:347]) != b"n+1":
        raise ValueError(f"{path} is no NIfTI-1 file in one piece")
    dims = struct.unpack_from(f"{order}8h", head, 40)
    code = struct.unpack_from(f"{order}h", head, 70)[0]
    if code not in NIFTI_TYPES or not 1 <= dims[0] <= 4:
        raise ValueError(f"{path} has data of type {code} in {dims[0]} dimensions, which isn't supported")
    xs, ys, zs, ts = (max(d, 1) if k < dims[0] else 1 for k, d in enumerate(dims[1:5]))
    start = int(struct.unpack_from(f"{order}f", head, 108)[0])
    name = path.rpartition("/")[2].lower()
    # What the file's name says of its variable.
    variable = "Density" if "volume" in name else "Labels" if "label" in name else "Scalar"
    one = Block(path, variable, 0, 0, start, order + NIFTI_TYPES[code], (xs, ys, zs))
    if (size - start) % np.dtype(one.kind).itemsize:
        raise ValueError(f"{path} holds {size - start} bytes of data, no whole number of values")
    if start + one.nbytes * ts > size:
        raise ValueError(f"{path} holds {(size - start) // np.dtype(one.kind).itemsize} values, {one.values * ts} are announced")
    return [replace(one, t=t, offset=start + t * one.nbytes) for t in range(ts)]


def read_nifti(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """NIfTI-1 files in one piece; volumes of a fourth dimension are time steps."""

    def decode(path: str, raw: memoryview) -> Iterator[Part]:
        for b in nifti_blocks(path, raw, len(raw)):
            yield b.variable, b.t, b.e, np.frombuffer(raw, b.kind, b.values, b.offset), b.sizes, 1

    return _read(spark, paths, decode)


def meta_entries(text: str) -> dict[str, str]:
    """The ``key = value`` lines of a MetaImage header."""
    found: dict[str, str] = {}
    for line in filter(str.strip, re.split("[\r\n]", text)):
        parts = line.split("=")
        if len(parts) != 2:
            raise ValueError(f"no entry of a MetaImage header: {line}")
        found.setdefault(parts[0].strip(), parts[1].strip())
    return found


def meta_image(path: str, text: str) -> tuple[str, tuple[int, int, int], str]:
    """(type, sizes, data file) of a MetaImage header."""
    said = meta_entries(text)
    for key, only in (("ObjectType", "Image"), ("NDims", "3"), ("BinaryData", "True"), ("BinaryDataByteOrderMSB", "False")):
        if said.get(key, only) != only:
            raise ValueError(f"{path}: {key} is {said[key]}, only {only} is supported")
    sizes = tuple(int(v) for v in said["DimSize"].split())
    kind = META_TYPES.get(said["ElementType"])
    if kind is None or len(sizes) != 3:
        raise ValueError(f"{path}: {said['ElementType']} in {len(sizes)} dimensions isn't supported")
    return "<" + kind, sizes, _beside(path, said["ElementDataFile"])


def read_meta_image(spark: SparkSession, path: str) -> DataFrame:
    """The data file of a MetaImage header (.mhd)."""
    kind, sizes, name = meta_image(path, _text(spark, path))
    return _read(spark, name, lambda p, raw: iter([(ATTRIBUTE, 0, 0, _values(p, raw, kind), sizes, 1)]))


def _vtk(path: str, raw: memoryview) -> Iterator[Part]:
    data, at = bytes(raw), 0

    def line() -> str | None:
        nonlocal at
        while at < len(data):
            end = data.find(b"\n", at)
            end = len(data) if end < 0 else end
            found, at = data[at:end].decode("latin-1").strip(), end + 1
            if found:
                return found
        return None

    if not (line() or "").startswith("# vtk DataFile"):
        raise ValueError(f"{path} is no legacy VTK file")
    line()
    mode, sizes, count = line(), None, 0
    if mode not in ("ASCII", "BINARY"):
        raise ValueError(f"{path} is neither ASCII nor BINARY")
    pending, components, kind, said = None, 1, None, line()
    while said is not None:
        words = said.split()
        if words[0] == "DATASET" and words[1] not in ("STRUCTURED_POINTS", "STRUCTURED_GRID", "RECTILINEAR_GRID"):
            raise ValueError(f"{path} holds {words[1]}, only structured grids are supported")
        if words[0] == "DIMENSIONS":
            sizes = tuple(int(v) for v in words[1:4])
        elif words[0] == "POINT_DATA":
            count = int(words[1])
            if sizes is None or count != int(np.prod(sizes)):
                raise ValueError(f"{path} announces {count} points for a grid of {sizes}")
        elif words[0] in ("POINTS", "X_COORDINATES", "Y_COORDINATES", "Z_COORDINATES"):
            pending, kind, components, count_here = None, words[2], (3 if words[0] == "POINTS" else 1), int(words[1])
            _, at = _vtk_values(path, data, at, mode, kind, count_here * components)
        elif words[0] == "SCALARS":
            pending, kind, components = words[1], words[2], int(words[3]) if len(words) > 3 else 1
            place = at
            if not (line() or "").startswith("LOOKUP_TABLE"):
                at = place
            values, at = _vtk_values(path, data, at, mode, kind, count * components)
            yield pending, 0, 0, values, sizes, components
        elif words[0] == "VECTORS":
            values, at = _vtk_values(path, data, at, mode, words[2], count * 3)
            yield words[1], 0, 0, values, sizes, 3
        elif words[0] not in ("DATASET", "SPACING", "ORIGIN", "ASPECT_RATIO", "METADATA"):
            raise ValueError(f"{path}: unknown statement {words[0]}")
        said = line()


def _vtk_values(path: str, data: bytes, at: int, mode: str, kind: str, count: int) -> tuple[np.ndarray, int]:
    if kind not in VTK_TYPES:
        raise ValueError(f"{path}: unknown type {kind}")
    if mode == "BINARY":
        size = np.dtype(VTK_TYPES[kind]).itemsize * count
        if at + size > len(data):
            raise ValueError(f"{path} ended before its values could be read")
        return np.frombuffer(data[at : at + size], ">" + VTK_TYPES[kind]), at + size
    found: list[float] = []
    while len(found) < count:
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        if at >= len(data):
            raise ValueError(f"{path} ended before its values could be read")
        found += map(float, data[at:end].split())
        at = end + 1
    return np.array(found[: count + 1] if len(found) > count else found), at


def read_vtk(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Legacy VTK files of structured grids, ASCII or binary, with scalars and vectors."""
    return _read(spark, paths, _vtk)


def ctl_header(text: str) -> dict:
    """What a GrADS descriptor says: data file, byte order, fill value, axes with their places, variables with their levels."""
    found: dict = {"order": "<", "fill": None, "axes": {}, "variables": []}
    lines = iter([x for x in re.split("[\r\n]+", text) if x.strip() and not x.startswith("*")])
    for row in lines:
        words = row.split()
        key = words[0].lower()
        if len(words) < 2:
            raise ValueError(f"{key} wants more words")
        if key == "dset":
            found["dset"] = words[1].removeprefix("^")
        elif key == "options":
            option = words[1].lower()
            if option == "sequential":
                raise ValueError("sequential files are not supported")
            found["order"] = {"big_endian": ">", "little_endian": "<"}.get(option, found["order"])
        elif key == "undef":
            found["fill"] = float(words[1])
        elif key in ("xdef", "ydef", "zdef", "tdef", "edef"):
            n, kind = int(words[1]), words[2].lower()
            if kind == "linear" and key == "tdef":
                places = list(map(float, range(n)))
            elif kind == "linear":
                places = [float(words[3]) + float(words[4]) * k for k in range(n)]
            elif kind == "levels":
                places = list(map(float, words[3:]))
                while len(places) < n:
                    places += map(float, next(lines, "missing").split())
            else:
                raise ValueError(f"{key} has an unknown kind {kind}")
            if len(places) != n:
                raise ValueError(f"{key} names {len(places)} places, {n} are announced")
            found["axes"][key[0]] = places
        elif key == "vars":
            for _ in range(int(words[1])):
                variable = next(lines, "endvars").split()
                if variable[0].lower() == "endvars":
                    raise ValueError("fewer variables than announced")
                found["variables"].append((variable[0], max(int(variable[1]), 1)))
            if next(lines, "").strip().lower() != "endvars":
                raise ValueError("more variables than announced")
    if "dset" not in found or not {"x", "y", "z"} <= set(found["axes"]):
        raise ValueError("dset, xdef, ydef and zdef must be there")
    return found


def read_ctl(spark: SparkSession, path: str) -> DataFrame:
    """The data file of a GrADS descriptor: variables of floats, for each time step of each member; flat ones fill all levels."""
    said = ctl_header(_text(spark, path))
    xs, ys, zs, ts, es = (len(said["axes"].get(a, [0])) for a in "xyzte")
    flat, fill, variables, order = xs * ys, said["fill"], said["variables"], said["order"]
    if any(levels not in (1, zs) for _, levels in variables):
        raise ValueError(f"{path}: a variable has neither one level nor all {zs}")

    def decode(at: str, raw: memoryview) -> Iterator[Part]:
        data = _values(at, raw, order + "f4")
        total = flat * sum(levels for _, levels in variables) * ts * es
        if len(data) != total:
            raise ValueError(f"{at} holds {len(data)} values, {total} are announced")
        start = 0
        for e in range(es):
            for t in range(ts):
                for name, levels in variables:
                    part = data[start : start + flat * levels].astype("f4")
                    start += flat * levels
                    if fill is not None:
                        part[part == np.float32(fill)] = np.nan
                    yield name, t, e, np.tile(part, zs // levels), (xs, ys, zs), 1

    return _read(spark, _beside(path, said["dset"]), decode)


def _with_scalar(variable: str, data: np.ndarray, sizes: tuple, components: int) -> Iterator[Part]:
    """A vector field, and the scalar that may be interleaved with it."""
    rows = data.reshape(-1, components)
    yield "Velocity", 0, 0, rows[:, :3].ravel(), sizes, 3
    if components == 4:
        yield variable, 0, 0, rows[:, 3].ravel(), sizes, 1


def read_field(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """.field files: vectors of floats or half floats, with a scalar where there are four numbers a point."""

    def decode(path: str, raw: memoryview) -> Iterator[Part]:
        name = path.rpartition("/")[2].lower()
        short = "uvwp" in name
        if len(raw) < 24:
            raise ValueError(f"{path} is no .field file")
        xs, ys, zs, dims, _, kind = struct.unpack_from("<6I", raw)
        if short:
            dims, kind = 3, 0
        if dims != 3 or kind not in (0, 1):
            raise ValueError(f"{path} has {dims} dimensions and field type {kind}, which isn't supported")
        data = _values(path, raw[12 if short else 24 :], ("<f4", "<f2")[kind])
        components, rest = divmod(len(data), xs * ys * zs)
        if rest or components not in (3, 4):
            raise ValueError(f"{path} holds {len(data)} values for {xs * ys * zs} points")
        variable = "Field Strength" if "borromean" in name or "magnet" in name else "Pressure" if short else "Scalar Attribute"
        yield from _with_scalar(variable, data, (xs, ys, zs), components)

    return _read(spark, paths, decode)


def read_rbc(spark: SparkSession, paths: str | list[str], sizes: tuple[int, int, int] = RBC_SIZES) -> DataFrame:
    """Convection files without a header: velocity and temperature interleaved, on a fixed grid."""

    def decode(path: str, raw: memoryview) -> Iterator[Part]:
        data = _values(path, raw, "<f4")
        if len(data) != 4 * int(np.prod(sizes)):
            raise ValueError(f"{path} holds {len(data)} values, {4 * int(np.prod(sizes))} are announced")
        yield from _with_scalar("Temperature", data, sizes, 4)

    return _read(spark, paths, decode)


READERS = {"nii": read_nifti, "mhd": read_meta_image, "vtk": read_vtk, "ctl": read_ctl, "field": read_field, "bin": read_rbc}
