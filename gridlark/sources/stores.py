"""Self-describing volume files: VTK XML, AmiraMesh, NetCDF (classic) and Zarr (version 2).

Rows are those of formats. A VTK, AmiraMesh or NetCDF file is one task's work;
of a Zarr array each chunk is, so one array spreads over the cluster. NetCDF
files of the HDF5 kind, and chunks packed by Blosc or LZ4, need libraries that
this module does without; they are refused.
"""

from __future__ import annotations

import base64
import bz2
import gzip
import json
import lzma
import re
import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.sources.blocks import Block
from gridlark.sources.formats import NAMES, SCHEMA, Part, _read, _values
from gridlark.sources.volumes import CHUNK, written_files

# Number types of VTK XML, their headers, and types of NetCDF in order of their numbers from 1.
VTK_TYPES = {"Float32": "f4", "Float64": "f8"}
VTK_HEADERS = {"UInt32": "u4", "UInt64": "u8"}
NETCDF_TYPES = (">i1", "S1", ">i2", ">i4", ">f4", ">f8", ">u1", ">u2", ">u4", ">i8", ">u8")
NETCDF_LISTS = {"dimensions": 10, "variables": 11, "attributes": 12}
MEMBERS = ("ensemble", "member", "members")


def _appended(raw: memoryview) -> tuple[bytes, bytes]:
    """The XML of a file without its raw data section, and that section."""
    data = bytes(raw)
    start = re.search(rb'<AppendedData\s+encoding\s*=\s*"raw"\s*>\s*_?', data)
    if not start:
        return data, b""
    end = data.rfind(b"</AppendedData>")
    if end < start.end():
        raise ValueError("the appended data has no end")
    return data[: start.end()] + data[end:], data[start.end() : end]


def _base64_part(text: str, size: int) -> bytes:
    """The first ``size`` bytes that text encodes."""
    return base64.b64decode(text[: -(-size // 3) * 4])[:size]


def _vtk_array(source: bytes | str, header: str, packed: bool) -> bytes:
    """The bytes of an appended array, which source begins with."""
    wide = np.dtype(header).itemsize
    at = (lambda first, size: source[first : first + size]) if isinstance(source, bytes) else None

    def numbers(n: int) -> np.ndarray:
        return np.frombuffer(at(0, n * wide) if at else _base64_part(source, n * wide), header).astype("i8")

    if not packed:
        size = int(numbers(1)[0])
        return at(wide, size) if at else _base64_part(source, wide + size)[wide:]
    blocks = int(numbers(1)[0])
    sizes = numbers(3 + blocks)[3:]
    head = (3 + blocks) * wide
    # an encoded header of packed data is padded for itself
    body = at(head, int(sizes.sum())) if at else _base64_part(source[-(-head // 3) * 4 :], int(sizes.sum()))
    ends = np.cumsum(sizes)
    return b"".join(zlib.decompress(body[e - s : e]) for s, e in zip(sizes, ends))


def read_vtk_xml(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """VTK XML images and rectilinear grids of one piece, with appended data (raw or base64, zlib or not)."""

    def decode(path: str, raw: memoryview) -> Iterator[Part]:
        try:
            text, data = _appended(raw)
            root = ET.fromstring(text)
        except (ET.ParseError, ValueError) as e:
            raise ValueError(f"{path} is no VTK XML file: {e}") from e
        kind, packer = root.get("type"), root.get("compressor")
        grid = root.find(kind) if kind in ("ImageData", "RectilinearGrid") else None
        piece = grid.find("Piece") if grid is not None else None
        if root.tag != "VTKFile" or piece is None:
            raise ValueError(f"{path} holds no image and no rectilinear grid")
        if packer not in (None, "vtkZLibDataCompressor") or root.get("header_type", "UInt32") not in VTK_HEADERS:
            raise ValueError(f"{path}: compressor {packer} or the header type isn't supported")
        extent = [int(v) for v in grid.get("WholeExtent", "").split()]
        if len(extent) != 6 or piece.get("Extent", "").split() != grid.get("WholeExtent").split():
            raise ValueError(f"{path}: extents must have six numbers, and one piece the whole of them")
        order = "<" if root.get("byte_order", "LittleEndian") == "LittleEndian" else ">"
        fields = piece.find("PointData")
        points = 1 if fields is not None else 0
        fields = piece.find("CellData") if fields is None else fields
        if fields is None:
            raise ValueError(f"{path} has neither point nor cell data")
        xs, ys, zs = (extent[2 * k + 1] - extent[2 * k] + points for k in range(3))
        appended = root.find("AppendedData")
        if appended is None or appended.get("encoding") not in ("raw", "base64"):
            raise ValueError(f"{path}: appended data in raw or base64 must be there")
        coded = None if appended.get("encoding") == "raw" else re.sub(r"\s", "", appended.text or "").removeprefix("_")
        for field in fields.findall("DataArray"):
            name, form = field.get("Name"), VTK_TYPES.get(field.get("type", ""))
            if name is None or form is None or field.get("format") != "appended" or field.get("offset") is None:
                raise ValueError(f"{path}: array {name} isn't appended, or not of floats")
            first = int(field.get("offset"))
            body = _vtk_array(data[first:] if coded is None else coded[first:], order + VTK_HEADERS[root.get("header_type", "UInt32")], packer is not None)
            yield name, 0, 0, _values(path, memoryview(body), order + form), (xs, ys, zs), int(field.get("NumberOfComponents", 1))

    return _read(spark, paths, decode)


def read_amira_mesh(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """AmiraMesh files: a velocity of three floats on a uniform lattice."""

    def decode(path: str, raw: memoryview) -> Iterator[Part]:
        data = bytes(raw)
        start = re.search(rb"# Data section follows[^\n]*\n[^\n]*\n", data)
        head = data[: start.start()].decode("latin-1") if start else ""
        lattice = re.search(r"define Lattice[ \t]+([^\r\n]*)", head)
        sizes = tuple(int(v) for v in lattice[1].split()) if lattice else ()
        box = re.search(r"Parameters \{.*?BoundingBox ([^,]*),", head, re.S)
        if "# AmiraMesh BINARY-LITTLE-ENDIAN 2.1" not in head or len(sizes) != 3 or not box or len(box[1].split()) != 6:
            raise ValueError(f"{path} is no AmiraMesh file with a lattice of three axes and a bounding box")
        if not re.search(r'CoordType "uniform"', head) or not re.search(r"Lattice \{ float\[3\] Data", head):
            raise ValueError(f"{path}: only uniform lattices of three floats a point are supported")
        total = 3 * int(np.prod(sizes))
        body = raw[start.end() : start.end() + 4 * total]
        yield "Velocity", 0, 0, _values(path, body, "<f4"), sizes, 3

    return _read(spark, paths, decode)


class NetcdfHeader:
    """The header of a NetCDF file in one of the classic formats."""

    def __init__(self, path: str, raw: memoryview):
        self.path, self.raw, self.at = path, raw, 4
        self.version = raw[3] if len(raw) > 8 and bytes(raw[:3]) == b"CDF" else 0
        if self.version not in (1, 2, 5):
            raise ValueError(f"{path} is no NetCDF file of a classic format")
        try:
            self.records = self.count()
            self.sizes = self.listed("dimensions", lambda name: (name, self.count()))
            self.listed("attributes", self.attribute)
            self.variables = self.listed("variables", self.variable)
        except (struct.error, IndexError, UnicodeDecodeError) as e:
            raise ValueError(f"{path} has a broken NetCDF header") from e

    def number(self, form: str) -> int:
        value = struct.unpack_from(">" + form, self.raw, self.at)[0]
        self.at += struct.calcsize(form)
        return value

    def count(self) -> int:
        return self.number("Q" if self.version == 5 else "I")

    def name(self) -> str:
        n = self.count()
        text = bytes(self.raw[self.at : self.at + n]).decode()
        self.at += -(-n // 4) * 4
        return text

    def listed(self, kind: str, one) -> list:
        tag, n = self.number("I"), self.count()
        if tag != NETCDF_LISTS[kind] and (tag or n):
            raise ValueError(f"{self.path}: {kind} are missing from the header")
        return [one(self.name()) for _ in range(n)]

    def kind(self) -> str:
        return NETCDF_TYPES[self.number("I") - 1]

    def attribute(self, name: str) -> tuple:
        kind, n = np.dtype(self.kind()), self.count()
        value = np.frombuffer(self.raw, kind, n, self.at)
        self.at += -(-n * kind.itemsize // 4) * 4
        return name, value.tobytes().decode("utf-8", "replace") if kind.kind == "S" else value

    def variable(self, name: str) -> dict:
        dims = [self.count() for _ in range(self.count())]
        said = dict(self.listed("attributes", self.attribute))
        kind, size = self.kind(), self.count()
        return {"name": name, "dims": dims, "said": said, "kind": kind, "size": size, "begin": self.number("I" if self.version == 1 else "Q")}


    def _fills(self, v: dict) -> tuple[float, ...]:
        said = [v["said"].get(a, ()) for a in ("missing_value", "_FillValue")]
        return tuple(float(np.asarray(s)[0]) for s in said if len(s) and not isinstance(s, str))

    def series(self, total: int) -> Block:
        """The first variable of floats with two or three axes, samples, time and maybe a window, as z, y and x."""
        for v in self.variables:
            names = [self.sizes[d][0] for d in v["dims"]]
            if np.dtype(v["kind"]).kind != "f" or len(names) not in (2, 3):
                continue
            if names[:2] != ["samples", "time"]:
                raise ValueError(f"{self.path}: the axes of {v['name']} are {names}, samples and time are expected")
            growing = [u for u in self.variables if u["dims"] and self.sizes[u["dims"][0]][1] == 0]
            if self.sizes[v["dims"][0]][1] == 0 and len(growing) > 1:
                raise ValueError(f"{self.path}: samples that grow together with other variables aren't supported")
            shape = [self.sizes[d][1] or self.records for d in v["dims"]]
            block = Block(self.path, v["name"], 0, 0, v["begin"], v["kind"], (shape[2] if len(shape) == 3 else 1, shape[1], shape[0]), 1, self._fills(v))
            if block.offset + block.nbytes > total:
                raise ValueError(f"{self.path} ends before the values of {v['name']} that are announced")
            return block
        raise ValueError(f"{self.path} holds no variable of floats with two or three axes")

    def blocks(self, total: int) -> Iterator[Block]:
        """The blocks of all variables of three or more axes, in a file of ``total`` bytes."""
        growing = [v for v in self.variables if v["dims"] and self.sizes[v["dims"][0]][1] == 0]
        step = sum(v["size"] for v in growing)
        for v in self.variables:
            names = [self.sizes[d][0] for d in v["dims"]]
            kind = np.dtype(v["kind"])
            if len(names) < 3 or kind.kind == "S":
                continue
            flat = len(names) == 3 and names[0] in ("time", *MEMBERS)
            outer = len(names) - (2 if flat else 3)
            shape = [self.sizes[d][1] or self.records for d in v["dims"]]
            if outer > 2:
                raise ValueError(f"{self.path}: {v['name']} has {len(names)} axes")
            fills = self._fills(v)
            inner = int(np.prod(shape[outer:]))
            sizes = (shape[-1], shape[-2], 1 if flat else shape[-3])
            # records of a single variable are not padded
            rows = step if len(growing) > 1 else int(np.prod(shape[1:])) * kind.itemsize
            for place in np.ndindex(*shape[:outer]):
                number = int(np.ravel_multi_index(place, shape[:outer])) if outer else 0
                first = v["begin"] + number * inner * kind.itemsize
                if v in growing and outer:
                    inside = int(np.ravel_multi_index(place[1:], shape[1:outer])) if outer > 1 else 0
                    first = v["begin"] + place[0] * rows + inside * inner * kind.itemsize
                if first + inner * kind.itemsize > total:
                    raise ValueError(f"{self.path} ends before the values of {v['name']} that are announced")
                member = [i for i, n in zip(place, names) if n in MEMBERS]
                time = [i for i, n in zip(place, names) if n not in MEMBERS]
                if len(member) > 1 or len(time) > 1:
                    raise ValueError(f"{self.path}: {v['name']} has two leading axes of one meaning")
                title = v["said"].get("standard_name") or v["name"]
                yield Block(self.path, title, time[0] if time else 0, member[0] if member else 0, first, kind.str, sizes, 1, fills)


def read_netcdf(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Variables of three or more axes in classic NetCDF files (CDF-1, CDF-2, CDF-5).

    The last axes are z, y and x; of three axes that begin with a time or a
    member, y and x. A leading ensemble, member or members is ``e``, any other
    ``t``. Fill values are NaN, standard names come before names.
    """

    def decode(path: str, raw: memoryview) -> Iterator[Part]:
        for b in NetcdfHeader(path, raw).blocks(len(raw)):
            data = np.frombuffer(raw, b.kind, b.values, b.offset).astype("f8")
            for fill in b.fills:
                data[data == fill] = np.nan
            yield b.variable, b.t, b.e, data, b.sizes, 1

    return _read(spark, paths, decode)


def netcdf_bytes(grid: np.ndarray, sizes: tuple[int, int, int], name: str, voxel: tuple[float, float, float]) -> bytes:
    """A CDF-2 file of one field of floats (x running fastest) with its axes; NaN is its fill value."""
    word = lambda text: struct.pack(">I", len(text)) + text.encode() + bytes(-len(text) % 4)
    axes = [(np.arange(n) * step).astype(">f4") for n, step in zip(sizes, voxel)]
    fields = [(axis, [k], values, b"") for k, (axis, values) in enumerate(zip("xyz", axes))]
    fill = struct.pack(">2I", NETCDF_LISTS["attributes"], 1) + word("_FillValue") + struct.pack(">2If", 5, 1, np.nan)
    fields.append((name, [2, 1, 0], grid.astype(">f4"), fill))
    dims = struct.pack(">2I", NETCDF_LISTS["dimensions"], 3) + b"".join(word(a) + struct.pack(">I", n) for a, n in zip("xyz", sizes))

    def header(start: int) -> bytes:
        out = b"CDF\2" + bytes(4) + dims + bytes(8) + struct.pack(">2I", NETCDF_LISTS["variables"], len(fields))
        for title, at, values, said in fields:
            out += word(title) + struct.pack(f">{1 + len(at)}I", len(at), *at) + (said or bytes(8)) + struct.pack(">2IQ", 5, values.nbytes, start)
            start += values.nbytes
        return out

    return header(len(header(0))) + b"".join(values.tobytes() for _, _, values, _ in fields)


def write_netcdf(df: DataFrame, folder: str, sizes: tuple[int, int, int], name: str = "Scalar", voxel: tuple = (1.0, 1.0, 1.0)) -> None:
    """A file ``<m>.nc`` for each member (m, point_id, value), in a folder that all executors share."""
    written_files(df, folder, sizes, "nc", lambda grid: netcdf_bytes(grid, sizes, name, voxel))


def zarr_arrays(path: str) -> dict[str, dict]:
    """The descriptions (.zarray) of a store's arrays by name, of a folder that the driver sees."""
    found = {at.parent.name: json.loads(at.read_text()) for at in sorted(Path(path).glob("*/.zarray"))}
    if not found:
        raise ValueError(f"{path} holds no Zarr arrays")
    return found


def _unpacked(content: memoryview, packer: str | None) -> bytes:
    if packer is None:
        return bytes(content)
    if packer == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(bytes(content))
    return {"zlib": zlib, "gzip": gzip, "bz2": bz2, "lzma": lzma}[packer].decompress(bytes(content))


def _zarr_array(spark: SparkSession, path: str, name: str, said: dict) -> DataFrame:
    shape, cut, kind = said["shape"], said["chunks"], np.dtype(said["dtype"])
    packer, mark = (said.get("compressor") or {}).get("id"), said.get("dimension_separator", ".")
    if said.get("zarr_format") != 2 or said.get("filters") or kind.kind not in "iuf" or len(shape) > 4 or len(cut) != len(shape):
        raise ValueError(f"{path}/{name}: the format, filters, type or axes of the array aren't supported")
    if packer not in (None, "zlib", "gzip", "bz2", "lzma", "zstd"):
        raise ValueError(f"{path}/{name}: chunks packed by {packer} aren't supported")
    fill = None if said.get("fill_value") is None else np.array(said["fill_value"], "f8").astype(kind)
    counts = [-(-s // c) for s, c in zip(shape, cut)]
    lead = 4 - len(shape)
    zs, ys, xs = shape[-3:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                place = np.unravel_index(number, counts)
                if content.is_valid:
                    block = np.frombuffer(_unpacked(memoryview(content.as_buffer()), packer), kind)
                    if len(block) != np.prod(cut):
                        raise ValueError(f"{path}/{name}: chunk {number} holds {len(block)} values, {np.prod(cut)} are announced")
                    block = block.reshape(cut, order=said.get("order", "C"))
                else:
                    block = np.full(cut, np.nan)
                first = [int(p) * c for p, c in zip(place, cut)]
                # chunks at the border are whole; what lies beyond it is none of the array
                block = block[tuple(slice(0, min(c, s - f)) for c, s, f in zip(cut, shape, first))]
                lows, data = [0] * lead + first, block.reshape([1] * lead + list(block.shape))
                values = data.ravel().astype("f8")
                if fill is not None:
                    values[data.ravel() == fill] = np.nan
                for start in range(0, len(values), CHUNK):
                    at = np.unravel_index(np.arange(start, min(start + CHUNK, len(values))), data.shape)
                    t, z, y, x = (a + low for a, low in zip(at, lows))
                    n = len(t)
                    fixed = [pa.array([f"{path}/{name}"] * n), pa.array([name] * n), pa.array(t.astype("i4")), pa.array(np.zeros(n, "i4"))]
                    places = [(z * ys + y) * xs + x, *(a.astype("i4") for a in (x, y, z)), np.zeros(n, "i4"), values[start : start + n]]
                    yield pa.RecordBatch.from_arrays([*fixed, *map(pa.array, places)], names=NAMES)

    total = int(np.prod(counts))
    # a chunk's number from its name; binaryFile leaves out hidden files, the descriptions
    key = F.regexp_extract("path", rf"(\d+(?:[./]\d+){{{len(shape) - 1}}})$", 1)
    parts = F.split(key, "[./]")
    number = reduce(lambda a, b: a + b, (F.try_element_at(parts, F.lit(k + 1)).cast("long") * int(np.prod(counts[k + 1 :])) for k in range(len(shape))))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary")
    chunks = files.load(f"{path}/{name}").withColumn("number", number).filter(F.col("number").isNotNull())
    # chunks without a file hold the fill value; looking for them reads names only
    absent = spark.range(total).withColumnRenamed("id", "number").join(chunks.select("number"), "number", "left_anti")
    rows = chunks.select("number", "content").unionByName(absent.withColumn("content", F.lit(None).cast("binary")))
    return rows.mapInArrow(run, SCHEMA)


def read_zarr(spark: SparkSession, path: str, arrays: dict[str, dict] | None = None) -> DataFrame:
    """The arrays of three (z, y, x) or four (t, z, y, x) axes in a Zarr store, a chunk at a time; fill values are NaN.

    ``arrays`` holds the arrays' descriptions; without it they are read from
    the store, which then is a folder that the driver sees.
    """
    described = {k: v for k, v in (arrays or zarr_arrays(path)).items() if len(v["shape"]) >= 3}
    if not described:
        raise ValueError(f"{path} holds no array of three axes or more")
    return reduce(DataFrame.unionByName, (_zarr_array(spark, path, name, said) for name, said in described.items()))


READERS = {
    "vti": read_vtk_xml, "vts": read_vtk_xml, "vtr": read_vtk_xml,
    "am": read_amira_mesh, "nc": read_netcdf, "zarr": read_zarr,
}
