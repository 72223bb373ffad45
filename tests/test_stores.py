"""VTK XML, AmiraMesh, NetCDF and Zarr on files written by hand, and files that are none."""

import base64
import json
import struct
import zlib

import numpy as np
import pytest

from gridlark.sources import datasets, stores


def cells(df):
    return {(r.variable, r.t, r.e, r.x, r.y, r.z, r.component): r.value for r in df.collect()}


def expected(variable, data, t=0, e=0):
    """Cells of data[z, y, x], NaN left out."""
    return {(variable, t, e, x, y, z, 0): float(v) for (z, y, x), v in np.ndenumerate(data) if v == v}


def known(found):
    return {k: v for k, v in found.items() if v == v}


GRID = np.arange(24, dtype="f8").reshape(2, 3, 4)
VTK = """<?xml version="1.0"?>
<VTKFile type="{kind}" version="1.0" byte_order="LittleEndian" header_type="{head}"{packed}>
<{kind} WholeExtent="0 3 0 2 0 1" Origin="0 0 0" Spacing="1 1 1"><Piece Extent="0 3 0 2 0 1"><PointData>
<DataArray type="Float32" Name="a" format="appended" offset="0"/>
<DataArray type="Float64" Name="b" format="appended" offset="{second}"/></PointData></Piece></{kind}>
<AppendedData encoding="{code}">_"""
END = b"</AppendedData></VTKFile>"


def blocks(data, size=40):
    """Header and body of an array packed in blocks of ``size`` bytes."""
    parts = [data[k : k + size] for k in range(0, len(data), size)]
    packed = [zlib.compress(p) for p in parts]
    rest = len(data) % size
    return np.array([len(parts), size, rest, *map(len, packed)], "<u4").tobytes(), b"".join(packed)


@pytest.mark.parametrize(("code", "packed", "head"), [("raw", False, "UInt64"), ("base64", False, "UInt32"), ("base64", True, "UInt32"), ("raw", True, "UInt32")])
def test_vtk_xml(spark, tmp_path, code, packed, head):
    made = []
    for data in (GRID.astype("<f4").tobytes(), (GRID + 0.5).astype("<f8").tobytes()):
        if packed:
            front, body = blocks(data)
            made.append(front + body if code == "raw" else base64.b64encode(front) + base64.b64encode(body))
        else:
            whole = struct.pack("<Q" if head == "UInt64" else "<I", len(data)) + data
            made.append(whole if code == "raw" else base64.b64encode(whole))
    said = ' compressor="vtkZLibDataCompressor"' if packed else ""
    text = VTK.format(kind="ImageData", head=head, packed=said, code=code, second=len(made[0])).encode()
    (tmp_path / "a.vti").write_bytes(text + b"".join(made) + END)
    assert cells(stores.read_vtk_xml(spark, f"{tmp_path}/a.vti")) == expected("a", GRID) | expected("b", GRID + 0.5)


def test_vtk_xml_refused(spark, tmp_path):
    good = VTK.format(kind="ImageData", head="UInt32", packed="", code="raw", second=0)
    short = struct.pack("<I", 8) + bytes(8)
    texts = [b"none", b"<VTKFile type='Poly'/>", good.encode() + short + END]
    texts += [good.replace(*change).encode() + short + END for change in ((' Extent="0 3', ' Extent="0 2'), ("Float32", "Int8"), ("PointData", "FieldData"))]
    for text in texts:
        (tmp_path / "b.vti").write_bytes(text)
        with pytest.raises(Exception, match="VTK XML|image|announced|extents|appended|point nor"):
            stores.read_vtk_xml(spark, f"{tmp_path}/b.vti").collect()


AMIRA = """# AmiraMesh BINARY-LITTLE-ENDIAN 2.1
define Lattice 2 1 2
Parameters {{
    BoundingBox 0 1 0 1 0 1,
    CoordType "uniform"
}}
Lattice {{ float[{n}] Data }} @1
# Data section follows
@1
"""


def test_amira_mesh(spark, tmp_path):
    (tmp_path / "a.am").write_bytes(AMIRA.format(n=3).encode() + np.arange(12, dtype="<f4").tobytes())
    got = cells(stores.read_amira_mesh(spark, f"{tmp_path}/a.am"))
    assert got == {("Velocity", 0, 0, k // 3 % 2, 0, k // 6, k % 3): float(k) for k in range(12)}
    for text in ("none", AMIRA.format(n=1), AMIRA.format(n=3).replace("2 1 2", "2 2"), AMIRA.format(n=3)):
        (tmp_path / "b.am").write_bytes(text.encode() + bytes(44))
        with pytest.raises(Exception, match="AmiraMesh|uniform|announced"):
            stores.read_amira_mesh(spark, f"{tmp_path}/b.am").collect()


def netcdf(version, dims, variables, records=0):
    """A classic file of (name, dims, values, fill); variables of the record axis have values[record, ...]."""
    wide = ">Q" if version == 5 else ">I"
    n = lambda v: struct.pack(wide, v)
    word = lambda text: n(len(text)) + text.encode() + bytes(-len(text) % 4)
    tag = lambda kind, k: struct.pack(">I", kind) + n(k)
    codes = {"i2": 3, "f4": 5, "f8": 6}
    growing = [v for v in variables if dims[v[1][0]][1] == 0]
    pad = lambda data: data + bytes(-len(data) % 4)

    def header(starts):
        out = b"CDF" + bytes([version]) + n(records) + tag(10, len(dims)) + b"".join(word(a) + n(k) for a, k in dims) + tag(0, 0) + tag(11, len(variables))
        for (name, at, values, fill), start in zip(variables, starts):
            said = tag(12, 1) + word("_FillValue") + struct.pack(">I", codes[values.dtype.str[1:]]) + n(1) + pad(np.array([fill], values.dtype.str.replace("<", ">")).tobytes()) if fill is not None else tag(0, 0)
            size = values.nbytes // (records if dims[at[0]][1] == 0 else 1)
            out += word(name) + n(len(at)) + b"".join(map(n, at)) + said + struct.pack(">I", codes[values.dtype.str[1:]]) + n(-(-size // 4) * 4)
            out += struct.pack(">I" if version == 1 else ">Q", start)
        return out

    big = lambda values: values.astype(values.dtype.str.replace("<", ">")).tobytes()
    start, starts, body = len(header([0] * len(variables))), {}, b""
    for v in variables:
        if v not in growing:
            starts[v[0]] = start + len(body)
            body += pad(big(v[2]))
    for r in range(records):
        for v in growing:
            starts.setdefault(v[0], start + len(body))
            body += big(v[2][r]) if len(growing) == 1 else pad(big(v[2][r]))
    return header([starts[v[0]] for v in variables]) + body


class Plain(tuple):
    """A variable compared by identity."""

    __eq__ = object.__eq__
    __hash__ = object.__hash__


@pytest.mark.parametrize("version", [1, 2, 5])
def test_netcdf(spark, tmp_path, version):
    dims = [("member", 2), ("z", 2), ("y", 3), ("x", 4), ("time", 0)]
    members = np.stack([GRID, GRID + 100]).astype("f4")
    flat = np.arange(36, dtype="i2").reshape(3, 3, 4)
    deep = np.arange(72, dtype="f8").reshape(3, 2, 3, 4)
    variables = [Plain(("a", [0, 1, 2, 3], members, 5.0)), Plain(("lat", [2], np.arange(3, dtype="f4"), None))]
    variables += [Plain(("rain", [4, 2, 3], flat, None)), Plain(("heat", [4, 1, 2, 3], deep, None))]
    (tmp_path / "a.nc").write_bytes(netcdf(version, dims, variables, 3))
    hole = members.astype("f8")
    hole[hole == 5] = np.nan
    want = expected("a", hole[0]) | expected("a", hole[1], e=1)
    for t in range(3):
        want |= expected("rain", flat[t][None], t) | expected("heat", deep[t], t)
    got = cells(stores.read_netcdf(spark, f"{tmp_path}/a.nc"))
    assert known(got) == want and len(got) == len(want) + 1
    (tmp_path / "b.nc").write_bytes(netcdf(version, dims, variables[2:3], 3))
    assert cells(stores.read_netcdf(spark, f"{tmp_path}/b.nc")) == {k: v for k, v in want.items() if k[0] == "rain"}


def test_netcdf_refused(spark, tmp_path):
    whole = netcdf(1, [("z", 2), ("y", 3), ("x", 4)], [Plain(("a", [0, 1, 2], GRID, None))])
    for bad in (b"\x89HDF\r\n\x1a\n" + bytes(20), whole[:40], whole[:-8], b"CDF\x01" + bytes(4) + struct.pack(">2I", 99, 1) + bytes(40)):
        (tmp_path / "a.nc").write_bytes(bad)
        with pytest.raises(Exception, match="NetCDF|announced|header"):
            stores.read_netcdf(spark, f"{tmp_path}/a.nc").collect()


def test_netcdf_written_and_read(spark, tmp_path):
    rows = [(m, p, float(10 * m + p)) for m in range(2) for p in range(24) if p != 7]
    stores.write_netcdf(spark.createDataFrame(rows, "m int, point_id long, value double"), str(tmp_path), (4, 3, 2), "heat")
    for m in range(2):
        got = {r.point_id: r.value for r in stores.read_netcdf(spark, f"{tmp_path}/{m}.nc").collect()}
        assert known(got) == {p: v for k, p, v in rows if k == m} and len(got) == 24
    assert sorted(p.name for p in tmp_path.iterdir()) == ["0.nc", "1.nc"]


@pytest.mark.parametrize(("packer", "mark", "order"), [(None, ".", "C"), ("zlib", "/", "C"), ("zstd", ".", "F")])
def test_zarr(spark, tmp_path, packer, mark, order):
    data = np.arange(3 * 24, dtype="<f4").reshape(3, 2, 3, 4)
    at = tmp_path / "store.zarr" / "heat"
    at.mkdir(parents=True)
    cut = (2, 1, 2, 3)
    said = {"zarr_format": 2, "shape": data.shape, "chunks": cut, "dtype": "<f4", "order": order, "filters": None, "fill_value": 30.0}
    said |= {"compressor": packer and {"id": packer}, "dimension_separator": mark}
    (at / ".zarray").write_text(json.dumps(said))
    want = data.astype("f8")
    want[want == 30] = np.nan
    for place in np.ndindex(2, 2, 2, 2):
        where = tuple(slice(p * c, (p + 1) * c) for p, c in zip(place, cut))
        if place == (1, 1, 1, 1):  # a chunk without a file
            want[where] = np.nan
            continue
        block = np.zeros(cut, "<f4")
        part = data[where]
        block[tuple(map(slice, part.shape))] = part
        raw = block.tobytes(order=order)
        if packer:
            import zstandard

            raw = zlib.compress(raw) if packer == "zlib" else zstandard.ZstdCompressor().compress(raw)
        file = at / mark.join(map(str, place))
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(raw)
    for rows in (stores.read_zarr(spark, str(tmp_path / "store.zarr")), datasets.read(spark, datasets.Dataset("store", [(str(tmp_path / "store.zarr"), 0, 0)]))):
        got = cells(rows)
        assert len(got) == data.size
        assert known(got) == {k: v for t in range(3) for k, v in expected("heat", want[t], t).items()}


def test_zarr_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="no Zarr"):
        stores.read_zarr(spark, str(tmp_path))
    (tmp_path / "a").mkdir()
    said = {"zarr_format": 2, "shape": [1, 1, 2], "chunks": [1, 1, 2], "dtype": "<f8", "compressor": None, "filters": None, "fill_value": 0}
    for change in ({"compressor": {"id": "blosc"}}, {"zarr_format": 3}, {"filters": [{"id": "delta"}]}, {"dtype": "|S4"}, {"shape": [2]}):
        with pytest.raises(ValueError, match="supported|three axes"):
            stores.read_zarr(spark, str(tmp_path), {"a": said | change})
    (tmp_path / "a" / "0.0.0").write_bytes(bytes(8))
    with pytest.raises(Exception, match="announced"):
        stores.read_zarr(spark, str(tmp_path), {"a": said}).collect()
