"""Volume files by slabs: the same rows as whole files give, boxes by the bytes of their lines, and files beyond 2 GB."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_stores import Plain, netcdf

from gridlark.operators.dependence import windowed
from gridlark.operators.grid import region
from gridlark.sources import datasets, formats, slabs, stores, volumes
from gridlark.sources.blocks import Block


def _cvol(path, data, kind="f4"):
    zs, ys, xs = data.shape
    head = struct.pack(volumes.CVOL, b"cvol", xs, ys, zs, 1, 1, 1, volumes.CVOL_TYPES.index(kind), 0)
    path.write_bytes(head + data.astype("<" + kind).tobytes())
    return str(path)


def _cells(df):
    rows = df.select("variable", "t", "e", "point_id", "x", "y", "z", "component", "value").collect()
    assert len({tuple(r)[:-1] for r in rows}) == len(rows)
    return sorted(map(str, rows))


def test_the_rows_of_whole_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(volumes, "CHUNK", 7)
    rng = np.random.default_rng(1)
    data = rng.integers(0, 200, (3, 4, 5))
    path = _cvol(tmp_path / "a.cvol", data, "u1")
    want = [(z * 20 + y * 5 + x, x, y, z, float(data[z, y, x])) for z in range(3) for y in range(4) for x in range(5)]
    got = slabs.read_slabs(spark, path).select("point_id", "x", "y", "z", "value").collect()
    assert sorted(map(tuple, got)) == want
    (tmp_path / "a.raw").write_bytes(data.astype("<u2").tobytes())
    (tmp_path / "a.mhd").write_text("NDims = 3\nDimSize = 5 4 3\nElementType = MET_USHORT\nElementDataFile = a.raw\n")
    assert _cells(slabs.read_slabs(spark, f"{tmp_path}/a.mhd")) == _cells(formats.read_meta_image(spark, f"{tmp_path}/a.mhd"))
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 4, 5, 4, 3, 2, 1, 1, 1)
    struct.pack_into("<h", head, 70, 16)
    struct.pack_into("<f", head, 108, 352.0)
    head[344:348] = b"n+1\0"
    (tmp_path / "b.nii").write_bytes(bytes(head) + rng.random(120).astype("<f4").tobytes())
    assert _cells(slabs.read_slabs(spark, f"{tmp_path}/b.nii")) == _cells(formats.read_nifti(spark, f"{tmp_path}/b.nii"))


def test_netcdf_records_and_fills(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(slabs, "HEADER", 16)
    a, b = np.arange(24, dtype="f4").reshape(2, 1, 3, 4), np.arange(24, dtype="f8").reshape(2, 1, 3, 4)
    raw = netcdf(2, [("time", 0), ("z", 1), ("y", 3), ("x", 4)], [Plain(("a", [0, 1, 2, 3], a, 5.0)), Plain(("b", [0, 1, 2, 3], b, None))], 2)
    (tmp_path / "a.nc").write_bytes(raw)
    got = slabs.read_slabs(spark, f"{tmp_path}/a.nc")
    assert _cells(got) == _cells(stores.read_netcdf(spark, f"{tmp_path}/a.nc"))
    one = got.filter("variable = 'b' AND t = 1 AND x IN (1, 2) AND y < 2")
    assert sorted(r.value for r in one.collect()) == [13.0, 14.0, 17.0, 18.0]


def test_series_whose_files_share_a_name(spark, tmp_path):
    for t in (1, 2):
        (tmp_path / f"t{t}").mkdir()
        (tmp_path / f"t{t}" / "a.raw").write_bytes((np.arange(8) + 10 * t).astype("u1").tobytes())
    (tmp_path / "s.dat").write_text("ObjectFileName: t%d/a.raw\nObjectIndices: 1 2 1\nResolution: 2 2 2\nFormat: UCHAR\n")
    for df in (volumes.read_dat(spark, f"{tmp_path}/s.dat"), slabs.read_slabs(spark, f"{tmp_path}/s.dat")):
        assert sorted((r.t, r.point_id, r.value) for r in df.collect()) == [(t, k, float(k + 10 * t)) for t in (1, 2) for k in range(8)]


def test_a_box_reads_the_bytes_of_its_lines(spark, tmp_path):
    block = Block("f", "v", 0, 0, 64, "<f4", (100, 50, 40))
    read = lambda low, high, most=slabs.MOST: sum(n for s in slabs.planned(block, low, high, most) for _, n, _, _ in s.reads())
    assert read((0, 0, 0), (100, 50, 40)) == block.nbytes
    assert read((0, 0, 3), (100, 50, 7)) == 4 * 100 * 50 * 4
    assert read((0, 10, 3), (100, 12, 7)) == 4 * 100 * 2 * 4
    assert read((7, 10, 3), (9, 12, 4)) == (100 + 2) * 4
    assert read((200, 0, 0), (300, 1, 1)) == 0
    wide = Block("f", "v", 0, 0, 0, "<f8", (1 << 20, 2, 2))
    assert sum(n for s in slabs.planned(wide, (5, 0, 0), (9, 2, 2)) for _, n, _, _ in s.reads()) == 4 * 4 * 8
    # slabs of any size hold every point once
    for most in (4, 300, 1000, 1 << 20):
        cut = list(slabs.planned(block, (3, 5, 1), (90, 41, 30), most))
        assert sum(np.prod([b - a for a, b in zip(s.low, s.high)]) for s in cut) == 87 * 36 * 29
        assert len({s.low for s in cut}) == len(cut)


def test_filters_reach_the_plan(spark, tmp_path, monkeypatch):
    path = _cvol(tmp_path / "a.cvol", np.arange(4000).reshape(40, 10, 10))
    reader = slabs._Reader([(path, 7, 2)])
    from pyspark.sql import datasource as ds

    asked = [ds.GreaterThanOrEqual(("z",), 3), ds.LessThan(("z",), 5), ds.EqualTo(("t",), 7), ds.EqualTo(("value",), 1.0)]
    assert list(reader.pushFilters(asked)) == asked
    (slab,) = reader.partitions()
    assert (slab.low, slab.high, slab.block.t, slab.block.e) == ((0, 0, 3), (10, 10, 5), 7, 2)
    assert slabs._Reader([(path, 1, 0)]).partitions() and not [s for s in _told(path, ds.EqualTo(("t",), 2))]
    assert slabs.read_slabs(spark, path).filter("z = 99").collect() == []
    df = region(slabs.read_slabs(spark, [(path, 7, 2)]), (2, 3, 4), (5, 6, 7))
    assert df.rdd.getNumPartitions() == 1 and df.count() == 64
    assert {(r.t, r.e) for r in df.collect()} == {(7, 2)} and all(r.value == r.point_id for r in df.collect())


def _told(path, f):
    reader = slabs._Reader([(path, 1, 0)])
    list(reader.pushFilters([f]))
    return reader.partitions()


def test_a_file_beyond_two_gigabytes_is_many_tasks(spark, tmp_path):
    xs, ys, zs = 1024, 1024, 800
    path = tmp_path / "large.cvol"
    with open(path, "wb") as f:
        f.write(struct.pack(volumes.CVOL, b"cvol", xs, ys, zs, 1, 1, 1, 2, 0))
        f.seek(volumes.CVOL_BYTES + 4 * (xs * ys * 777 + 5))
        f.write(struct.pack("<f", 3.5))
        f.truncate(volumes.CVOL_BYTES + 4 * xs * ys * zs)  # sparse: nothing else is stored
    assert os.path.getsize(path) > 3 << 30
    reader = slabs._Reader([(str(path), None, None)])
    cut = reader.partitions()
    assert len(cut) == 100 and sum(n for s in cut for _, n, _, _ in s.reads()) == 4 * xs * ys * zs
    box = region(slabs.read_slabs(spark, str(path)), (4, 0, 776), (6, 1, 778))
    assert box.rdd.getNumPartitions() == 1
    assert sorted(r.value for r in box.collect() if r.value) == [3.5] and box.count() == 18


def test_catalog_reads_many_files_in_one_load(spark, tmp_path):
    for k in range(5):
        _cvol(tmp_path / f"m{k}.cvol", np.full((3, 3, 3), k))
    said = '{"datasets": [{"name": "d", "filename": "m%d.cvol", "ensemble_range": "0 5", "min": [1, 1, 1], "max": [1, 2, 2]}]}'
    df = datasets.read(spark, datasets.catalog(said, str(tmp_path))["d"])
    assert sorted((r.e, r.value) for r in df.select("e", "value").distinct().collect()) == [(k, float(k)) for k in range(5)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() == 5 * 4 and plan.count("gridlark_volume") == 1 and "Union" not in plan


@pytest.mark.parametrize("change", [lambda raw: raw[:-1], lambda raw: raw + b"\0\0\0\0", lambda raw: b"nope" + raw[4:]])
def test_malformed_files_are_refused(tmp_path, change):
    path = tmp_path / "a.cvol"
    _cvol(path, np.zeros((2, 2, 2)))
    path.write_bytes(change(path.read_bytes()))
    with pytest.raises(ValueError):
        slabs.layout(str(path))


@pytest.mark.parametrize("window", [0, 3])
def test_time_series(spark, tmp_path, window):
    rng = np.random.default_rng(4)
    v = rng.random((5, 40, *[window] * bool(window))).astype("f4")
    v.flat[7] = -9.0
    dims = [("samples", 5), ("time", 40), ("window", 3), ("other", 2)]
    (tmp_path / "s.nc").write_bytes(netcdf(2, dims, [Plain(("k", [3], np.arange(2, dtype="i2"), None)), Plain(("v", [0, 1, 2][: v.ndim], v, -9.0))]))
    got = {(r.sidx, r.t, r.w): r.value for r in slabs.read_series(spark, f"{tmp_path}/s.nc").collect()}
    v.flat[7] = np.nan
    assert got == pytest.approx({k: float(x) for k, x in np.ndenumerate(v.reshape(5, 40, -1))}, nan_ok=True)
    if not window:
        series = slabs.read_series(spark, f"{tmp_path}/s.nc").filter("NOT isnan(value)").select(F.col("sidx").cast("string").alias("sidx"), F.col("t").cast("long").alias("t"), "value")
        told = {(r.sidx, r.t): r.value for r in windowed(series, "1", 12).collect()}
        assert len(told) == 4 * 29 + 21 and told["2", 39] == pytest.approx(np.corrcoef(v[1, 28:], v[2, 28:])[0, 1])
    (tmp_path / "w.nc").write_bytes(netcdf(1, [("time", 4), ("samples", 2)], [Plain(("v", [0, 1], np.zeros((4, 2), "f4"), None))]))
    with pytest.raises(ValueError, match="expected"):
        slabs.layout(f"{tmp_path}/w.nc", "series")
