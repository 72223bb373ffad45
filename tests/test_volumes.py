"""Volume files: round trips, files written by hand, and files that are none."""

import struct

import numpy as np
import pytest

from gridlark.sources import volumes


def test_cvol_round_trip(spark, tmp_path):
    rows = [(m, p, float(np.float32(m + p / 7))) for m in range(2) for p in range(24) if p != 5]
    df = spark.createDataFrame(rows, "m int, point_id long, value double")
    for r in volumes.cvol_contents(df, (2, 3, 4)).collect():
        (tmp_path / f"{r.m}.cvol").write_bytes(bytes(r.content))
    got = volumes.read_cvol(spark, str(tmp_path)).collect()
    assert len(got) == 48
    want = {(f"{m}.cvol", p): v for m, p, v in rows}
    for r in got:
        assert (r.x, r.y, r.z) == (r.point_id % 2, r.point_id // 2 % 3, r.point_id // 6)
        v = want.get((r.path.rsplit("/", 1)[1], r.point_id))
        assert r.value == v if v is not None else np.isnan(r.value)


def test_cvol_header(spark, tmp_path):
    head = b"cvol" + struct.pack("<3Q", 2, 1, 1) + struct.pack("<3d", 1, 1, 1) + struct.pack("<i", 1) + bytes(8)
    (tmp_path / "a.cvol").write_bytes(head + struct.pack("<2H", 7, 65535))
    assert sorted(r.value for r in volumes.read_cvol(spark, str(tmp_path)).collect()) == [7.0, 65535.0]
    (tmp_path / "b.cvol").write_bytes(b"nothing")
    with pytest.raises(Exception, match="no cvol file"):
        volumes.read_cvol(spark, str(tmp_path)).collect()


def test_dat_series(spark, tmp_path):
    (tmp_path / "f.dat").write_text("ObjectFileName: f%02d.raw\nObjectIndices: 1 5 2\nResolution: 2 2 1\nFormat: FLOAT3\n")
    for k in (1, 3, 5):
        (tmp_path / f"f{k:02d}.raw").write_bytes(np.arange(12, dtype="<f4").tobytes() if k == 1 else np.full(12, k, "<f4").tobytes())
    got = volumes.read_dat(spark, f"{tmp_path}/f.dat").collect()
    assert {(r.point_id, r.component): r.value for r in got if r.t == 1} == {(k // 3, k % 3): float(k) for k in range(12)}
    assert {r.value for r in got if r.t == 3} == {3.0} and {r.value for r in got if r.t == 5} == {5.0} and len(got) == 36


def test_surplus_bytes_and_types(spark, tmp_path):
    (tmp_path / "f.dat").write_text("ObjectFileName: f.raw\nResolution: 2 2 2\nFormat: UCHAR\n")
    (tmp_path / "f.raw").write_bytes(bytes(9))
    with pytest.raises(Exception, match="are announced"):
        volumes.read_dat(spark, f"{tmp_path}/f.dat").collect()
    head = b"cvol" + struct.pack("<3Q", 2, 1, 1) + struct.pack("<3d", 1, 1, 1)
    for name, rest in (("a", struct.pack("<i", -1) + bytes(8) + bytes(8)), ("b", struct.pack("<i", 0) + bytes(8) + bytes(3))):
        (tmp_path / f"{name}.cvol").write_bytes(head + rest)
        with pytest.raises(Exception, match="cvol files|are announced"):
            volumes.read_cvol(spark, f"{tmp_path}/{name}.cvol").collect()


def test_write_cvol(spark, tmp_path):
    rows = [(m, p, float(m * 10 + p)) for m in range(3) for p in range(4)]
    volumes.write_cvol(spark.createDataFrame(rows, "m int, point_id long, value double"), str(tmp_path), (2, 2, 1))
    got = volumes.read_cvol(spark, str(tmp_path)).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.point_id, r.value) for r in got) == sorted((f"{m}.cvol", p, v) for m, p, v in rows)
    assert sorted(f.name for f in tmp_path.iterdir()) == ["0.cvol", "1.cvol", "2.cvol"]


def test_short_file(spark, tmp_path):
    (tmp_path / "f.dat").write_text("ObjectFileName: f.raw\nResolution: 4 4 4\nFormat: UCHAR\n")
    (tmp_path / "f.raw").write_bytes(bytes(10))
    with pytest.raises(Exception, match="are announced"):
        volumes.read_dat(spark, f"{tmp_path}/f.dat").collect()
