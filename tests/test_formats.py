"""Volume formats and the JSON catalog on files written by hand, and files that are none."""

import json
import struct

import numpy as np
import pytest

from gridlark.plans import described
from gridlark.sources import datasets, formats


def cells(df):
    return {(r.variable, r.t, r.e, r.point_id, r.component): r.value for r in df.collect()}


def nifti(dims, code, data, order="<"):
    head = bytearray(352)
    struct.pack_into(f"{order}i", head, 0, 348)
    struct.pack_into(f"{order}8h", head, 40, len(dims), *dims, *[1] * (7 - len(dims)))
    struct.pack_into(f"{order}h", head, 70, code)
    struct.pack_into(f"{order}f", head, 108, 352.0)
    head[344:348] = b"n+1\0"
    return bytes(head) + data


@pytest.mark.parametrize("order", "<>")
def test_nifti(spark, tmp_path, order):
    (tmp_path / "a.nii").write_bytes(nifti((2, 2, 1, 3), 4, np.arange(12, dtype=f"{order}i2").tobytes(), order))
    got = cells(formats.read_nifti(spark, f"{tmp_path}/a.nii"))
    assert got == {("Scalar", k // 4, 0, k % 4, 0): float(k) for k in range(12)}
    for bad in (b"none", nifti((2, 2, 1), 4, bytes(3)), nifti((2, 2, 2), 4, bytes(8)), nifti((1, 1, 1), 99, bytes(8))):
        (tmp_path / "b.nii").write_bytes(bad)
        with pytest.raises(Exception, match="NIfTI|whole number|announced|supported"):
            formats.read_nifti(spark, f"{tmp_path}/b.nii").collect()


def test_meta_image(spark, tmp_path):
    head = "ObjectType = Image\nNDims = 3\nDimSize = 2 1 2\nElementType = {}\nElementDataFile = a.raw\n"
    (tmp_path / "a.mhd").write_text(head.format("MET_USHORT"))
    (tmp_path / "a.raw").write_bytes(np.array([1, 2, 3, 60000], "<u2").tobytes())
    assert [cells(formats.read_meta_image(spark, f"{tmp_path}/a.mhd"))["Scalar Attribute", 0, 0, k, 0] for k in range(4)] == [1.0, 2.0, 3.0, 60000.0]
    for text in (head.format("MET_DOUBLE"), head.format("MET_UCHAR").replace("NDims = 3", "NDims = 2"), "no entry\n"):
        (tmp_path / "b.mhd").write_text(text)
        with pytest.raises(ValueError):
            formats.read_meta_image(spark, f"{tmp_path}/b.mhd")
    (tmp_path / "c.mhd").write_text(head.format("MET_FLOAT"))
    with pytest.raises(Exception, match="announced"):
        formats.read_meta_image(spark, f"{tmp_path}/c.mhd").collect()


def test_vtk(spark, tmp_path):
    head = "# vtk DataFile Version 3.0\ntitle\n{}\nDATASET STRUCTURED_POINTS\nDIMENSIONS 2 2 1\nORIGIN 0 0 0\nSPACING 1 1 1\nPOINT_DATA 4\n"
    (tmp_path / "a.vtk").write_text(head.format("ASCII") + "SCALARS s float 1\nLOOKUP_TABLE default\n1 2\n3 4\nVECTORS v double\n1 2 3 4 5 6\n7 8 9 10 11 12\n")
    got = cells(formats.read_vtk(spark, f"{tmp_path}/a.vtk"))
    assert [got["s", 0, 0, k, 0] for k in range(4)] == [1, 2, 3, 4] and got["v", 0, 0, 3, 1] == 11 and len(got) == 16
    body = b"SCALARS s float\nLOOKUP_TABLE default\n" + np.array([1, 2, 3, 4], ">f4").tobytes() + b"\n"
    (tmp_path / "b.vtk").write_bytes(head.format("BINARY").encode() + body)
    assert [cells(formats.read_vtk(spark, f"{tmp_path}/b.vtk"))["s", 0, 0, k, 0] for k in range(4)] == [1, 2, 3, 4]
    for text in ("nothing", head.format("ASCII") + "SCALARS s float\n1 2 3", head.format("ASCII").replace("POINT_DATA 4", "POINT_DATA 5"), head.format("ASCII") + "TENSORS t float\n"):
        (tmp_path / "c.vtk").write_text(text)
        with pytest.raises(Exception, match="VTK|ended|announces|unknown"):
            formats.read_vtk(spark, f"{tmp_path}/c.vtk").collect()


CTL = """* a comment
DSET ^a.bin
OPTIONS big_endian
UNDEF -9
XDEF 2 LINEAR 0 1
YDEF 1 LEVELS 5
ZDEF 2 LEVELS 1000
 850
TDEF 2 LINEAR 00Z01JAN2000 1HR
VARS 2
p 0 99 surface
u 2 99 wind
ENDVARS
"""


def test_ctl(spark, tmp_path):
    (tmp_path / "a.ctl").write_text(CTL)
    data = np.arange(12, dtype=">f4")
    data[3] = -9
    (tmp_path / "a.bin").write_bytes(data.tobytes())
    got = cells(formats.read_ctl(spark, f"{tmp_path}/a.ctl"))
    assert [got["p", 0, 0, k, 0] for k in range(4)] == [0, 1, 0, 1] and [got["u", 1, 0, k, 0] for k in range(4)] == [8, 9, 10, 11]
    assert np.isnan(got["u", 0, 0, 1, 0]) and len(got) == 16
    for wrong in (CTL.replace("VARS 2", "VARS 3"), CTL.replace("big_endian", "sequential"), CTL.replace("LINEAR 0 1", "GAUSS 0 1"), CTL.replace("ZDEF", "NDEF"), CTL.replace("u 2", "u 3")):
        (tmp_path / "b.ctl").write_text(wrong)
        with pytest.raises((ValueError, KeyError)):
            formats.read_ctl(spark, f"{tmp_path}/b.ctl")
    (tmp_path / "a.bin").write_bytes(bytes(40))
    with pytest.raises(Exception, match="announced"):
        formats.read_ctl(spark, f"{tmp_path}/a.ctl").collect()


def test_field_and_rbc(spark, tmp_path):
    (tmp_path / "a.field").write_bytes(struct.pack("<6I", 2, 1, 1, 3, 1, 0) + np.arange(8, dtype="<f4").tobytes())
    got = cells(formats.read_field(spark, f"{tmp_path}/a.field"))
    assert got["Velocity", 0, 0, 1, 2] == 6 and got["Scalar Attribute", 0, 0, 1, 0] == 7 and len(got) == 8
    (tmp_path / "h.field").write_bytes(struct.pack("<6I", 2, 1, 1, 3, 1, 1) + np.arange(6, dtype="<f2").tobytes())
    assert cells(formats.read_field(spark, f"{tmp_path}/h.field"))["Velocity", 0, 0, 1, 0] == 3
    (tmp_path / "b.field").write_bytes(struct.pack("<6I", 2, 1, 1, 2, 1, 0) + bytes(24))
    with pytest.raises(Exception, match="dimensions"):
        formats.read_field(spark, f"{tmp_path}/b.field").collect()
    (tmp_path / "r.bin").write_bytes(np.arange(8, dtype="<f4").tobytes())
    got = cells(formats.read_rbc(spark, f"{tmp_path}/r.bin", (2, 1, 1)))
    assert got["Temperature", 0, 0, 1, 0] == 7 and got["Velocity", 0, 0, 1, 1] == 5
    with pytest.raises(Exception, match="announced"):
        formats.read_rbc(spark, f"{tmp_path}/r.bin").collect()


def test_catalog_and_description(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.nii").write_bytes(nifti((4, 2, 2), 16, np.full(16, k, "<f4").tobytes()))
    said = [
        {"type": "node", "name": "all", "children": [{"name": "series", "filename": "f%d.nii", "time_range": "0 2", "range_inclusive": True}]},
        {"name": "members", "filename": "f%d.nii", "ensemble_range": "1 3", "subsampling_factor": 2},
        {"name": "part", "filenames": ["f2.nii"], "min": [1, 0, 0], "max": [2, 1, 0], "axes": [0, 2, 1], "scale": 2},
    ]
    sets = datasets.catalog(json.dumps({"datasets": said}), str(tmp_path))
    assert list(sets) == ["all/series", "members", "part"] and sets["part"].scale == (2.0, 2.0, 2.0)
    assert {(r.t, r.e, r.value) for r in datasets.read(spark, sets["all/series"]).collect()} == {(k, 0, float(k)) for k in range(3)}
    got = datasets.read(spark, sets["members"]).collect()
    assert {(r.e, r.value) for r in got} == {(0, 1.0), (1, 2.0)} and {(r.x, r.y, r.z) for r in got} == {(0, 0, 0), (1, 0, 0)}
    assert {(r.x, r.y, r.z) for r in datasets.read(spark, sets["part"]).collect()} == {(x, 0, z) for x in (1, 2) for z in (0, 1)}
    text = described.saved({"dataset": "all/series"}, {"op": "filter", "where": "t > 0"}, {"op": "sphere", "centre": [0, 0, 0], "radius": 1})
    assert {(r.t, r.x, r.y, r.z) for r in described.run(spark, text, sets).collect()} == {(t, *p) for t in (1, 2) for p in ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1))}
    assert datasets.placed(["a", "b", "c", "d"], 2, 2) == [("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("d", 1, 1)]
    assert datasets.placed(["a", "b", "c", "d"], 2, 2, True)[1] == ("b", 1, 0)
    for wrong in ({"name": "x", "filename": "f", "time_range": "1"}, {"name": "x"}, {"name": "x", "type": "other"}, {"name": "x", "filename": "f", "time_range": "0 1", "ensemble_range": "0 1"}):
        with pytest.raises(ValueError):
            datasets.catalog(json.dumps({"datasets": [wrong]}))
    for wrong in ({"source": {"field": "none"}}, {"source": {"dataset": "none"}}, {"source": {"dataset": "part"}, "steps": [{"op": "none"}]}):
        with pytest.raises(ValueError):
            described.run(spark, wrong, sets)


def test_registered_operator(spark):
    @described.operator("doubled")
    def doubled(df, column):
        return df.withColumn(column, df[column] * 2)

    try:
        with pytest.raises(ValueError):
            described.operator("doubled")(doubled)
        df = described.OPERATORS["doubled"](spark.range(3), column="id")
        assert [r.id for r in df.collect()] == [0, 2, 4]
    finally:
        del described.OPERATORS["doubled"]


def test_vector_chain(spark):
    df = spark.createDataFrame([(x, y, 0, float(y), float(-x), 0.0) for x in range(3) for y in range(3)], "x int, y int, z int, u double, v double, w double")
    made = described.vector_chain(df)
    assert set(made) == {"velocity", "velocity magnitude", "vorticity", "vorticity magnitude", "helicity"}
    assert {r.cw for r in made["vorticity"].collect()} == {-2.0} and described.vector_chain(df.drop("w")) == {}
