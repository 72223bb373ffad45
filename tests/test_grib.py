"""GRIB messages written byte by byte: packings, bitmaps, levels, dates, members, and what is refused."""

import struct

import numpy as np
import pytest

from gridlark.sources import datasets, grib


def _signed(v, n):
    return (abs(v) | (1 << (8 * n - 1) if v < 0 else 0)).to_bytes(n)


def _section(number, body):
    return struct.pack(">IB", len(body) + 5, number) + body


def packed(values, bits, binary=0, decimal=0, reference=0.0):
    whole = np.rint((values * 10.0**decimal - reference) / 2.0**binary).astype(np.int64)
    text = "".join(format(int(v), f"0{bits}b") for v in whole) if bits else ""
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8) if text else b""


def field(values, code=(0, 0), level=50000, scale=0, member=None, bits=12, binary=0, decimal=1, reference=0.0, template=0, surface=100, packing=0, scan=0):
    """Sections 3 to 7 of a field (ys, xs); NaN goes into a bitmap."""
    ys, xs = values.shape
    grid = struct.pack(">BIBBH", 0, xs * ys, 0, 0, template) + bytes(16) + struct.pack(">II", xs, ys) + bytes(33) + bytes([scan]) + bytes(5)
    grid = grid[:66] + bytes([scan])
    product = struct.pack(">HH2B", 0, 0 if member is None else 1, *code) + bytes(11) + bytes([surface]) + _signed(scale, 1) + struct.pack(">I", level) + bytes(6)
    product = product[:29] + (bytes([0, member, 20]) if member is not None else b"")
    ok = ~np.isnan(values.ravel())
    said = struct.pack(">IHf", int(ok.sum()), packing, reference) + _signed(binary, 2) + _signed(decimal, 2) + bytes([bits, 0])
    marks = b"\xff" if ok.all() else b"\0" + np.packbits(ok).tobytes()
    return _section(3, grid) + _section(4, product) + _section(5, said) + _section(6, marks) + _section(7, packed(values.ravel()[ok], bits, binary, decimal, reference))


def message(*fields, date=(2016, 10, 2, 6, 0), edition=2):
    body = _section(1, struct.pack(">HHBBB", 0, 0, 0, 0, 0) + struct.pack(">H4B", *date) + bytes(3)) + b"".join(fields)
    return b"GRIB\0\0\0" + bytes([edition]) + struct.pack(">Q", 16 + len(body) + 4) + body + b"7777"


def _cells(df):
    return {(r.variable, r.t, r.e, r.x, r.y, r.z): r.value for r in df.collect()}


def _field(seed, xs=5, ys=3):
    return np.round(np.random.default_rng(seed).uniform(0, 40, (ys, xs)), 1)


def test_levels_dates_and_variables(spark, tmp_path):
    data = {}
    for t, date in enumerate([(2016, 10, 2, 6, 0), (2016, 10, 2, 18, 0)]):
        for z, level in enumerate((25000, 50000, 85000)):
            for k, code in enumerate([(0, 0), (2, 2), (9, 77)]):
                data[t, z, k] = (_field(100 * t + 10 * z + k), level, code, date)
    order = sorted(data, key=lambda k: hash(k) % 7)
    # levels in any order, over two files
    for n in (0, 1):
        (tmp_path / f"{n}.grb2").write_bytes(b"".join(message(field(v, c, lv), date=d) for v, lv, c, d in (data[k] for k in order[n::2])))
    df = grib.read_grib(spark, [f"{tmp_path}/{n}.grb2" for n in (0, 1)])
    names = ["t", "u", "0.9.77"]
    want = {(names[k], t, 0, x, y, z): v[y, x] for (t, z, k), (v, *_) in data.items() for y in range(3) for x in range(5)}
    assert _cells(df) == pytest.approx(want)
    assert {(r.point_id, r.x, r.y, r.z) for r in df.collect()} == {(z * 15 + y * 5 + x, x, y, z) for x in range(5) for y in range(3) for z in range(3)}


@pytest.mark.parametrize("bits, binary, decimal, reference", [(8, 0, 0, 0.0), (16, -4, 1, -12.5), (32, -10, 2, 3.25), (11, 1, 1, 0.0), (1, 3, 0, 2.0), (23, -8, 0, -64.0), (0, 0, 0, 7.5)])
def test_packings(spark, tmp_path, bits, binary, decimal, reference):
    rng = np.random.default_rng(bits)
    whole = rng.integers(0, 2 ** min(bits, 20), (7, 13)) if bits else np.zeros((7, 13))
    v = (reference + whole * 2.0**binary) / 10.0**decimal
    (tmp_path / "a.grib").write_bytes(message(field(v, bits=bits, binary=binary, decimal=decimal, reference=reference)))
    got = _cells(grib.read_grib(spark, f"{tmp_path}/a.grib"))
    assert got == pytest.approx({("t", 0, 0, x, y, 0): v[y, x] for x in range(13) for y in range(7)})


def test_bitmaps_members_and_many_fields_of_a_message(spark, tmp_path):
    a, b = _field(1), _field(2)
    a[1, 2] = a[2, 4] = np.nan
    (tmp_path / "m.grb").write_bytes(message(field(a, member=3), field(b, member=4, level=5, scale=-4)))
    said = '{"datasets": [{"name": "d", "filename": "m.grb"}]}'
    got = _cells(datasets.read(spark, datasets.catalog(said, str(tmp_path))["d"]))
    want = {("t", 0, e, x, y, 0): v[y, x] for e, v in ((3, a), (4, b)) for x in range(5) for y in range(3)}
    assert got == pytest.approx(want, nan_ok=True)


def test_unpacking_across_portions(monkeypatch):
    monkeypatch.setattr(grib, "CHUNK", 16)
    for bits in (3, 7, 12, 24):
        v = np.random.default_rng(bits).integers(0, 1 << bits, 101).astype(float)
        assert (grib.unpacked(packed(v, bits), bits, 101) == v).all()


@pytest.mark.parametrize(
    "raw, why",
    [
        (message(field(_field(1)), edition=1), "edition 1"), (message(field(_field(1), template=40)), "grid template"),
        (message(field(_field(1), surface=1)), "pressure"), (message(field(_field(1), packing=40)), "packing template"),
        (message(field(_field(1), scan=0x20)), "order"), (message(field(_field(1)))[:-3], "ends within"), (b"nothing of that kind", "no message"),
        (message(field(_field(1))).replace(b"7777", b"7778"), "mark"), (message(_section(7, b"")), "without the sections"),
    ],
)
def test_what_is_refused(raw, why):
    class Opened:
        def read_at(self, n, first):
            return raw[first : first + n]

    with pytest.raises(ValueError, match=why):
        list(grib.fields("f", Opened(), len(raw)))


def test_fields_of_different_sizes_are_refused(spark, tmp_path):
    (tmp_path / "a.grb").write_bytes(message(field(_field(1))) + message(field(_field(1, 4, 4))))
    with pytest.raises(ValueError, match="sizes"):
        grib.read_grib(spark, f"{tmp_path}/a.grb")
