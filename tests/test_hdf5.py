"""HDF5 files written byte by byte: both kinds of headers and groups, layouts, filters, fill values, and what is refused."""

import struct
import zlib

import numpy as np
import pytest

from gridlark.sources import datasets, hdf5

NOTHING = (1 << 64) - 1


class Writer:
    """Bytes with parts put at the end, whose places are known at once."""

    def __init__(self, start):
        self.data = bytearray(start)

    def put(self, raw):
        self.data += bytes(-len(self.data) % 8)
        at = len(self.data)
        self.data += raw
        return at


def datatype(kind):
    order, size = kind.byteorder == ">", kind.itemsize
    if kind.kind == "f":
        body = {4: (31, 0, 32, 23, 8, 0, 23, 127), 8: (63, 0, 64, 52, 11, 0, 52, 1023), 2: (15, 0, 16, 10, 5, 0, 10, 15)}[size]
        return struct.pack("<BBBBI", 0x11, 0x20 | order, body[0], 0, size) + struct.pack("<HHBBBBI", body[1], body[2], body[3], body[4], body[5], body[6], body[7])
    return struct.pack("<BBBBI", 0x10, order | 8 * (kind.kind == "i"), 0, 0, size) + struct.pack("<HH", 0, 8 * size)


def space(shape):
    return struct.pack("<BBB5x", 1, len(shape), 0) + struct.pack(f"<{len(shape)}Q", *shape)


def attribute(name, value):
    if isinstance(value, str):
        kind, data, dims = struct.pack("<BBBBI", 0x13, 0, 0, 0, len(value)), value.encode(), struct.pack("<BBB5x", 1, 0, 0)
    else:
        kind, data, dims = datatype(value.dtype), value.tobytes(), space([1])
    pad = lambda raw: raw + bytes(-len(raw) % 8)
    text = name.encode() + b"\0"
    return struct.pack("<BBHHH", 1, 0, len(text), len(kind), len(dims)) + pad(text) + pad(kind) + pad(dims) + data


def stored(w, data, layout, cut, filters, absent=()):
    """(layout message, filter message) of an array."""
    item = data.dtype.itemsize
    if layout == "compact":
        return struct.pack("<BBH", 3, 0, data.nbytes) + data.tobytes(), None
    if layout == "contiguous":
        return struct.pack("<BBQQ", 3, 1, w.put(data.tobytes()), data.nbytes), None
    rows = []
    for place in np.ndindex(*[-(-s // c) for s, c in zip(data.shape, cut)]):
        if place in absent:
            continue
        block = np.zeros(cut, data.dtype)
        part = data[tuple(slice(p * c, (p + 1) * c) for p, c in zip(place, cut))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        raw, mask = block.tobytes(), 0
        for k, f in enumerate(filters):
            if f == hdf5.SHUFFLE:
                raw = np.frombuffer(raw, np.uint8).reshape(-1, item).T.tobytes()
            if f == hdf5.DEFLATE:
                if sum(place) % 2:  # this chunk was left as it is
                    mask |= 1 << k
                else:
                    raw = zlib.compress(raw)
            if f == hdf5.CHECKSUM:
                raw += b"sum!"
        rows.append((len(raw), mask, [p * c for p, c in zip(place, cut)], w.put(raw)))
    key = lambda size, mask, first: struct.pack(f"<II{len(first)}QQ", size, mask, *first, 0)

    def node(level, children):
        raw = b"TREE" + struct.pack("<BBHQQ", 1, level, len(children), NOTHING, NOTHING)
        return w.put(raw + b"".join(key(*k) + struct.pack("<Q", at) for k, at in children) + key(0, 0, [0] * data.ndim))

    leaves = [node(0, [(r[:3], r[3]) for r in rows[k : k + 3]]) for k in range(0, len(rows), 3)]
    top = node(1, [(rows[3 * k][:3], at) for k, at in enumerate(leaves)]) if len(leaves) > 1 else leaves[0] if leaves else NOTHING
    said = struct.pack("<BBBQ", 3, 2, data.ndim + 1, top) + struct.pack(f"<{data.ndim + 1}I", *cut, item)
    pipeline = struct.pack("<BB6x", 1, len(filters)) + b"".join(struct.pack("<HHHHII", f, 0, 0, 1, 4, 0) for f in filters)
    return said, pipeline if filters else None


def _messages(w, data, layout="contiguous", cut=None, filters=(), absent=(), fill=None, attributes=()):
    said, pipeline = stored(w, data, layout, cut, filters, absent)
    out = [(hdf5.SPACE, space(data.shape)), (hdf5.TYPE, datatype(data.dtype)), (hdf5.LAYOUT, said)]
    out += [(hdf5.FILTERS, pipeline)] if pipeline else []
    out += [(hdf5.FILL, struct.pack("<BBBBI", 2, 1, 0, 1, data.dtype.itemsize) + np.array(fill, data.dtype).tobytes())] if fill is not None else []
    return out + [(hdf5.ATTRIBUTE, attribute(*a)) for a in attributes]


def old_header(w, messages):
    """Version 1, whose later messages are continued elsewhere."""
    one = lambda kind, body: struct.pack("<HHB3x", kind, len(body) + -len(body) % 8, 0) + body + bytes(-len(body) % 8)
    rest = b"".join(one(*m) for m in messages[1:])
    there = w.put(rest)
    first = one(*messages[0]) + one(hdf5.MORE, struct.pack("<QQ", there, len(rest)))
    return w.put(struct.pack("<BBHII4x", 1, 0, len(messages) + 1, 1, len(first)) + first)


def new_header(w, messages):
    body = b"".join(struct.pack("<BHB", k, len(b), 0) + b for k, b in messages)
    return w.put(b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body + b"sum!")


def old_file(parts, wide=2):
    """Superblock 0 and groups by symbol tables; names with / lie in groups of their own."""
    w = Writer(bytes(96))

    def group(names):
        texts, entries = bytearray(8), []
        for name in sorted(names):
            entries.append((len(texts), names[name]))
            texts += name.encode() + b"\0" + bytes(-(len(name) + 1) % 8)
        heap = w.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(texts), 0, w.put(bytes(texts))))
        nodes = []
        for k in range(0, len(entries), wide):
            some = entries[k : k + wide]
            nodes.append(w.put(b"SNOD" + struct.pack("<BBH", 1, 0, len(some)) + b"".join(struct.pack("<QQII16x", n, at, 0, 0) for n, at in some)))
        tree = w.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, len(nodes), NOTHING, NOTHING) + b"".join(struct.pack("<QQ", 0, n) for n in nodes) + bytes(8))
        return old_header(w, [(hdf5.SYMBOLS, struct.pack("<QQ", tree, heap)), (0, b"")])

    names = {}
    for name, (data, options) in parts.items():
        where, _, own = name.rpartition("/")
        header = old_header(w, _messages(w, data, **options))
        names.setdefault(where, {})[own] = header
    root = names.pop("", {})
    root |= {where: group(inside) for where, inside in names.items()}
    at = group(root)
    w.data[:96] = hdf5.SIGNATURE + struct.pack("<8B2HI4Q", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0, 0, NOTHING, len(w.data), NOTHING) + struct.pack("<QQII16x", 0, at, 0, 0)
    return bytes(w.data)


def new_file(parts, version=2, before=b""):
    """Superblock 2 and links in the root's header."""
    w = Writer(bytes(48))
    links = []
    for name, (data, options) in parts.items():
        header = new_header(w, _messages(w, data, **options))
        links.append((hdf5.LINK, struct.pack("<BBB", 1, 0, len(name)) + name.encode() + struct.pack("<Q", header)))
    root = new_header(w, [(hdf5.LINKS, struct.pack("<BBQQ", 0, 0, NOTHING, NOTHING)), *links])
    w.data[:48] = hdf5.SIGNATURE + struct.pack("<BBBBQQQQ", version, 8, 8, 0, len(before), NOTHING, len(w.data), root) + b"sum!"
    return before + bytes(w.data)


def _cells(df):
    rows = df.collect()
    out = {(r.variable, r.t, r.component, r.z, r.y, r.x): r.value for r in rows}
    assert len(out) == len(rows)
    return out


def _want(name, data):
    full = data.reshape(((1, 1) if data.ndim == 3 else ()) + data.shape) if data.ndim != 4 else data[:, None]
    return {(name, *place): float(v) for place, v in np.ndenumerate(full)}


@pytest.mark.parametrize("make", [old_file, new_file])
def test_layouts_and_filters(spark, tmp_path, make, monkeypatch):
    monkeypatch.setattr(hdf5, "PART", 64)
    rng = np.random.default_rng(3)
    a, b = rng.random((3, 4, 5)).astype("<f4"), rng.integers(-99, 99, (2, 3, 5, 4)).astype(">i2")
    c, d = rng.random((4, 5, 6)), rng.integers(0, 200, (2, 4, 2, 3, 3)).astype("u1")
    parts = {
        "flat": (a, {"attributes": [("standard_name", "air_temperature"), ("_FillValue", a[:1, 1, 1])]}), "steps": (b, {"layout": "compact"}),
        "cut": (c, {"layout": "chunked", "cut": (3, 2, 4), "filters": (hdf5.SHUFFLE, hdf5.DEFLATE, hdf5.CHECKSUM)}),
        "volumes": (d, {"layout": "chunked", "cut": (1, 4, 2, 2, 2)}), "line": (np.arange(4.0), {}),
    }
    (tmp_path / "a.h5").write_bytes(make(parts))
    a = a.copy()
    a[0, 1, 1] = np.nan
    want = _want("air_temperature", a) | _want("steps", b) | _want("cut", c) | _want("Color", d)
    got = _cells(hdf5.read_hdf5(spark, f"{tmp_path}/a.h5"))
    assert got == pytest.approx(want, nan_ok=True)


def test_groups_missing_chunks_and_the_catalog(spark, tmp_path):
    data = np.arange(2 * 4 * 6.0).reshape(2, 4, 6).astype("<f8")
    options = {"layout": "chunked", "cut": (1, 4, 3), "absent": [(0, 0, 1), (1, 0, 0)]}
    raw = old_file({"deep/one": (data, options | {"fill": -5.0}), "two": (data, options), "three": (data, {"layout": "chunked", "cut": (2, 4, 6), "absent": [(0, 0, 0)], "fill": 1.0})})
    (tmp_path / "g.hdf5").write_bytes(raw)
    said = '{"datasets": [{"name": "d", "filename": "g.hdf5", "min": [0, 0, 1], "max": [9, 9, 1]}]}'
    got = _cells(datasets.read(spark, datasets.catalog(said, str(tmp_path))["d"]))
    one, two = data.copy(), data.copy()
    one[0, :, 3:] = one[1, :, :3] = -5.0
    two[0, :, 3:] = two[1, :, :3] = np.nan
    want = {k: v for k, v in (_want("deep/one", one) | _want("two", two) | _want("three", np.ones((2, 4, 6)))).items() if k[3] == 1}
    assert got == pytest.approx(want, nan_ok=True)


def test_a_user_block_and_several_files(spark, tmp_path):
    data = np.arange(8.0).reshape(2, 2, 2)
    for k, before in enumerate((bytes(512), bytes(1024))):
        (tmp_path / f"{k}.h5").write_bytes(new_file({f"v{k}": (data + k, {})}, 3, before))
    got = _cells(hdf5.read_hdf5(spark, [f"{tmp_path}/{k}.h5" for k in (0, 1)]))
    assert got == _want("v0", data) | _want("v1", data + 1)


class Opened:
    def __init__(self, raw):
        self.raw = raw

    def read_at(self, n, first):
        return self.raw[first : first + n]


def test_what_is_refused():
    data = np.zeros((2, 2, 2))
    plain = new_file({"v": (data, {})})
    odd = new_file({"v": (data, {"layout": "chunked", "cut": (2, 2, 2), "filters": (32001,)})})
    dense = plain.replace(struct.pack("<BBQQ", 0, 0, NOTHING, NOTHING), struct.pack("<BBQQ", 0, 0, 48, 48))
    for raw, why in ((b"nothing", "no HDF5"), (plain.replace(hdf5.SIGNATURE + b"\2", hdf5.SIGNATURE + b"\4"), "superblock"), (odd, "filter 32001"), (dense, "heap"), (plain[:200], "ends before")):
        with pytest.raises(ValueError, match=why):
            for _, said in hdf5.File("f", Opened(raw)).datasets():
                list(hdf5.File("f", Opened(raw)).chunks(said))
