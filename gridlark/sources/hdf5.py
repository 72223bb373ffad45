"""HDF5 files, and with them NetCDF-4: the structure is read in a task for each file, the chunks in tasks of their own.

Superblocks 0 to 3, object headers of both kinds, groups by symbol tables or
links in their header, contiguous, compact and chunked layouts (chunks found
by B-trees), deflate, shuffle and checksums. Groups whose links lie in a heap
of their own and newer chunk indices are refused. Files are read through
pyarrow's file systems (see slabs).
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridlark.session import checkpointed
from gridlark.sources import slabs
from gridlark.sources.formats import NAMES, SCHEMA
from gridlark.sources.volumes import CHUNK

# Signatures, numbers of header messages and of filters, and the address of nothing.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
SPACE, LINKS, TYPE, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, MORE, SYMBOLS = 1, 2, 3, 5, 6, 8, 11, 12, 16, 17
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
#: Data sets of this name and five axes hold colours.
COLOURS = {"volumes": "Color"}
#: Bytes of a part of an unbroken data set.
PART = 1 << 25
ENDINGS = ("h5", "hdf5", "nc4", "he5")
_INDEX = "path string, variable string, said string, place string, address long, size long, mask long"


def _whole(raw: bytes) -> int:
    return int.from_bytes(raw, "little")


class File:
    """The data sets of a file; ``opened`` has read_at(n, first)."""

    def __init__(self, path: str, opened):
        self.path, self.opened = path, opened
        self.base = next((at for at in (0, *(512 << k for k in range(12))) if opened.read_at(8, at) == SIGNATURE), None)
        if self.base is None:
            raise ValueError(f"{path} is no HDF5 file")
        head = opened.read_at(128, self.base)
        version = head[8]
        if version > 3:
            raise ValueError(f"{path}: superblock {version} isn't supported")
        self.o, self.l = (head[13], head[14]) if version < 2 else (head[9], head[10])
        first = 24 + 4 * (version == 1) if version < 2 else 12
        self.nothing = (1 << (8 * self.o)) - 1
        # the root's header: in an entry of a symbol table, or by its address
        place = first + 4 * self.o + self.o if version < 2 else first + 3 * self.o
        self.root = _whole(head[place : place + self.o])

    def read(self, n: int, at: int) -> bytes:
        found = self.opened.read_at(n, self.base + at)
        if len(found) < n:
            raise ValueError(f"{self.path} ends before byte {at + n}")
        return found

    def messages(self, at: int) -> list[tuple[int, bytes]]:
        """(kind, body) of an object header."""
        head = self.read(16, at)
        out: list[tuple[int, bytes]] = []
        if head[:4] == b"OHDR":
            flags = head[5]
            start = 6 + 16 * bool(flags & 0x20) + 4 * bool(flags & 0x10)
            wide = 1 << (flags & 3)
            size = _whole(self.read(start + wide, at)[start:])
            blocks, extra = [(at + start + wide, size)], 2 * bool(flags & 4)
            while blocks:
                first, size = blocks.pop(0)
                raw, k = self.read(size, first), 0
                while k + 4 + extra <= size:
                    kind, n = raw[k], _whole(raw[k + 1 : k + 3])
                    body = raw[k + 4 + extra : k + 4 + extra + n]
                    if kind == MORE:
                        there, length = self._range(body)
                        blocks.append((there + 4, length - 8))
                    out.append((kind, body))
                    k += 4 + extra + n
            return out
        if head[0] != 1:
            raise ValueError(f"{self.path}: no object header at byte {at}")
        blocks = [(at + 16, _whole(head[8:12]))]
        while blocks:
            first, size = blocks.pop(0)
            raw, k = self.read(size, first), 0
            while k + 8 <= size:
                kind, n = _whole(raw[k : k + 2]), _whole(raw[k + 2 : k + 4])
                body = raw[k + 8 : k + 8 + n]
                if kind == MORE:
                    blocks.append(self._range(body))
                out.append((kind, body))
                k += 8 + n
        return out

    def _range(self, body: bytes) -> tuple[int, int]:
        return _whole(body[: self.o]), _whole(body[self.o : self.o + self.l])

    def _node(self, at: int, kind: int) -> tuple[int, int, int]:
        """(level, entries, first byte of the keys) of a B-tree's node."""
        head = self.read(8, at)
        if head[:4] != b"TREE" or head[4] != kind:
            raise ValueError(f"{self.path}: no node of a tree at byte {at}")
        return head[5], _whole(head[6:8]), at + 8 + 2 * self.o

    def _children(self, messages: list[tuple[int, bytes]]) -> Iterator[tuple[str, int]]:
        """(name, header) of what a group holds."""
        for kind, body in messages:
            if kind == SYMBOLS:
                tree, heap = _whole(body[: self.o]), _whole(body[self.o : 2 * self.o])
                head = self.read(8 + 2 * self.l + self.o, heap)
                texts = _whole(head[8 + 2 * self.l :])
                yield from self._symbols(tree, texts)
            elif kind == LINKS:
                at = 2 + 8 * bool(body[1] & 1)
                if _whole(body[at : at + self.o]) != self.nothing:
                    raise ValueError(f"{self.path}: a group with links in a heap isn't supported")
            elif kind == LINK:
                flags, at = body[1], 2
                hard = not flags & 8 or body[at] == 0
                at += bool(flags & 8) + 8 * bool(flags & 4) + bool(flags & 0x10)
                wide = 1 << (flags & 3)
                n = _whole(body[at : at + wide])
                name = body[at + wide : at + wide + n].decode()
                if hard:
                    yield name, _whole(body[at + wide + n : at + wide + n + self.o])

    def _symbols(self, tree: int, texts: int) -> Iterator[tuple[str, int]]:
        level, n, at = self._node(tree, 0)
        raw = self.read(n * (self.l + self.o), at)
        for k in range(n):
            child = _whole(raw[k * (self.l + self.o) + self.l :][: self.o])
            if level:
                yield from self._symbols(child, texts)
                continue
            entry = 2 * self.o + 24
            count = _whole(self.read(8, child)[6:8])
            entries = self.read(count * entry, child + 8)
            for j in range(count):
                one = entries[j * entry :]
                name, header = _whole(one[: self.o]), _whole(one[self.o : 2 * self.o])
                yield self._text(texts + name), header

    def _text(self, at: int) -> str:
        out = b""
        while b"\0" not in out:
            out += self.opened.read_at(64, self.base + at + len(out)) or b"\0"
        return out.partition(b"\0")[0].decode()

    def datasets(self, at: int | None = None, prefix: str = "", seen: tuple[int, ...] = ()) -> Iterator[tuple[str, dict]]:
        """(name, description) of the numeric data sets of three to five axes in all groups."""
        at = self.root if at is None else at
        if at in seen:
            return
        messages = self.messages(at)
        kinds = {k for k, _ in messages}
        if {SPACE, TYPE, LAYOUT} <= kinds:
            said = self._described(messages)
            if said is not None:
                yield prefix.lstrip("/"), said
        for name, header in self._children(messages):
            yield from self.datasets(header, f"{prefix}/{name}", (*seen, at))

    def _type(self, body: bytes) -> str | None:
        kind, size = body[0] & 15, _whole(body[4:8])
        order = "<>"[body[1] & 1]
        if kind == 0 and size in (1, 2, 4, 8):
            return f"{order}{'i' if body[1] & 8 else 'u'}{size}"
        return f"{order}f{size}" if kind == 1 and size in (2, 4, 8) else None

    def _shape(self, body: bytes) -> list[int]:
        first = 8 if body[0] == 1 else 4
        return [_whole(body[first + k * self.l : first + (k + 1) * self.l]) for k in range(body[1])]

    def _attribute(self, body: bytes) -> tuple[str, object]:
        sizes = [_whole(body[k : k + 2]) for k in (2, 4, 6)]
        padded = (lambda n: -(-n // 8) * 8) if body[0] == 1 else (lambda n: n)
        at = 8 + (body[0] == 3)
        name = body[at : at + sizes[0]].rstrip(b"\0").decode()
        at += padded(sizes[0])
        kind, text = self._type(body[at:]), body[at] & 15 == 3
        at += padded(sizes[1]) + padded(sizes[2])
        if kind:
            return name, np.frombuffer(body, kind, 1, at)[0].item() if len(body) >= at + int(kind[2:]) else None
        return name, body[at:].rstrip(b"\0").decode("utf-8", "replace") if text else None

    def _described(self, messages: list[tuple[int, bytes]]) -> dict | None:
        one = {k: b for k, b in messages}
        kind, shape = self._type(one[TYPE]), self._shape(one[SPACE])
        if kind is None or not 3 <= len(shape) <= 5:
            return None
        said = {"kind": kind, "shape": shape, "filters": [], "fill": None, "missing": []}
        attributes = dict(self._attribute(b) for k, b in messages if k == ATTRIBUTE)
        said["title"] = attributes.get("standard_name") or None
        said["missing"] = [float(v) for v in (attributes.get(a) for a in ("missing_value", "_FillValue")) if isinstance(v, int | float)]
        if FILTERS in one:
            said["filters"] = list(self._filters(one[FILTERS]))
        if FILL in one:
            body = one[FILL]
            first, defined = (2, body[1] & 0x20) if body[0] == 3 else (4, body[0] == 1 or body[3])
            if defined and _whole(body[first : first + 4]) == int(kind[2:]):
                said["fill"] = float(np.frombuffer(body, kind, 1, first + 4)[0])
        body = one[LAYOUT]
        if body[0] not in (3, 4) or body[1] > 2 or (body[0] == 4 and body[1] == 2):
            raise ValueError(f"{self.path}: layout {body[0]}, class {body[1]} isn't supported")
        if body[1] == 0:
            said["inside"] = body[4 : 4 + _whole(body[2:4])].hex()
        elif body[1] == 1:
            said["address"] = _whole(body[2 : 2 + self.o])
        else:
            said["tree"] = _whole(body[3 : 3 + self.o])
            said["cut"] = [_whole(body[3 + self.o + 4 * k :][:4]) for k in range(body[2] - 1)]
        return said

    def _filters(self, body: bytes) -> Iterator[list]:
        at = 8 if body[0] == 1 else 2
        for _ in range(body[1]):
            number = _whole(body[at : at + 2])
            named = body[0] == 1 or number >= 256
            size = _whole(body[at + 2 : at + 4]) if named else 0
            at += 4 if named else 2
            values = _whole(body[at + 2 : at + 4])
            at += 4 + (-(-size // 8) * 8 if body[0] == 1 else size)
            data = [_whole(body[at + 4 * k : at + 4 * k + 4]) for k in range(values)]
            at += 4 * values + 4 * (body[0] == 1 and values % 2)
            if number not in (DEFLATE, SHUFFLE, CHECKSUM):
                raise ValueError(f"{self.path}: filter {number} isn't supported")
            yield [number, data]

    def chunks(self, said: dict) -> Iterator[tuple[list[int], list[int], int, int, int]]:
        """(first place, extent, address, bytes, mask) of the parts of a data set; address -1 where nothing is stored."""
        shape, item = said["shape"], int(said["kind"][2:])
        if "cut" not in said:
            # as many planes, lines or points as a part holds
            inner = list(shape)
            axis = 0
            while axis < len(shape) - 1 and int(np.prod(shape[axis + 1 :])) * item > PART:
                inner[axis] = 1
                axis += 1
            inner[axis] = max(1, min(shape[axis], PART // max(1, int(np.prod(shape[axis + 1 :])) * item)))
            said["cut"] = inner
            for place in np.ndindex(*[-(-s // c) for s, c in zip(shape, inner)]):
                first = [p * c for p, c in zip(place, inner)]
                extent = [min(c, s - f) for c, s, f in zip(inner, shape, first)]
                stored = "inside" in said or said["address"] != self.nothing
                start = int(np.ravel_multi_index(first, shape)) * item
                yield first, extent, self.base * ("inside" not in said) + said.get("address", 0) + start if stored else -1, int(np.prod(extent)) * item, 0
            return
        found = {}
        if said["tree"] != self.nothing:
            found = {tuple(first): (address, size, mask) for first, address, size, mask in self._stored(said["tree"], len(shape))}
        for place in np.ndindex(*[-(-s // c) for s, c in zip(shape, said["cut"])]):
            first = [p * c for p, c in zip(place, said["cut"])]
            address, size, mask = found.get(tuple(first), (-1, 0, 0))
            yield first, said["cut"], address, size, mask

    def _stored(self, tree: int, rank: int) -> Iterator[tuple[list[int], int, int, int]]:
        level, n, at = self._node(tree, 1)
        key = 8 + 8 * (rank + 1)
        raw = self.read(n * (key + self.o), at)
        for k in range(n):
            one = raw[k * (key + self.o) :]
            child = _whole(one[key : key + self.o])
            if level:
                yield from self._stored(child, rank)
            else:
                first = [_whole(one[8 + 8 * j : 16 + 8 * j]) for j in range(rank)]
                yield first, self.base + child, _whole(one[:4]), _whole(one[4:8])


def _indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [part.split()[0] for part in _INDEX.split(", ")]
    for batch in batches:
        for path in batch["path"]:
            system, at = slabs._opened(path)
            with system.open_input_file(at) as f:
                file, rows = File(path, f), []
                for name, said in file.datasets():
                    rank5 = len(said["shape"]) == 5
                    variable = COLOURS.get(name, name) if rank5 else said["title"] or name
                    for first, extent, address, size, mask in file.chunks(said):
                        rows.append((path, variable, json.dumps(said), json.dumps([first, extent]), address, size, mask))
                        if len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
            yield pd.DataFrame(rows, columns=names)


def decoded(raw: bytes, said: dict, mask: int) -> bytes:
    """A stored chunk with its filters undone, the last one first; bits of the mask say which were left out."""
    for k in range(len(said["filters"]) - 1, -1, -1):
        number, _ = said["filters"][k]
        if mask >> k & 1:
            continue
        if number == DEFLATE:
            raw = zlib.decompress(raw)
        elif number == CHECKSUM:
            raw = raw[:-4]
        else:
            item = int(said["kind"][2:])
            n = len(raw) // item
            raw = np.frombuffer(raw, np.uint8, n * item).reshape(item, n).T.tobytes() + raw[n * item :]
    return raw


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            said, (first, extent) = json.loads(r["said"]), json.loads(r["place"])
            kind, shape = np.dtype(said["kind"]), said["shape"]
            if r["address"] < 0:
                block = np.full(extent, np.nan if said["fill"] is None else said["fill"])
            else:
                if "inside" in said:
                    raw = bytes.fromhex(said["inside"])[r["address"] : r["address"] + r["size"]]
                else:
                    system, at = slabs._opened(r["path"])
                    with system.open_input_file(at) as f:
                        raw = f.read_at(r["size"], r["address"])
                raw = decoded(raw, said, r["mask"])
                if len(raw) != int(np.prod(extent)) * kind.itemsize:
                    raise ValueError(f"{r['path']}: a chunk of {r['variable']} holds {len(raw)} bytes, {int(np.prod(extent)) * kind.itemsize} are announced")
                block = np.frombuffer(raw, kind).reshape(extent)
            # chunks at the border are whole; what lies beyond it is none of the data set
            block = block[tuple(slice(0, min(c, s - f)) for c, s, f in zip(extent, shape, first))].astype("f8")
            for v in said["missing"]:
                block[block == v] = np.nan
            zs, ys, xs = shape[-3:]
            lead = [0] * (5 - len(shape))
            # axes are t, component, z, y, x; of four, t, z, y, x
            lows, sizes = lead + list(first), [1] * len(lead) + list(block.shape)
            if len(shape) == 4:
                lows, sizes = [first[0], 0, *first[1:]], [block.shape[0], 1, *block.shape[1:]]
            flat = block.ravel()
            for start in range(0, len(flat), CHUNK):
                part = flat[start : start + CHUNK]
                t, c, z, y, x = (a + low for a, low in zip(np.unravel_index(np.arange(start, start + len(part)), sizes), lows))
                n = len(part)
                same = [pa.array([r["path"]] * n), pa.array([r["variable"]] * n), pa.array(t.astype("i4")), pa.array(np.zeros(n, "i4"))]
                places = [(z * ys + y) * xs + x, *(a.astype("i4") for a in (x, y, z, c)), part]
                yield pa.RecordBatch.from_arrays([*same, *map(pa.array, places)], names=NAMES)


def read_hdf5(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The rows (see formats) of the numeric data sets of three (z, y, x), four (t, z, y, x) or five axes (t, component, z, y, x).

    Chunks that aren't stored hold the fill value, or NaN without one; missing
    values named by attributes are NaN, and standard names come before names.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 1000))
    index = checkpointed(files.mapInPandas(_indexed, _INDEX))
    parts = max(1, min(index.count(), 10_000))
    return index.repartition(parts).mapInArrow(_values, SCHEMA)
