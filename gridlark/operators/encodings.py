"""Features of positions: vertices of grids of several resolutions, dense or hashed, dictionaries, and files of weights.

The features that were learned are a table, (level, slot, features) or
(entry, features). Every position asks eight vertices of each level, and the
answers meet it in one equi-join; the table is broadcast behind a count, and
partial sums are taken before rows are shuffled.
"""

from __future__ import annotations

import io
import json
import math
import zipfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.session import bounded

#: Factors of x, y and z in the hashes of a vertex.
PRIMES = {
    "prime": (1958374283, 2654435761, 805459861),
    "coherent_prime": (1, 2654435761, 805459861),
    "reversed_prime": (2165219737, 1434869437, 2097192037),
}
#: Formats of the numbers in a file of weights.
FORMATS = {0: "<f4", 1: "<f2"}
#: Bytes of a model that the driver reads and ships.
MOST_BYTES = 256 << 20


@dataclass(frozen=True)
class Level:
    """A grid over the unit cube: positions times ``scale``, so many vertices along an axis, slots of the table."""

    scale: float
    vertices: int
    slots: int


def levels(n: int = 16, base: int = 16, growth: float = 2.0, log2_slots: int | None = 19) -> list[Level]:
    """n grids, each ``growth`` times as fine as the one before; without ``log2_slots`` each vertex has a slot of its own."""
    out = []
    for k in range(n):
        scale = base * growth**k - 1
        vertices = math.ceil(scale) + 1
        slots = -(-(vertices**3) // 8) * 8
        out.append(Level(scale, vertices, slots if log2_slots is None else min(slots, 1 << log2_slots)))
    return out


def slot(level: Level, at: list[Column], hashed: str = "prime") -> Column:
    """The slot of a vertex: its number, x fastest, or a hash of it where the level has fewer slots than vertices."""
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    if level.vertices**3 > level.slots:
        # a product of 64 bits by halves of the factor
        times = lambda c, p: c * F.lit(p % 65536) + c * F.lit(p // 65536) % 65536 * 65536
        x, y, z = (low(times(low(c), p)) for c, p in zip(at, PRIMES[hashed]))
        number = x.bitwiseXOR(y).bitwiseXOR(z)
    else:
        number = low(sum((c * F.lit(level.vertices**k).cast("long") for k, c in enumerate(at)), F.lit(0).cast("long")))
    return number % level.slots


def grid_encoded(df: DataFrame, table: DataFrame, grids: list[Level], width: int, keys: list[str], at: tuple = ("px", "py", "pz"), nearest: bool = False, hashed: str = "prime") -> DataFrame:
    """(keys, features) of each row of df, ``width`` features a level, the first level first.

    ``table`` holds (level, slot, features), each slot once; slots that it
    lacks count as zeros. Positions are parts of the unit cube, moved by half
    a cell; those outside wrap around. ``nearest`` takes the vertex below
    alone. A position of null or NaN has NaN for all features. Rows of equal
    keys are summed, so keys should tell rows apart.
    """
    corners = [(0, 0, 0)] if nearest else [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    clean = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(0.0))
    asked = []
    for n, level in enumerate(grids):
        place = [F.coalesce(clean(c), F.lit(0.0)) * level.scale + 0.5 for c in at]
        for corner in corners:
            weight = F.lit(1.0)
            for p, up in zip(place, corner):
                weight = weight * (F.lit(1.0) if nearest else p - F.floor(p) if up else 1 - (p - F.floor(p)))
            vertex = [F.floor(p).cast("long") + up for p, up in zip(place, corner)]
            asked.append(F.struct(F.lit(n).alias("level"), slot(level, vertex, hashed).alias("slot"), weight.alias("w")))
    bad = F.lit(False)
    for c in at:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    asked = df.select(*keys, bad.alias("bad"), F.explode(F.array(*asked)).alias("a")).select(*keys, "bad", "a.*")
    met = asked.join(bounded(table.select(F.col("level").cast("int").alias("level"), F.col("slot").cast("long").alias("slot"), F.col("features").alias("f"))), ["level", "slot"], "left")
    part = lambda n, k: F.when(F.col("level") == n, F.col("w") * F.coalesce(F.get("f", F.lit(k)).cast("double"), F.lit(0.0))).otherwise(0.0)
    sums = [F.sum(part(n, k)).alias(f"s{n}_{k}") for n in range(len(grids)) for k in range(width)]
    out = met.groupBy(*keys).agg(F.bool_or("bad").alias("bad"), *sums)
    nan = F.lit(float("nan"))
    return out.select(*keys, F.array(*[F.when(F.col("bad"), nan).otherwise(F.col(f"s{n}_{k}")) for n in range(len(grids)) for k in range(width)]).alias("features"))


def dictionary_encoded(df: DataFrame, table: DataFrame, width: int, keys: list[str], ids: str = "ids") -> DataFrame:
    """(keys, features): the entries of the numbers in ``ids``, one after the other; table holds (entry, features).

    Numbers are cut to integers. Entries that the table lacks, and null, give
    NaN; no numbers give an empty array. Keys must tell rows apart.
    """
    asked = df.select(*keys, F.posexplode_outer(ids).alias("at", "entry")).withColumn("entry", F.col("entry").cast("long"))
    met = asked.join(bounded(table.select(F.col("entry").cast("long").alias("entry"), F.col("features").alias("f"))), "entry", "left")
    none = F.array_repeat(F.lit(float("nan")), width)
    row = F.when(F.col("at").isNotNull(), F.struct("at", F.coalesce(F.col("f").cast("array<double>"), none).alias("f")))
    return met.groupBy(*keys).agg(F.flatten(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["f"])).alias("features"))


def composed(parts: list[Column], how: str = "concat", multiple: int = 1, length: int | None = None) -> Column:
    """Encodings as one: set side by side, added or multiplied; ones fill them up to a multiple where their length is given."""
    if how == "concat":
        out = F.concat(*parts)
    else:
        out = parts[0]
        for p in parts[1:]:
            out = F.zip_with(out, p, (lambda a, b: a + b) if how == "sum" else lambda a, b: a * b)
    return F.concat(out, F.array_repeat(F.lit(1.0), -length % multiple)) if length is not None and length % multiple else out


def unpacked(content: bytes, network: list[tuple[int, int]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Matrices (inputs, outputs) of the network's layers, and the numbers left over, which are the encoding's.

    Content begins with the numbers' format and count; a layer's matrix holds
    the weights of one output after those of another.
    """
    if len(content) < 8:
        raise ValueError("weights without a header")
    kind, count = (int(v) for v in np.frombuffer(content, "<u4", 2))
    if kind not in FORMATS:
        raise ValueError(f"numbers of format {kind}")
    if len(content) != 8 + count * np.dtype(FORMATS[kind]).itemsize:
        raise ValueError(f"{count} numbers don't fill {len(content)} bytes")
    values = np.frombuffer(content, FORMATS[kind], count, 8).astype(np.float64)
    if count < sum(i * o for i, o in network):
        raise ValueError(f"{count} numbers are too few for the network")
    out, at = [], 0
    for i, o in network:
        out.append(values[at : at + i * o].reshape(o, i).T)
        at += i * o
    return out, values[at:]


def grid_table(spark: SparkSession, values: np.ndarray, grids: list[Level], width: int) -> DataFrame:
    """The numbers of a grid encoding as (level, slot, features)."""
    slots = [g.slots for g in grids]
    if len(values) != sum(slots) * width:
        raise ValueError(f"{len(values)} numbers for {sum(slots)} slots of {width}")
    level = pa.array(np.repeat(np.arange(len(grids), dtype=np.int32), slots))
    flat = pa.array(np.ascontiguousarray(values, np.float64))
    features = pa.ListArray.from_arrays(pa.array(np.arange(sum(slots) + 1, dtype=np.int32) * width), flat)
    rows = [level, pa.array(np.concatenate([np.arange(n, dtype=np.int64) for n in slots])), features]
    return spark.createDataFrame(pa.Table.from_arrays(rows, ["level", "slot", "features"]))


def model(spark: SparkSession, path: str, most: int = MOST_BYTES) -> tuple[dict[str, dict], dict[str, bytes]]:
    """The descriptions (JSON) and the files of weights in a zip archive, by name.

    The archive is read by Spark, so any of its file systems will do; its size
    and that of what it unpacks to are checked before.
    """
    said = spark.read.format("binaryFile").load(path).select("length").collect()
    if len(said) != 1 or said[0][0] > most:
        raise ValueError(f"{path} is no single file of at most {most} bytes")
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if sum(i.file_size for i in z.infolist()) > most:
            raise ValueError(f"{path} unpacks to more than {most} bytes")
        files = {i.filename: z.read(i) for i in z.infolist()}
    return {n: json.loads(b) for n, b in files.items() if n.endswith(".json")}, {n: b for n, b in files.items() if n.endswith(".bin")}
