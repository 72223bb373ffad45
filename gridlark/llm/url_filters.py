"""URL verdicts from a sorted, memory-mapped array of 64-bit digests.

A list of entries (host and path) becomes one file: sorted xxhash64 digests,
then the entries' strings. Every task maps the file, makes the keys that
could fit a url (each suffix of its host with each path prefix of a length
that the list has), finds all of them in one vectorised binary search, and
confirms each hit with the stored string, so equal digests of unlike strings
decide nothing.

Urls are judged row by row without a shuffle. The list is data of the job,
shipped once to each executor; its size is checked.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

# The rules of the contract, as (host, path, verdict), and the
# blocked hosts by which urls without a rule are judged.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
BLOCKED_NAMES = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")
BLOCKED_HOSTS = tuple(f"{name}.example.{top}" for name in BLOCKED_NAMES for top in ("com", "net", "org"))
MOST_BYTES = 1 << 30
_LOWER = {k: k + 32 for k in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty for null and where there is no ``://``."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [k for k in (rest.find(c) for c in "/?#") if k >= 0]
    host = rest[: min(ends)] if ends else rest
    path = rest[len(host) :]
    ends = [k for k in (path.find(c) for c in "?#") if k >= 0]
    return host.translate(_LOWER), path[: min(ends)] if ends else path


def built(entries: Iterable[tuple[str, str, str]]) -> bytes:
    """The file: counts, path lengths, sorted digests, ends of strings, strings.

    An entry is kept as host, path and verdict, divided by zero bytes; its
    digest is that of host and path. Entries that repeat are kept once.
    """
    texts = sorted({f"{h}\0{p}\0{v}".encode() for h, p, v in entries})
    keys = np.array([xxhash.xxh64_intdigest(t.rpartition(b"\0")[0]) for t in texts], "<u8")
    order = np.argsort(keys, kind="stable")
    lengths = sorted({len(t.split(b"\0")[1].decode()) for t in texts})
    depth = max((t.split(b"\0")[0].count(b".") + 1 for t in texts), default=0)
    ends = np.cumsum([0] + [len(texts[k]) for k in order]).astype("<u8")
    head = struct.pack("<3Q", len(texts), len(lengths), depth) + np.array(lengths, "<u8").tobytes()
    return head + keys[order].tobytes() + ends.tobytes() + b"".join(texts[k] for k in order)


class Index:
    """The mapped file; only the pages that probes touch are read."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        n, m, self.depth = struct.unpack("<3Q", data[:24].tobytes())
        at = 24 + 8 * m
        self.lengths = data[24:at].view("<u8").tolist()
        self.keys = data[at : at + 8 * n].view("<u8")
        self.ends = data[at + 8 * n : at + 16 * n + 8].view("<u8")
        self.strings = data[at + 16 * n + 8 :]

    def found(self, keys: list[bytes]) -> list[list[str]]:
        """The verdicts stored with each key (host and path); none for a key that isn't listed."""
        wanted = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        low = np.searchsorted(self.keys, wanted, "left")
        high = np.searchsorted(self.keys, wanted, "right")
        out: list[list[str]] = [[] for _ in keys]
        for k in np.flatnonzero(high > low):
            for at in range(low[k], high[k]):
                text, _, verdict = self.strings[int(self.ends[at]) : int(self.ends[at + 1])].tobytes().rpartition(b"\0")
                if text == keys[k]:
                    out[k].append(verdict.decode())
        return out

    def candidates(self, host: str, path: str) -> list[tuple[str, str]]:
        """Listed shapes that could fit, longest first: host suffixes with path prefixes."""
        labels = host.split(".")
        hosts = [".".join(labels[k:]) for k in range(max(0, len(labels) - self.depth), len(labels))]
        paths = [path[:n] for n in self.lengths if n <= len(path)]
        return sorted(((h, p) for h in hosts for p in paths), key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))


@lru_cache(maxsize=8)
def _mapped(path: str) -> Index:
    return Index(path)


def _judged(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _mapped(SparkFiles.get(name))
        for batch in batches:
            urls = [split_url(u) for u in batch.column(1).to_pylist()]
            shapes = [index.candidates(*u) for u in urls]
            hits = iter(index.found([f"{h}\0{p}".encode("utf-8", "surrogatepass") for s in shapes for h, p in s]))
            rules, verdicts = [], []
            for s in shapes:
                listed = [(h, p, v) for (h, p), vs in zip(s, hits) for v in vs]
                rule = next((x for x in listed if x[2] in ("allow", "block")), None)
                rules.append(rule and rule[0] + rule[1])
                verdicts.append(rule[2] if rule else "block" if any(x[2] == "listed" for x in listed) else "allow")
            cols = [batch.column(0), *(pa.array(c, pa.string()) for c in ([h for h, _ in urls], [p for _, p in urls], rules, verdicts))]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "host", "path", "rule", "verdict"])

    return run


def shipped(spark: SparkSession, data: bytes) -> str:
    """Put the file into the shared folder and let Spark bring it to every executor; its name there."""
    if len(data) > MOST_BYTES:
        raise ValueError(f"the list takes {len(data)} bytes; up to {MOST_BYTES} are shipped to each executor")
    sc = spark.sparkContext
    name = f"urls-{hashlib.blake2b(data, digest_size=12).hexdigest()}.bin"
    if not any(str(f).endswith(name) for f in sc.listFiles):
        place = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
        out = place.getFileSystem(sc._jsc.hadoopConfiguration()).create(place, True)
        out.write(bytearray(data))
        out.close()
        sc.addFile(place.toString())
    return name


def verdicts(pages: DataFrame, rules: Iterable[tuple] = RULES, blocked: Iterable[str] = BLOCKED_HOSTS) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages.

    The longest rule that fits decides. Without one, a url whose host or
    parent domain is blocked is blocked, and any other allowed. A null url,
    or one without ``://``, has empty host and path and is allowed. Very long
    urls are judged whole; other columns are left aside, so their names can't
    clash. Repeated rows are judged alike; an empty table gives an empty table.
    """
    data = built([*rules, *((h, "", "listed") for h in blocked)])
    name = shipped(pages.sparkSession, data)
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    return pages.mapInArrow(_judged(name), "page_id long, host string, path string, rule string, verdict string")
