"""Packing documents into windows of tokens, planned by non-negative least squares.

Documents are tokenised once. Whole windows are cut off long documents; what
remains of each has a length below the window. Length combinations of up to
three bins that fill a window exactly are the columns of a least-squares
problem whose right side is the histogram of lengths. Its rounded solution,
and a greedy pass over what it leaves, say how many windows of each
combination to make; documents that no combination takes are laid end to end
and cut at the window's edge.

Only the histogram, one count for each length below the window, reaches the
driver. A document's place follows from its length and its rank among the
documents of that length, so placing needs no sort and no large group.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

WINDOW, BIN = 4096, 16


class WordIds:
    """Ids of the pieces of text between ASCII white space, as bytes, kept as they are met.

    The tokenizer splits at white space, between letters and marks, and folds
    case before it merges. So a text may be lower-cased and a mark parted from
    the word before it, and its ids are those of its pieces. Texts that may
    hold a special token stay as they are. At most ``most`` pieces are kept.
    """

    def __init__(self, path: str, most: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.pieces = Tokenizer.from_file(path), most, {}
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

    def _each(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _learn(self, new: list[str]) -> None:
        """Words of letters are encoded many to one text; the tokenizer tells which ids are whose."""
        words = [p for p in new if p.isalpha()]
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            owner = np.array(e.word_ids, np.int64)
            starts = np.searchsorted(owner, np.arange(len(part) + 1)).tolist()
            if len(owner) and owner[-1] + 1 == len(part) and len(set(starts)) == len(starts):
                data, n = np.array(e.ids, self.kind).tobytes(), np.dtype(self.kind).itemsize
                self.pieces.update((w, data[n * a : n * b]) for w, a, b in zip(part, starts, starts[1:]))
            else:
                self.pieces.update(zip(part, self._each(part)))
        rest = [p for p in new if not p.isalpha()]
        self.pieces.update(zip(rest, self._each(rest)))

    def encoded(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; null has none."""
        texts = pc.fill_null(texts, "")
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), "([a-z])([.,;:!?])([ \\n]|$)", "\\1 \\2\\3")
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, plain)
        lists = pc.ascii_split_whitespace(texts)
        cuts = lists.offsets.to_numpy()
        coded = pc.dictionary_encode(lists.flatten())
        known = coded.dictionary.to_pylist()
        new = [p for p in known if p not in self.pieces]
        if len(self.pieces) + len(new) > self.most:
            self.pieces, new = {}, known
        self._learn(new)
        ids = pa.array(map(self.pieces.__getitem__, known), pa.large_binary()).take(coded.indices)
        if not len(ids):
            return [b""] * len(texts)
        at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
        data = memoryview(ids.buffers()[2] or b"")
        ends = at[cuts - cuts[0]]
        return [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]


@lru_cache(maxsize=1)
def _ids_of(path: str) -> WordIds:
    """What a Python worker has met stays for its next tasks."""
    return WordIds(path)


def portions(column: pa.Array, chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows of about so many bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)) if len(column) else np.empty(0)
    start = 0
    while start < len(column):
        base = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, base + chars, side="right")))
        yield start, stop - start
        start = stop


def _tokenised(path: str, end: int, window: int):
    """mapInArrow function: (doc_id, text) to a row of ids, with its place in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids_of(path)
        width = np.dtype(ids.kind).itemsize
        last = np.array([end], ids.kind).tobytes()
        part, ranks, full = TaskContext.get().partitionId(), Counter(), 0
        for batch in batches:
            for k, size in portions(batch.column(1)):
                piece = batch.slice(k, size)
                rows = []
                for doc, found in zip(piece.column(0), ids.encoded(piece.column(1))):
                    found += last
                    n = len(found) // width
                    rest = n % window
                    rows.append((doc.as_py(), part, full, rest, ranks[rest], n, found))
                    ranks[rest] += 1
                    full += n // window
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                names = ["doc_id", "part", "full", "rest", "rank", "n", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return run


def combinations(present: np.ndarray, whole: int) -> list[tuple[int, ...]]:
    """Up to three bins of those present that add up to ``whole``, largest first."""
    on = set(map(int, present))
    found = [(whole,)] if whole in on else []
    found += [(a, whole - a) for a in sorted(on, reverse=True) if a >= whole - a and whole - a in on]
    for a in sorted(on, reverse=True):
        for b in range(min(a, whole - a - 1), 0, -1):
            c = whole - a - b
            if c > b:
                break
            if b in on and c in on:
                found.append((a, b, c))
    return found


def nnls(a: np.ndarray, b: np.ndarray, most: int = 600) -> np.ndarray:
    """Least squares with x >= 0, by an active set that grows with the steepest column."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(most):
        gain = np.where(free, -np.inf, a.T @ (b - a @ x))
        best = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or gain[best] <= 1e-9 * max(1.0, float(b.sum())):
            break
        free[best] = True
        while True:
            at = np.flatnonzero(free)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            bad = s <= 0
            old = x[at]
            step = (old[bad] / np.maximum(old[bad] - s[bad], 1e-300)).min()
            x[at] = old + step * (s - old)
            free[at[x[at] <= 1e-12]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


@dataclass
class Plan:
    """Where every (length, rank) goes; all arrays are bounded by the window."""

    window: int
    bin: int
    first: np.ndarray  # [length] documents of the bin that are shorter
    counts: np.ndarray  # [length]
    slot_bin: np.ndarray  # of each slot, in order of (bin, start)
    slot_start: np.ndarray
    slot_stop: np.ndarray
    slot_combination: np.ndarray
    slot_place: np.ndarray
    combos: list  # (first sequence, [slot starts], bins)
    spare_rank: np.ndarray  # [length] rank from which documents are laid end to end
    spare_base: np.ndarray  # [length] tokens before them
    spare_sequence: int

    def length_at(self, bin_: int, rank: int) -> int:
        """Length of the document with this rank in its bin."""
        low, high = (bin_ - 1) * self.bin + 1, min(bin_ * self.bin, self.window - 1)
        return low + int(np.searchsorted(self.first[low : high + 1], rank, side="right")) - 1

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of one rest."""
        if rank >= self.spare_rank[length]:
            at = int(self.spare_base[length] + (rank - self.spare_rank[length]) * length)
            room = self.window - at % self.window
            seq, off = self.spare_sequence + at // self.window, at % self.window
            if length <= room:
                return [(0, length, seq, off)]
            return [(0, room, seq, off), (room, length - room, seq + 1, 0)]
        bin_ = (length + self.bin - 1) // self.bin
        in_bin = int(self.first[length] + rank)
        low, high = np.searchsorted(self.slot_bin, [bin_, bin_ + 1])
        slot = int(low + np.searchsorted(self.slot_start[low:high], in_bin, side="right")) - 1
        turn = in_bin - int(self.slot_start[slot])
        base, starts, bins = self.combos[self.slot_combination[slot]]
        place = int(self.slot_place[slot])
        offset = sum(self.length_at(bins[k], starts[k] + turn) for k in range(place))
        return [(0, length, base + turn, offset)]


def plan(histogram: dict[int, int], window: int = WINDOW, bin_: int = BIN) -> Plan:
    """Combine lengths below the window; histogram has the documents of each length."""
    counts = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    whole = window // bin_
    bin_of = (np.arange(window + 1) + bin_ - 1) // bin_
    per_bin = np.bincount(bin_of, counts, whole + 1).astype(np.int64)
    before = np.cumsum(counts) - counts
    first = before - np.array([before[max((b - 1) * bin_ + 1, 0)] if b else 0 for b in bin_of])
    found = combinations(np.flatnonzero(per_bin), whole)
    times = np.zeros(len(found), np.int64)
    left = per_bin.copy()
    if found:
        a = np.zeros((whole + 1, len(found)))
        for k, bins in enumerate(found):
            for b in bins:
                a[b, k] += 1
        wanted = np.rint(nnls(a, per_bin.astype(float))).astype(np.int64)
        # the solution as far as whole documents allow it, then what still fits
        for goal in (wanted, np.full(len(found), np.iinfo(np.int64).max)):
            for k in np.lexsort((np.arange(len(found)), -np.minimum(goal, wanted))):
                need = Counter(found[k])
                n = min(int(goal[k]), min(int(left[b]) // m for b, m in need.items()))
                times[k] += n
                for b, m in need.items():
                    left[b] -= n * m
    used, sequence, slots, combos = np.zeros(whole + 1, np.int64), 0, [], []
    for k, bins in enumerate(found):
        if times[k]:
            starts = []
            for place, b in enumerate(bins):
                starts.append(int(used[b]))
                slots.append((b, int(used[b]), int(used[b] + times[k]), len(combos), place))
                used[b] += times[k]
            combos.append((sequence, starts, bins))
            sequence += int(times[k])
    slots = np.array(sorted(slots), np.int64).reshape(-1, 5)
    spare_rank = np.clip(used[bin_of] - first, 0, counts)
    spare = (counts - spare_rank) * np.arange(window + 1)
    return Plan(window, bin_, first, counts, *slots.T, combos, spare_rank, np.cumsum(spare) - spare, sequence)


def _placed(at: Plan, kind: str):
    """mapInArrow function: rows of ids, with ranks over all partitions, to pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, part, full, rest, rank, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(ids, kind)
                cuts = [(k * at.window, at.window, (part + 1 << 36) + full + k, 0) for k in range(n // at.window)]
                if rest:
                    head = n - rest
                    cuts += [(head + s, m, seq, off) for s, m, seq, off in at.pieces(rest, rank)]
                for start, length, seq, off in cuts:
                    crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
                    rows.append((doc, start, length, crc, n, seq, off))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return run


def packed(docs: DataFrame, path: str, end: int = 2, window: int = WINDOW) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all rows.

    A document is the ids of its text and then ``end``; null and empty texts
    are ``end`` alone. Repeated rows are packed as often as they come; a null
    doc_id stays null. Very long texts are tokenised whole and cut into
    windows. Other columns are left aside, so their names can't clash. An
    empty table gives no pieces.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, part int, full long, rest int, rank long, n long, ids binary"
    rows = written(docs.mapInArrow(_tokenised(path, end, window), schema), "ids")
    counts = rows.filter("rest > 0").groupBy("rest", "part").agg(F.count("*").alias("k"))
    turn = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("rest", "part", F.coalesce(F.sum("k").over(turn), F.lit(0)).alias("ahead"))
    histogram = {r["rest"]: r["k"] for r in counts.groupBy("rest").agg(F.sum("k").alias("k")).collect()}
    kind = WordIds(path).kind
    ranked = rows.join(ahead, ["rest", "part"], "left").select(
        "doc_id", "part", "full", "rest", (F.col("rank") + F.coalesce("ahead", F.lit(0))).alias("rank"), "n", "ids"
    )
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(_placed(plan(histogram, window), kind), out)


def stage(docs: DataFrame, path: str) -> DataFrame:
    return packed(docs, path)
