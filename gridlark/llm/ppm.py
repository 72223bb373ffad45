"""Prediction by partial matching over bytes, compiled for whole arrays of bytes.

A node of the trie is a context of up to ``ORDER`` bytes with the byte that
follows it, and its count. A byte costs what its longest known context says
of it; if that context has not met it, the context's escape is paid and the
next shorter one is asked, without the bytes that the longer one knows
(exclusion). Escapes are estimated by the number of distinct bytes that a
context has met (method C); beyond the empty context all bytes are alike.

Since the bytes known in a context are known in every shorter one too, what
exclusion removes depends on the context alone. So every lookup is one probe
of a hash table, done for all positions of a text at once.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

ORDER = 5
#: Stands before a text (as context) and once behind it (as its end).
EDGE = b"\0"
_ONE = np.uint64(1)


def _key(order: int, value: np.ndarray) -> np.ndarray:
    """A node's or context's key: its length above its bytes, which fill six at most."""
    return value | (np.uint64(order + 1) << np.uint64(56))


def _low(value: np.ndarray, size: int) -> np.ndarray:
    return value & ((_ONE << np.uint64(8 * size)) - _ONE)


def grams(texts: Iterable[bytes], chunk: int = 1 << 18):
    """Arrays of the (ORDER + 1)-byte windows of texts with their edges, and the text that each ends."""
    held, size, first = [], 0, 0
    for k, t in enumerate(texts):
        if len(t) > chunk:
            if held:
                yield _windows(held, first)
            whole = EDGE * ORDER + t + EDGE
            for s in range(0, len(t) + 1, chunk):
                found = _joined(whole[s : s + chunk + ORDER])
                yield found, np.full(len(found), k)
            held, size, first = [], 0, k + 1
            continue
        held.append(t)
        size += len(t)
        if size >= chunk:
            yield _windows(held, first)
            held, size, first = [], 0, k + 1
    if held:
        yield _windows(held, first)


def _joined(data: bytes) -> np.ndarray:
    points = np.frombuffer(data, np.uint8)
    total = np.zeros(len(points) - ORDER, np.uint64)
    for k in range(ORDER + 1):
        total <<= np.uint64(8)
        total |= points[k : len(points) - ORDER + k]
    return total


def _windows(texts: list[bytes], first: int) -> tuple[np.ndarray, np.ndarray]:
    total = _joined(b"".join(x for t in texts for x in (EDGE * ORDER, t, EDGE)))
    sizes = np.array([len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    # each text's windows start at its own edge; those over the next edge are left out
    at = np.arange(len(owner)) + owner * ORDER
    return total[at], owner + first


class Table:
    """A hash table from 64-bit keys to their places in an array."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2.5 * max(1, len(keys))).bit_length())
        size = 1 << self.bits
        self.keys, self.places = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            empty = self.places[slot] < 0
            _, one = np.unique(slot[empty], return_index=True)
            won = np.flatnonzero(empty)[one]
            self.keys[slot[won]], self.places[slot[won]] = keys[left[won]], left[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, slot = left[rest], (slot[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 where it isn't held."""
        slot = self._slot(keys)
        out = self.places[slot]
        left = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            out[left] = self.places[slot]
            again = (out[left] >= 0) & (self.keys[slot] != keys[left])
            left, slot = left[again], slot[again]
        return out


class Model:
    """The trie of nodes (order, bytes, count); a node's parents must be among them."""

    def __init__(self, orders: np.ndarray, values: np.ndarray, counts: np.ndarray):
        values = values.astype(np.uint64)
        self.counts = counts.astype(np.float64)
        keys = _key(0, values) + (orders.astype(np.uint64) << np.uint64(56))
        self.nodes = Table(keys)
        context = (values >> np.uint64(8)) | ((orders.astype(np.uint64) + _ONE) << np.uint64(56))
        known, where = np.unique(context, return_inverse=True)
        self.contexts = Table(known)
        # the last place, 0, is that of contexts that aren't known
        self.n = np.bincount(where, self.counts, len(known) + 1)
        self.d = np.bincount(where, minlength=len(known) + 1).astype(np.float64)
        # what a context's bytes count in the next shorter context
        shorter = np.zeros(len(values))
        for order in range(1, ORDER + 1):
            mine = np.flatnonzero(orders == order)
            if len(mine):
                found = self.nodes.find(_key(order - 1, _low(values[mine], order)))
                shorter[mine] = np.where(found >= 0, self.counts[found], 0)
        self.excluded = np.bincount(where, shorter, len(known) + 1)

    def costs(self, windows: np.ndarray) -> np.ndarray:
        """log10 of the probability of each window's last byte after the others."""
        out = np.zeros(len(windows))
        left = np.arange(len(windows))
        gone, gone_d = np.zeros(len(windows)), np.zeros(len(windows))
        for order in range(ORDER, -1, -1):
            w = windows[left]
            at = self.contexts.find(_key(order, _low(w >> np.uint64(8), order)))
            has = at >= 0
            n = np.where(has, self.n[at] - gone, 0.0)
            d = np.where(has, self.d[at] - gone_d, 0.0)
            node = np.full(len(left), -1)
            node[has] = self.nodes.find(_key(order, _low(w[has], order + 1)))
            met = node >= 0
            out[left[met]] += np.log10(self.counts[node[met]] / (n[met] + d[met]))
            miss = has & ~met & (d > 0)
            out[left[miss]] += np.log10(d[miss] / (n[miss] + d[miss]))
            stay = ~met
            gone = np.where(has, self.excluded[at], 0.0)[stay]
            gone_d = np.where(has, self.d[at], 0.0)[stay]
            left = left[stay]
            if not len(left):
                break
        if len(left):
            out[left] -= np.log10(256.0 - gone_d)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 of the probability of each text, its end included."""
        out = np.zeros(len(texts))
        for windows, owner in grams(texts):
            first = owner[0]
            part = np.bincount(owner - first, self.costs(windows))
            out[first : first + len(part)] += part
        return out
