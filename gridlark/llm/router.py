"""Learned partitions of vectors: a balanced cut of a neighbour graph, and a classifier that routes.

Fitted in numpy on a bounded sample. The nearest-neighbour graph of the
sample is cut into parts of equal size that keep neighbours together; a
network with one hidden layer then learns, for a vector, in which parts its
neighbours lie. It places every indexed vector, and names the parts to probe
for a query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def neighbours(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """The k rows of the largest inner product with each row, but itself."""
    out = np.empty((len(x), k), np.int64)
    for s in range(0, len(x), block):
        sim = x[s : s + block] @ x.T
        sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = -np.inf
        out[s : s + block] = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return out


def _even(gain: np.ndarray, room: int) -> np.ndarray:
    """Give each row the column of its largest gain that has room, surest rows first."""
    rows, cols = gain.shape
    order = np.argsort(-gain, axis=1)
    top = np.take_along_axis(gain, order[:, :2], 1)
    sure = top[:, 0] - top[:, 1] if cols > 1 else top[:, 0]
    left, out = np.full(cols, room), np.zeros(rows, np.int64)
    for r in np.argsort(-sure, kind="stable"):
        c = next(c for c in order[r] if left[c])
        out[r], left[c] = c, left[c] - 1
    return out


def balanced_cut(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 6, slack: float = 1.05, seed: int = 3) -> np.ndarray:
    """A part for each row, of nearly equal sizes, with few graph edges between parts.

    Starts from balanced centroids and then lets every row go where most of
    its neighbours are, as long as there is room.
    """
    rng, n = np.random.default_rng(seed), len(x)
    room = int(np.ceil(n / parts * slack))
    centres = x[rng.choice(n, parts, replace=False)]
    for _ in range(4):
        mine = _even(x @ centres.T, room)
        centres = np.stack([x[mine == p].mean(0) if (mine == p).any() else x[rng.integers(n)] for p in range(parts)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    pull = x @ centres.T
    a, b = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (a, mine[b]), 1.0)
        np.add.at(votes, (b, mine[a]), 1.0)
        now = _even(votes + 0.01 * pull, room)
        if (now == mine).all():
            break
        mine = now
    return mine


@dataclass
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def best(self, x: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` most probable parts of each row, most probable first."""
        score = self.logits(x)
        return np.argsort(-score, axis=1, kind="stable")[:, :count]


def fitted(sample: np.ndarray, parts: int, k: int = 20, hidden: int = 96, epochs: int = 25, seed: int = 3) -> Router:
    """The router of a sample of vectors; one part needs no sample."""
    rng, dims = np.random.default_rng(seed), sample.shape[1]
    if parts == 1:
        return Router(np.zeros((dims, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    x = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    graph = neighbours(x, min(k, len(x) - 1))
    mine = balanced_cut(x, graph, parts)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), graph.shape[1]), mine[graph.ravel()]), 1.0 / graph.shape[1])
    goal = 0.7 * goal + 0.3 * np.eye(parts)[mine]
    p = [rng.standard_normal((dims, hidden)) * np.sqrt(2 / dims) * 2, np.zeros(hidden), rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
    m, v, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    size = max(1, min(256, len(x)))
    steps = max(1, epochs * len(x) // size)
    for t in range(1, steps + 1):
        pick = rng.integers(0, len(x), size)
        xb = x[pick]
        h = np.maximum(xb @ p[0] + p[1], 0)
        z = h @ p[2] + p[3]
        z = np.exp(z - z.max(1, keepdims=True))
        d = (z / z.sum(1, keepdims=True) - goal[pick]) / size
        dh = (d @ p[2].T) * (h > 0)
        for i, g in enumerate((xb.T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] -= 0.01 * (1 - 0.9 * t / steps) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    # vectors are routed by direction: the first layer takes them normalised
    return Router(*p)


def probes_for(router: Router, index: np.ndarray, queries: np.ndarray, k: int, target: float) -> int:
    """The fewest parts to probe for ``target`` recall of the k nearest, measured by brute force."""
    parts = len(router.b2)
    if parts == 1 or not len(queries):
        return parts
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    near = np.argsort(-(queries @ index.T), axis=1)[:, :k]
    home = router.best(unit(index), 1)[:, 0][near]
    rank = np.argsort(router.best(unit(queries), parts), axis=1)
    found = np.take_along_axis(rank, home, 1)
    return next(t for t in range(1, parts + 1) if t == parts or (found < t).mean() >= target)
