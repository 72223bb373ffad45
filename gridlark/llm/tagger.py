"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Windows of characters go in as (time, window) arrays of symbols; tags come
out by Viterbi decoding. Training minimises the CRF's negative log likelihood
with Adam on windows whose spans are labelled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: 0 pads a window; 1 is any symbol beyond ASCII that is no letter, 2 a letter beyond ASCII.
SYMBOLS = 3 + 128


def symbols(text: str) -> np.ndarray:
    """A symbol for each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = (points + 3).astype(np.uint8, casting="unsafe")
    if (points > 127).any():
        far = np.flatnonzero(points > 127)
        out[far] = [2 if text[k].isalpha() else 1 for k in far]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(pre: np.ndarray, w: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states of one direction; pre has the input's part of the gates (T, N, 4H)."""
    steps, n, width = pre.shape
    size = width // 4
    h, c, out, trace = np.zeros((n, size), pre.dtype), np.zeros((n, size), pre.dtype), np.empty((steps, n, size), pre.dtype), []
    for t in range(steps):
        z = pre[t] + h @ w
        gates = _sigmoid(z[:, : 3 * size])
        g = np.tanh(z[:, 3 * size :])
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        before = (h, c)
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            trace.append((i, f, o, g, tc, *before))
    return out, trace


def _back(grad: np.ndarray, w: np.ndarray, trace: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates (T, N, 4H) and of w, from those of the hidden states."""
    steps, n, size = grad.shape
    dz, dw = np.empty((steps, n, 4 * size), grad.dtype), np.zeros_like(w)
    dh, dc = np.zeros((n, size), grad.dtype), np.zeros((n, size), grad.dtype)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, tc, h, c = trace[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz[t] = np.concatenate((dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), 1)
        dw += h.T @ dz[t]
        dh, dc = dz[t] @ w.T, dc * f
    return dz, dw


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


@dataclass
class Tagger:
    """Weights by name: embedding, two directions, emissions, transitions."""

    p: dict

    @classmethod
    def fresh(cls, tags: int, embedding: int = 12, hidden: int = 20, seed: int = 1) -> Tagger:
        rng = np.random.default_rng(seed)
        make = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {"emb": make(SYMBOLS, embedding) * 3, "out": make(2 * hidden, tags), "out_b": np.zeros(tags, np.float32), "trans": np.zeros((tags, tags), np.float32)}
        for d in "fb":
            p |= {f"x{d}": make(embedding, 4 * hidden), f"h{d}": make(hidden, 4 * hidden), f"b{d}": np.zeros(4 * hidden, np.float32)}
            p[f"b{d}"][hidden : 2 * hidden] = 1
        return cls(p)

    def emissions(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """(T, N) symbols to (T, N, tags) scores."""
        p, e = self.p, self.p["emb"][x]
        forth, tf = _run(e @ p["xf"] + p["bf"], p["hf"], keep)
        back, tb = _run((e @ p["xb"] + p["bb"])[::-1], p["hb"], keep)
        both = np.concatenate((forth, back[::-1]), 2)
        return both @ p["out"] + p["out_b"], (e, both, tf, tb)

    def decode(self, x: np.ndarray, block: int = 2048) -> np.ndarray:
        """The best tags (T, N) of (T, N) symbols."""
        out = np.empty(x.shape, np.uint8)
        for k in range(0, x.shape[1], block):
            em, _ = self.emissions(x[:, k : k + block])
            score, back = em[0], []
            for t in range(1, len(em)):
                step = score[:, :, None] + self.p["trans"]
                back.append(step.argmax(1))
                score = step.max(1) + em[t]
            best = score.argmax(1)
            out[-1, k : k + block] = best
            for t in range(len(em) - 1, 0, -1):
                best = back[t - 1][np.arange(len(best)), best]
                out[t - 1, k : k + block] = best
        return out

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        p = self.p
        em, (e, both, tf, tb) = self.emissions(x, keep=True)
        steps, n, tags = em.shape
        trans, eye, rows = p["trans"], np.eye(tags, dtype=np.float32), np.arange(n)
        ahead = np.empty_like(em)
        ahead[0] = em[0]
        for t in range(1, steps):
            ahead[t] = _log_sum(ahead[t - 1][:, :, None] + trans, 1) + em[t]
        after = np.zeros_like(em)
        for t in range(steps - 2, -1, -1):
            after[t] = _log_sum(trans + (em[t + 1] + after[t + 1])[:, None, :], 2)
        total = _log_sum(ahead[-1], 1)
        gold = sum(em[t][rows, y[t]] for t in range(steps)) + sum(trans[y[t - 1], y[t]] for t in range(1, steps))
        d_em = (np.exp(ahead + after - total[:, None]) - eye[y]) / n
        d_trans = np.zeros_like(trans)
        for t in range(1, steps):
            pair = ahead[t - 1][:, :, None] + trans + (em[t] + after[t])[:, None, :] - total[:, None, None]
            d_trans += np.exp(pair).sum(0) / n
            np.add.at(d_trans, (y[t - 1], y[t]), -1 / n)
        flat = d_em.reshape(-1, tags)
        grad = {"trans": d_trans, "out": both.reshape(len(flat), -1).T @ flat, "out_b": flat.sum(0)}
        d_both = d_em @ p["out"].T
        size = both.shape[2] // 2
        d_e = np.zeros_like(e)
        for d, part, trace in (("f", d_both[:, :, :size], tf), ("b", d_both[::-1, :, size:], tb)):
            dz, grad[f"h{d}"] = _back(part, p[f"h{d}"], trace)
            dz = dz if d == "f" else dz[::-1]
            flat = dz.reshape(-1, dz.shape[2])
            grad[f"x{d}"], grad[f"b{d}"] = e.reshape(len(flat), -1).T @ flat, flat.sum(0)
            d_e += dz @ p[f"x{d}"].T
        grad["emb"] = np.zeros_like(p["emb"])
        np.add.at(grad["emb"], x, d_e)
        return float((total - gold).mean()), grad

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 48, rate: float = 0.02, seed: int = 1) -> list[float]:
        """Adam with a falling rate over random batches of the windows; the losses."""
        rng, m, v, losses = np.random.default_rng(seed), {}, {}, []
        for t in range(1, steps + 1):
            pick = rng.integers(0, x.shape[1], batch)
            loss, grad = self.loss_and_gradient(x[:, pick], y[:, pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            now = rate * (1 - 0.95 * t / steps)
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / max(norm, 1e-9))
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                self.p[k] -= (now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
            losses.append(loss)
        return losses
