"""A bidirectional gated recurrent network with attention pooling, in numpy.

Steps are words. A word's input is its own embedding (words of the sample's
vocabulary) beside the mean embedding of its hashed character 4-grams, so
words never seen are read by their characters. Two gated recurrent layers run
over a window in both directions, attention weighs their states, and a linear
layer gives the logit of the window.
"""

from __future__ import annotations

import numpy as np

WORD_DIM = 8
CHAR_DIM = 8
HIDDEN = 8
ATTENTION = 8
CHAR_BUCKETS = 1 << 14
#: Embeddings that nothing teaches fade, so that a rare word or 4-gram decides nothing.
DECAYED, DECAY = ("word", "char"), 0.3
Arrays = dict[str, np.ndarray]


def char_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character 4-grams of all words with end marks, and where each word's begin."""
    padded = [b"^" + w + b"$$" for w in words]
    data = np.frombuffer(b"".join(padded), dtype=np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, padded), dtype=np.int64, count=len(padded))
    ends = np.cumsum(lengths)
    code = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
    code = (code * np.uint32(2654435761)) >> np.uint32(18)
    keep = np.ones(len(data), dtype=bool)
    for back in (1, 2, 3):
        keep[ends - back] = False
    starts = np.concatenate([[0], np.cumsum(lengths - 3)[:-1]])
    return code[keep[:len(code)]].astype(np.int64), starts


def init(vocabulary: int, seed: int) -> Arrays:
    rng = np.random.default_rng(seed)
    size, h = WORD_DIM + CHAR_DIM, HIDDEN
    p = {"word": rng.normal(0, 0.02, (vocabulary + 1, WORD_DIM)), "char": rng.normal(0, 0.02, (CHAR_BUCKETS, CHAR_DIM)),
         "att": rng.normal(0, 0.3, (2 * h, ATTENTION)), "att_b": np.zeros(ATTENTION), "att_v": rng.normal(0, 0.3, ATTENTION),
         "out": rng.normal(0, 0.3, 2 * h), "out_b": np.zeros(1)}
    p["word"][0] = 0
    for d in "fb":
        p |= {f"in_{d}": rng.normal(0, 0.3, (size, 3 * h)), f"in_b_{d}": np.zeros(3 * h), f"rec_{d}": rng.normal(0, 0.3, (h, 3 * h))}
    return {k: v.astype(np.float32) for k, v in p.items()}


def inputs(p: Arrays, word_ids: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Input vectors of distinct words."""
    counts = np.diff(np.append(starts, len(grams)))[:, None].astype(np.float32)
    return np.concatenate([p["word"][word_ids], np.add.reduceat(p["char"][grams], starts) / counts], axis=1)


def project(p: Arrays, x: np.ndarray) -> dict[str, np.ndarray]:
    return {d: x @ p[f"in_{d}"] + p[f"in_b_{d}"] for d in "fb"}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _layer(p: Arrays, d: str, table: np.ndarray, ids: np.ndarray, mask: np.ndarray, tape: list | None) -> np.ndarray:
    """States of one direction; ids and mask are steps x windows."""
    h, rec = HIDDEN, p[f"rec_{d}"]
    state = np.zeros((ids.shape[1], h), dtype=np.float32)
    states = np.empty((*ids.shape, h), dtype=np.float32)
    for t in range(len(ids)) if d == "f" else range(len(ids) - 1, -1, -1):
        x, a = table[ids[t]], state @ rec
        gates = _sigmoid(x[:, :2 * h] + a[:, :2 * h])
        z, r = gates[:, :h], gates[:, h:]
        c = np.tanh(x[:, 2 * h:] + r * a[:, 2 * h:])
        new = c + z * (state - c)
        if tape is not None:
            tape.append((t, state, z, r, c, a[:, 2 * h:]))
        state = new if mask is None else np.where(mask[t][:, None], new, state)
        states[t] = state
    return states


def _pool(p: Arrays, states: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, ...]:
    u = np.tanh(states @ p["att"] + p["att_b"])
    e = u @ p["att_v"]
    if mask is not None:
        e = np.where(mask, e, np.float32(-1e9))
    w = np.exp(e - e.max(axis=0))
    w /= w.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", w, states)
    return u, w, pooled, pooled @ p["out"] + p["out_b"][0]


def logits(p: Arrays, tables: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Logits of windows of word numbers (windows x steps); the mask is true at words."""
    steps, there = np.ascontiguousarray(ids.T), None if mask.all() else np.ascontiguousarray(mask.T)
    states = np.concatenate([_layer(p, d, tables[d], steps, there, None) for d in "fb"], axis=2)
    return _pool(p, states, there)[3]


def gradients(p: Arrays, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[Arrays, np.ndarray, np.ndarray]:
    """Gradients of the weighted log loss by parameters and by word inputs ``x``, and the logits."""
    h, steps, there = HIDDEN, np.ascontiguousarray(ids.T), np.ascontiguousarray(mask.T)
    tables, tapes = project(p, x), {"f": [], "b": []}
    states = np.concatenate([_layer(p, d, tables[d], steps, there, tapes[d]) for d in "fb"], axis=2)
    u, w, pooled, out = _pool(p, states, there)
    d_out = ((_sigmoid(out) - y) * weight / max(float(weight.sum()), 1.0)).astype(np.float32)
    g = {"out": pooled.T @ d_out, "out_b": d_out.sum(keepdims=True)}
    d_pooled = d_out[:, None] * p["out"]
    d_w = np.einsum("tnh,nh->tn", states, d_pooled)
    d_e = w * (d_w - (w * d_w).sum(axis=0))
    g["att_v"] = np.einsum("tn,tnk->k", d_e, u)
    d_u = d_e[:, :, None] * p["att_v"] * (1 - u * u)
    g["att"], g["att_b"] = np.einsum("tnh,tnk->hk", states, d_u), d_u.sum(axis=(0, 1))
    d_states = w[:, :, None] * d_pooled + d_u @ p["att"].T
    d_x = np.zeros_like(x)
    for d in "fb":
        rec, part = p[f"rec_{d}"], d_states[:, :, :h] if d == "f" else d_states[:, :, h:]
        d_rec, d_in = np.zeros_like(rec), np.zeros((*steps.shape, 3 * h), dtype=np.float32)
        carry = np.zeros((steps.shape[1], h), dtype=np.float32)
        for t, before, z, r, c, a in reversed(tapes[d]):
            m = there[t][:, None]
            full = part[t] + carry
            new = full * m
            d_c = new * (1 - z) * (1 - c * c)
            d_z, d_r = new * (before - c) * z * (1 - z), d_c * a * r * (1 - r)
            d_in[t] = np.concatenate([d_z, d_r, d_c], axis=1)
            d_a = np.concatenate([d_z, d_r, d_c * r], axis=1)
            d_rec += before.T @ d_a
            carry = full * ~m + new * z + d_a @ rec.T
        flat, at = d_in.reshape(-1, 3 * h), steps.ravel()
        d_table = scatter(at, flat, len(x))
        g |= {f"rec_{d}": d_rec, f"in_{d}": x.T @ d_table, f"in_b_{d}": d_table.sum(axis=0)}
        d_x += d_table @ p[f"in_{d}"].T
    return g, d_x, out


def scatter(at: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of value rows by target row."""
    return np.stack([np.bincount(at, column, rows) for column in values.T], axis=1).astype(np.float32)


class Adam:
    def __init__(self, p: Arrays, rate: float) -> None:
        self.rate, self.t = rate, 0
        self.m, self.v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))

    def step(self, p: Arrays, g: Arrays) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for k, grad in g.items():
            self.m[k] += 0.1 * (grad - self.m[k])
            self.v[k] += 0.001 * (grad * grad - self.v[k])
            p[k] -= (scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-7)).astype(np.float32)
            if k in DECAYED:
                p[k] *= np.float32(1 - DECAY * self.rate)
