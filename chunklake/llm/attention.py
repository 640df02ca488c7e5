"""A small causal self-attention model in numpy: one head, residual; inputs are subwords (rare ones by class), outputs a tree of two levels over classes of subwords."""

from __future__ import annotations

import ctypes
import functools
from dataclasses import dataclass

import numpy as np

SHAPES = ("emb", "pos", "qkv", "out", "top", "leaf")


@dataclass(frozen=True)
class Shape:
    """groups of classes and classes of a group (a class is predicted as its group, then its place in it), subwords that have an input vector of their own, width of the vectors, positions of a window and how many of them a next window sees again."""

    groups: int = 16
    leaves: int = 16
    frequent: int = 2048
    width: int = 16
    window: int = 32
    overlap: int = 8

    @property
    def classes(self) -> int:
        return self.groups * self.leaves


def fresh(shape: Shape, class_counts: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Untrained weights; the last rows of `top` and `leaf` are the classes' own log probabilities, so that training starts from the unigram model."""
    rng = np.random.default_rng(seed)
    d, w, inputs = shape.width, shape.window, shape.frequent + shape.classes + 1
    n = (class_counts + 1.0).reshape(shape.groups, shape.leaves)
    draw = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
    top, leaf = draw(d + 1, shape.groups) * np.float32(0.1), draw(shape.groups, d + 1, shape.leaves) * np.float32(0.1)
    top[-1], leaf[:, -1] = np.log(n.sum(axis=1) / n.sum()), np.log(n / n.sum(axis=1, keepdims=True))
    return {"emb": draw(inputs, d), "pos": draw(w, d) * np.float32(0.3), "qkv": draw(d, 3 * d), "out": draw(d, d) * np.float32(0.5), "top": top, "leaf": leaf}


def pack(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[n].ravel() for n in SHAPES])


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for n in SHAPES:
        out[n] = flat[at : at + like[n].size].reshape(like[n].shape).astype(np.float32)
        at += like[n].size
    return out


@functools.cache
def _causal(w: int, kind: str) -> np.ndarray:
    return np.tril(np.ones((w, w), kind))


def keep_arrays_mapped() -> None:
    """Asks glibc to serve arrays of up to 4 MB from its heap: by default those of 128 KB are mapped and unmapped at each step, and page faults cost a third of the time."""
    set_option = getattr(ctypes.CDLL(None), "mallopt", None)
    if set_option:
        set_option(-3, 4 << 20)
        set_option(-1, 32 << 20)


def _turned(x: np.ndarray) -> np.ndarray:
    """Each window's matrix transposed and laid out anew: small products with a view cost twice as much."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


def _weighed(q: np.ndarray, k: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of q (of the last positions) times k for keys up to each query, and their sums; `safe` shifts each query's products, so that none overflow or all vanish."""
    b, n, w = len(q), q.shape[1], k.shape[1]
    a = q @ _turned(k)
    seen = _causal(w, a.dtype.str)[w - n :]
    if safe:
        a -= np.where(seen > 0, a, -np.inf).max(axis=2, keepdims=True)
        np.minimum(a, 0, out=a)  # of keys after the query
    np.exp(a, out=a)
    a *= seen
    return a, (a.reshape(b * n, w) @ np.ones(w, a.dtype)).reshape(b, n, 1)


def _attended(p: dict[str, np.ndarray], qkv: np.ndarray, inputs: np.ndarray, safe: bool):
    """x, q, k, v, attention weights before and sums for their normalisation, the attended values c, and h (with a last column of ones), a row a position."""
    b, w = inputs.shape
    d = p["out"].shape[0]
    x = p["emb"].take(inputs.ravel(), axis=0).reshape(b, w, d)
    x += p["pos"]
    x = x.reshape(b * w, d)
    y = (x @ qkv).reshape(b, w, 3 * d)
    q, k, v = (y[:, :, i * d : (i + 1) * d] for i in range(3))
    a, total = _weighed(q, k, safe)
    c = a @ v
    c /= total
    c = c.reshape(b * w, d)
    h = np.empty((b * w, d + 1), x.dtype)
    h[:, -1] = 1
    np.add(x, c @ p["out"], out=h[:, :-1])
    return x, q, k, v, a, total, c, h


def _exponentials(z: np.ndarray, picked: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
    """z becomes its exponentials; the entries at the picked places of the flat z as they were, and the sums by row, are returned."""
    if safe:
        z -= z.max(axis=1, keepdims=True)
    one = z.ravel().take(picked)
    np.exp(z, out=z)
    return one, z @ np.ones((z.shape[1], 1), z.dtype)


def _less_the_target(z: np.ndarray, picked: np.ndarray, share: np.ndarray, safe: bool) -> np.ndarray:
    """z becomes the gradient of its logits: softmax by row less 1 at the picked place, times the row's share."""
    _, total = _exponentials(z, picked, safe)
    z *= share / total
    z.ravel()[picked] -= share[:, 0]
    return z


def _spread(h: np.ndarray, leaf: np.ndarray, group: np.ndarray):
    """Positions in the order of their target's group, the cuts between groups, their h, and the logits within the group."""
    order = np.argsort(group, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(leaf)))]).tolist()
    hs = h.take(order, axis=0)
    z = np.empty((len(h), leaf.shape[2]), h.dtype)
    for g, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if hi > lo:
            np.matmul(hs[lo:hi], leaf[g], out=z[lo:hi])
    return order, cuts, hs, z


class Scorer:
    """ln P(class) at every position of windows: of its group, and of its place in the group. Weights are folded once."""

    def __init__(self, p: dict[str, np.ndarray]):
        keep_arrays_mapped()
        d = p["out"].shape[0]
        q, k, v = (p["qkv"][:, i * d : (i + 1) * d] for i in range(3))
        self.p, self.q, self.kv = p, q * q.dtype.type(d**-0.5), np.concatenate([k, v @ p["out"]], axis=1)

    def __call__(self, inputs: np.ndarray, targets: np.ndarray, skip: int = 0) -> np.ndarray:
        """Of the positions from `skip` on; those before are only looked back at."""
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            out = self._score(inputs, targets[:, skip:], skip, False)
        return out if np.isfinite(out).all() else self._score(inputs, targets[:, skip:], skip, True)  # exponentials rarely overflow

    def _score(self, inputs: np.ndarray, targets: np.ndarray, skip: int, safe: bool) -> np.ndarray:
        p, (b, w), n = self.p, inputs.shape, targets.shape[1]
        groups, d, leaves = p["leaf"].shape[0], p["out"].shape[0], p["leaf"].shape[2]
        x = p["emb"].take(inputs.ravel(), axis=0).reshape(b, w, d)
        x += p["pos"]
        own = np.ascontiguousarray(x[:, skip:]).reshape(b * n, d)
        q, kv = (own @ self.q).reshape(b, n, d), (x.reshape(b * w, d) @ self.kv).reshape(b, w, 2 * d)
        a, total = _weighed(q, kv[:, :, :d], safe)
        c = a @ kv[:, :, d:]
        c /= total
        h = np.empty((b * n, d + 1), x.dtype)
        h[:, -1] = 1
        np.add(own, c.reshape(b * n, d), out=h[:, :-1])
        at, target = np.arange(b * n), targets.ravel()
        group = (target // leaves).astype(np.uint8)
        one, total = _exponentials(h @ p["top"], at * groups + group, safe)
        out = (one - np.log(total[:, 0])).astype(np.float64)
        order, _, _, z = _spread(h, p["leaf"], group)
        one, total = _exponentials(z, at * leaves + target.take(order) % leaves, safe)
        out[order] += one - np.log(total[:, 0])
        return out.reshape(b, n)


def log_probs(p: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
    return Scorer(p)(inputs, targets)


def gradients(p: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, real: np.ndarray, out: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Of the mean negative log probability over the real positions; written into `out`, if given."""
    g = {k: np.empty_like(v) for k, v in p.items()} if out is None else out
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        _gradients(p, inputs, targets, real, g, False)
    if not all(np.isfinite(g[n]).all() for n in ("pos", "top", "out")):  # exponentials rarely overflow
        _gradients(p, inputs, targets, real, g, True)
    return g


def _gradients(p: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, real: np.ndarray, g: dict[str, np.ndarray], safe: bool) -> None:
    b, w = inputs.shape
    groups, _, leaves = p["leaf"].shape
    d, n = p["out"].shape[0], max(1, int(real.sum()))
    scale = p["qkv"].dtype.type(d**-0.5)
    qkv = p["qkv"].copy()
    qkv[:, :d] *= scale
    x, q, k, v, a, total, c, h = _attended(p, qkv, inputs, safe)
    at, target = np.arange(b * w), targets.ravel()
    group = (target // leaves).astype(np.uint8)
    share = (real.ravel() / n).astype(h.dtype)[:, None]
    z = _less_the_target(h @ p["top"], at * groups + group, share, safe)
    np.matmul(h.T, z, out=g["top"])
    dh = z @ p["top"][:-1].T
    order, cuts, hs, z = _spread(h, p["leaf"], group)
    z = _less_the_target(z, at * leaves + target.take(order) % leaves, share.take(order, axis=0), safe)
    dhs = np.empty_like(dh)
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        np.matmul(hs[lo:hi].T, z[lo:hi], out=g["leaf"][i])
        if hi > lo:
            np.matmul(z[lo:hi], p["leaf"][i, :-1].T, out=dhs[lo:hi])
    back = np.empty_like(order)
    back[order] = at
    dh += dhs.take(back, axis=0)
    np.matmul(c.T, dh, out=g["out"])
    dc = dh @ p["out"].T
    along = np.einsum("ij,ij->i", dc, c)  # the sum over each row of da * a
    dc = dc.reshape(b, w, d)
    dc /= total  # so that a needn't be normalised
    ds = dc @ _turned(v)
    ds -= along.reshape(b, w, 1) / total
    ds *= a
    dqkv = np.empty((b, w, 3 * d), dh.dtype)
    np.matmul(ds, k, out=dqkv[:, :, :d])
    np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[:, :, d : 2 * d])
    np.matmul(a.transpose(0, 2, 1), dc, out=dqkv[:, :, 2 * d :])
    dqkv = dqkv.reshape(b * w, 3 * d)
    np.matmul(x.T, dqkv, out=g["qkv"])
    g["qkv"][:, :d] *= scale
    dh += dqkv @ qkv.T
    np.sum(dh.reshape(b, w, d), axis=0, out=g["pos"])
    ids = inputs.ravel()
    ids = ids.astype(np.uint16) if len(p["emb"]) <= 0xFFFF else ids  # sorts faster
    order = np.argsort(ids, kind="stable")
    ids = ids.take(order)
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    g["emb"].fill(0)
    g["emb"][ids[first]] = np.add.reduceat(dh.take(order, axis=0), first, axis=0)


def _views(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for n in SHAPES:
        out[n] = flat[at : at + like[n].size].reshape(like[n].shape)
        at += like[n].size
    return out


def train(p: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, real: np.ndarray, seed: int, rate: float = 4e-2, batch: int = 256) -> dict[str, np.ndarray]:
    """Adam over the windows, each once, in an order drawn from seed; the step falls to a fifth by the end."""
    keep_arrays_mapped()
    flat = pack(p)
    p = _views(flat, p)  # one step moves them all
    g, m, s, step = (np.zeros_like(flat) for _ in range(4))
    grads = _views(g, p)
    order = np.random.default_rng(seed).permutation(len(inputs))
    for t, lo in enumerate(range(0, len(order), batch), 1):
        at = order[lo : lo + batch]
        gradients(p, inputs[at], targets[at], real[at], grads)
        m *= np.float32(0.9)
        m += np.multiply(g, np.float32(0.1), out=step)
        s *= np.float32(0.99)
        g *= g
        s += np.multiply(g, np.float32(0.01), out=step)
        np.sqrt(s, out=step)
        step += np.float32(1e-8)
        np.divide(m, step, out=step)
        step *= np.float32(rate * (1 - 0.8 * lo / len(order)) * (1 - 0.99**t) ** 0.5 / (1 - 0.9**t))
        flat -= step
    return p


def windows(sizes: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many tokens, laid end to end: text, first token and first scored token (both within the text) of every window.

    Windows overlap by `overlap` tokens and each token is scored in one of them only.
    """
    step = shape.window - shape.overlap
    n = np.where(sizes <= shape.window, 1, 1 + -(-(sizes - shape.window) // step))
    text = np.repeat(np.arange(len(sizes)), n)
    place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, place * step, np.where(place > 0, place * step + shape.overlap, 0)
