"""A gated recurrent unit with class-factored softmax in numpy: truncated backpropagation, state carried across windows.

Scoring keeps a step's streams, or a class's tokens, side by side in the last axis, so that gates are whole blocks
and sums over units run along rows of memory. Training keeps rows: its larger arrays gain nothing by that.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np

HIDDEN, EMBEDDING = 16, 12
#: Units in a class and classes; units are the end, tail buckets and words, by falling count.
WIDTH, CLASSES = 32, 32
UNITS = WIDTH * CLASSES
#: Steps of a truncated backpropagation and of a scoring window, and streams side by side.
TRAIN_STEPS, TRAIN_STREAMS, SCORE_STEPS, SCORE_STREAMS = 16, 512, 64, 256
RATE, CLIP = 0.01, 5.0


class Params(NamedTuple):
    e: np.ndarray  # UNITS x EMBEDDING
    wx: np.ndarray  # EMBEDDING x 3 HIDDEN: update, reset, new
    b: np.ndarray
    u: np.ndarray  # HIDDEN x 3 HIDDEN
    wc: np.ndarray  # HIDDEN x CLASSES
    bc: np.ndarray
    ww: np.ndarray  # CLASSES x WIDTH x HIDDEN
    bw: np.ndarray  # CLASSES x WIDTH


def _shapes() -> list[tuple[int, ...]]:
    return [(UNITS, EMBEDDING), (EMBEDDING, 3 * HIDDEN), (3 * HIDDEN,), (HIDDEN, 3 * HIDDEN), (HIDDEN, CLASSES), (CLASSES,), (CLASSES, WIDTH, HIDDEN), (CLASSES, WIDTH)]


def start(counts: np.ndarray, seed: int = 7) -> Params:
    """Small random weights; output biases give the units' shares of counts."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 0.1, s).astype(np.float32) for s in _shapes()]
    share = (counts.astype(np.float64) + 0.5).reshape(CLASSES, WIDTH)
    share /= share.sum()
    p[2][:] = 0
    p[5] = np.log(share.sum(1)).astype(np.float32)
    p[7] = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)
    return Params(*p)


def flat(p: Params) -> np.ndarray:
    return np.concatenate([x.ravel() for x in p])


def unflat(v: np.ndarray) -> Params:
    out, at = [], 0
    for s in _shapes():
        n = int(np.prod(s))
        out.append(v[at : at + n].reshape(s).astype(np.float32))
        at += n
    return Params(*out)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _softmax(x: np.ndarray) -> np.ndarray:
    """Rows of x turned into probabilities in place; (the same array)."""
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def pack(docs: list[np.ndarray], streams: int) -> tuple[np.ndarray, np.ndarray]:
    """(targets, owner), steps x streams: whole documents one behind another in streams of like length; owner -1 is padding.

    Streams come longest first, so the active ones at any step are the first ones.
    """
    slots: list[list[int]] = [[] for _ in range(min(streams, len(docs)))]
    heap = [(0, k) for k in range(len(slots))]
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        n, k = heapq.heappop(heap)
        slots[k].append(d)
        heapq.heappush(heap, (n + len(docs[d]), k))
    order = [k for _, k in sorted(heap, reverse=True)]
    steps = max(n for n, _ in heap)
    targets, owner = np.zeros((steps, len(slots)), np.int32), np.full((steps, len(slots)), -1, np.int32)
    for col, k in enumerate(order):
        at = 0
        for d in slots[k]:
            targets[at : at + len(docs[d]), col] = docs[d]
            owner[at : at + len(docs[d]), col] = d
            at += len(docs[d])
    return targets, owner


def log_likelihoods(p: Params, docs: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log probability of each document: units that close with end, read from a zero state that windows hand on."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    gates = p.e @ p.wx + p.b
    ut = np.ascontiguousarray(p.u.T)
    targets, owner = pack(docs, SCORE_STREAMS)
    h = np.zeros((HIDDEN, targets.shape[1]), np.float32)
    last = np.zeros(targets.shape[1], np.int32)
    before = np.full(targets.shape[1], -1, np.int32)
    for at in range(0, len(targets), SCORE_STEPS):
        t, o = targets[at : at + SCORE_STEPS], owner[at : at + SCORE_STEPS]
        active = int((o[0] >= 0).sum())
        t, o = t[:, :active], o[:, :active]
        h, last, before = h[:, :active], last[:active], before[:active]
        inputs = np.vstack([last[None], t[:-1]])
        first = np.vstack([before[None], o[:-1]]) != o
        inputs[first] = end
        x = np.ascontiguousarray(gates[inputs].transpose(0, 2, 1))
        states = np.empty((len(t), HIDDEN, active), np.float32)
        fresh = first.any(axis=1)
        for s in range(len(t)):
            if fresh[s]:
                h = h * ~first[s]
            g = x[s]
            hu = ut @ h
            g[: 2 * HIDDEN] += hu[: 2 * HIDDEN]
            zr = _sigmoid(g[: 2 * HIDDEN])
            n = zr[HIDDEN:] * hu[2 * HIDDEN :]
            n += g[2 * HIDDEN :]
            np.tanh(n, out=n)
            h = h - n
            h *= zr[:HIDDEN]
            h += n
            states[s] = h
        last, before = t[-1], o[-1]
        real = o >= 0
        out += np.bincount(o[real], _log_probs(p, states.transpose(0, 2, 1)[real], t[real]), len(docs))
    return out


def _log_probs(p: Params, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log P(class | h) + log P(unit | class, h) of each target."""
    cls = target // WIDTH
    order = np.argsort(cls.astype(np.int16), kind="stable")
    h, cls, word = h[order], cls[order], target[order] % WIDTH
    rows = np.arange(len(h))

    def log_share(logits: np.ndarray, own: np.ndarray, rows: np.ndarray) -> np.ndarray:
        logits -= logits.max(0)
        picked = logits[own, rows]
        return picked - np.log(np.exp(logits, out=logits).sum(0))

    found = log_share(p.wc.T @ h.T + p.bc[:, None], cls, rows)
    bounds = np.searchsorted(cls, np.arange(CLASSES + 1))
    for c in range(CLASSES):
        a, b = bounds[c], bounds[c + 1]
        if a < b:
            found[a:b] += log_share(p.ww[c] @ h[a:b].T + p.bw[c][:, None], word[a:b], rows[: b - a])
    out = np.empty_like(found)
    out[order] = found
    return out


def train(p: Params, docs: list[np.ndarray], end: int, rate: float = RATE) -> tuple[Params, int]:
    """One pass of truncated backpropagation (Adam) over all tokens of documents; (new parameters, tokens seen).

    The documents, each closed by end, are one sequence that is cut into TRAIN_STREAMS streams of equal
    length. State is carried from window to window and is zero behind an end and at a stream's beginning.
    """
    if not docs:
        return p, 0
    p = Params(*[x.copy() for x in p])
    line = np.concatenate(docs).astype(np.int32)
    seen = len(line)
    streams = min(TRAIN_STREAMS, -(-seen // TRAIN_STEPS))
    steps = -(-seen // streams)
    before = np.concatenate([[end], line[:-1]])
    pad = steps * streams - seen
    targets = np.concatenate([line, np.full(pad, end)]).reshape(streams, steps).T
    inputs = np.concatenate([before, np.full(pad, end)]).reshape(streams, steps).T
    real = (np.arange(steps * streams) < seen).reshape(streams, steps).T
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    h = np.zeros((streams, HIDDEN), np.float32)
    for k, at in enumerate(range(0, steps, TRAIN_STEPS), 1):
        i, t, r = (np.ascontiguousarray(x[at : at + TRAIN_STEPS]) for x in (inputs, targets, real))
        grads, h = _gradients(p, h, i, t, i == end, r)
        step = rate * np.sqrt(1 - 0.999**k) / (1 - 0.9**k)
        for x, g, a, b in zip(p, grads, m, v, strict=True):
            np.clip(g, -CLIP, CLIP, out=g)
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            x -= step * a / (np.sqrt(b) + 1e-8)
    return p, seen


def _gradients(p: Params, h0: np.ndarray, inputs: np.ndarray, targets: np.ndarray, first: np.ndarray, real: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Gradients of the mean loss over one window (steps x streams), and the state after it."""
    steps, streams = inputs.shape
    hd, kind = HIDDEN, p.e.dtype
    gates = p.e @ p.wx + p.b
    x = gates[inputs]
    hs = np.empty((steps + 1, streams, hd), kind)
    zr = np.empty((steps, streams, 2 * hd), kind)
    n, un, hin = (np.empty((steps, streams, hd), kind) for _ in range(3))
    hs[0] = h0
    keep = (~first)[:, :, None]
    some = first.any(axis=1)
    for s in range(steps):
        if some[s]:
            np.multiply(hs[s], keep[s], out=hin[s])
        else:
            hin[s] = hs[s]
        hu = hin[s] @ p.u
        un[s] = hu[:, 2 * hd :]
        zr[s] = _sigmoid(x[s, :, : 2 * hd] + hu[:, : 2 * hd])
        n[s] = np.tanh(x[s, :, 2 * hd :] + zr[s, :, hd:] * un[s])
        hs[s + 1] = n[s] + zr[s, :, :hd] * (hin[s] - n[s])
    z, r = zr[:, :, :hd], zr[:, :, hd:]
    # rows by class, so that a class's rows are one block
    t, w = targets.ravel(), real.ravel().astype(kind)
    w /= max(1.0, w.sum())
    order = np.argsort((t // WIDTH).astype(np.int16), kind="stable")
    h, w = hs[1:].reshape(-1, hd)[order], w[order]
    cls, word = t[order] // WIDTH, t[order] % WIDTH
    rows = np.arange(len(t))
    pc = _softmax(h @ p.wc + p.bc)
    pc[rows, cls] -= 1
    pc *= w[:, None]
    dwc, dbc, dh = h.T @ pc, pc.sum(0), pc @ p.wc.T
    dww, dbw = np.zeros_like(p.ww), np.zeros_like(p.bw)
    bounds = np.searchsorted(cls, np.arange(CLASSES + 1))
    for c in range(CLASSES):
        a, b = bounds[c], bounds[c + 1]
        if a < b:
            q = _softmax(h[a:b] @ p.ww[c].T + p.bw[c])
            q[rows[: b - a], word[a:b]] -= 1
            q *= w[a:b, None]
            dww[c], dbw[c] = q.T @ h[a:b], q.sum(0)
            dh[a:b] += q @ p.ww[c]
    back = np.empty_like(dh)
    back[order] = dh
    dh = back.reshape(steps, streams, hd)
    dx, dhu = np.empty_like(x), np.empty_like(x)
    carry = np.zeros((streams, hd), kind)
    for s in range(steps - 1, -1, -1):
        d = dh[s] + carry
        dn = d * (1 - z[s]) * (1 - n[s] * n[s])
        dx[s, :, :hd] = d * (hin[s] - n[s]) * z[s] * (1 - z[s])
        dx[s, :, hd : 2 * hd] = dn * un[s] * r[s] * (1 - r[s])
        dx[s, :, 2 * hd :] = dn
        dhu[s, :, : 2 * hd] = dx[s, :, : 2 * hd]
        dhu[s, :, 2 * hd :] = dn * r[s]
        carry = d * z[s] + dhu[s] @ p.u.T
        if some[s]:
            carry *= keep[s]
    du = hin.reshape(-1, hd).T @ dhu.reshape(-1, 3 * hd)
    # gradients of the gates by input unit: its rows side by side, then one sum a unit
    units = inputs.ravel()
    by_unit = np.argsort(units.astype(np.int16), kind="stable")
    sorted_units = units[by_unit]
    starts = np.nonzero(np.concatenate([[True], sorted_units[1:] != sorted_units[:-1]]))[0]
    dgates = np.zeros_like(gates)
    dgates[sorted_units[starts]] = np.add.reduceat(dx.reshape(-1, 3 * hd)[by_unit], starts, axis=0)
    return [dgates @ p.wx.T, p.e.T @ dgates, dgates.sum(0), du, dwc, dbc, dww, dbw], hs[-1]
