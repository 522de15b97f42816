"""A small gated recurrent language model in numpy with a class-factored softmax.

Symbols are numbered so that every class is a contiguous range. ``score`` carries the state of
each document from its first symbol to its last; ``train`` back-propagates through windows of fixed
length and carries the state, but not the gradient, from one window to the next.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass
from pathlib import Path

import numpy as np


def one_thread() -> None:
    """Matrix products of this process on one thread: Spark runs a task on every core, and threads that wait still spin."""
    for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


@dataclass(frozen=True)
class Shape:
    symbols: int
    edges: tuple[int, ...]  # class k holds the symbols edges[k] .. edges[k + 1] - 1
    embedding: int
    hidden: int

    def sizes(self) -> dict[str, tuple[int, ...]]:
        n, e, h, c = self.symbols, self.embedding, self.hidden, len(self.edges) - 1
        return {
            "embed": (n + 1, e),  # the last row is the start of a document
            "w": (e, 3 * h),
            "b": (3 * h,),
            "u": (h, 3 * h),
            "class_w": (h, c),
            "class_b": (c,),
            "word_w": (h, n),
            "word_b": (n,),
        }

    @property
    def start(self) -> int:
        return self.symbols


def unpack(shape: Shape, flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, size in shape.sizes().items():
        n = int(np.prod(size))
        out[name] = flat[at : at + n].reshape(size)
        at += n
    return out


def initial(shape: Shape, counts: np.ndarray, seed: int) -> np.ndarray:
    """Weights whose first predictions are the relative frequencies of the symbols."""
    rng = np.random.default_rng(seed)
    flat = np.concatenate([rng.normal(0, 0.1, int(np.prod(s))) for s in shape.sizes().values()]).astype(np.float32)
    p = unpack(shape, flat)
    mass = counts.astype(np.float64) + 0.5
    p["b"][:] = 0
    p["u"][:] = rng.normal(0, 0.7 / np.sqrt(shape.hidden), p["u"].shape)
    p["class_w"][:] *= 0.1
    p["word_w"][:] *= 0.1
    p["word_b"][:] = np.log(mass)
    p["class_b"][:] = np.log(np.add.reduceat(mass, np.array(shape.edges[:-1])))
    return flat


def _relative(x: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """exp(x - top) in the place of x, and the sums of its rows; the tops are 0 unless values are so large that they must be taken off."""
    top = 0.0
    if x.size and max(x.max(), -x.min()) > 60:
        top = x.max(axis=1)
        x -= top[:, None]
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], dtype=x.dtype), top


def by_class(shape: Shape, kinds: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Rows in the order of their class, and (first row, end, first symbol, end) of the classes of two symbols or more."""
    order = np.argsort(kinds.astype(np.uint8) if len(shape.edges) < 256 else kinds, kind="stable")
    bounds = np.searchsorted(kinds[order], np.arange(len(shape.edges)))
    spans = zip(bounds[:-1].tolist(), bounds[1:].tolist(), shape.edges[:-1], shape.edges[1:], strict=True)
    return order, [(a, b, low, high) for a, b, low, high in spans if b > a and high - low > 1]


def log_probability(shape: Shape, p: dict, classes: np.ndarray, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log of p(class | state) p(symbol | class, state) for each row."""
    kinds = classes[targets]
    order, spans = by_class(shape, kinds)
    states, targets, at = states.take(order, axis=0), targets[order], np.arange(len(order))

    def log_share(logits: np.ndarray, own: np.ndarray) -> np.ndarray:
        picked = logits[at[: len(own)], own]
        sums, top = _relative(logits)
        return picked - top - np.log(sums)

    logits = states @ p["class_w"]
    logits += p["class_b"]
    logs = log_share(logits, kinds[order]).astype(np.float64)
    for a, b, low, high in spans:
        inner = states[a:b] @ p["word_w"][:, low:high]
        inner += p["word_b"][low:high]
        logs[a:b] += log_share(inner, targets[a:b] - low)
    out = np.empty_like(logs)
    out[order] = logs
    return out


def _by_gate(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """What each symbol sends to the gates and the candidate, and the weights of the state, one block for each of the three.

    Both gates are halved, which is exact: a gate is half a tanh of half its sum, plus one half.
    """
    h = len(p["u"])
    half = np.array([0.5, 0.5, 1.0], dtype=p["u"].dtype)[:, None, None]
    w, b, u = (p[k].reshape(-1, 3, h).transpose(1, 0, 2) * half for k in ("w", "b", "u"))
    inputs = np.matmul(p["embed"], w)
    inputs += b
    return inputs, u


def _step(gates: np.ndarray, g: np.ndarray, state: np.ndarray, out: np.ndarray) -> np.ndarray:
    """One step of all lanes: ``gates`` (from the inputs) become both gates and the candidate, ``out`` the new state."""
    both, new = gates[:2], gates[2]
    both += g[:2]
    np.tanh(both, out=both)
    both *= 0.5
    both += 0.5
    new += both[0] * g[2]
    np.tanh(new, out=new)
    np.subtract(state, new, out=out)
    out *= both[1]
    out += new
    return out


def score(shape: Shape, flat: np.ndarray, texts: list[np.ndarray], lanes: int = 1024, rows: int = 16_384) -> np.ndarray:
    """Natural log probability of each sequence of symbols, in the order given.

    Sequences of like length run side by side; a state is kept for every sequence until it ends.
    """
    p, h = unpack(shape, flat), shape.hidden
    classes = np.repeat(np.arange(len(shape.edges) - 1), np.diff(shape.edges))
    inputs, u = _by_gate(p)
    total = np.zeros(len(texts))
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(order), lanes):
        own = order[at : at + lanes]
        size = lengths[own]
        if not len(own) or size[0] == 0:
            break
        flat_text = np.concatenate([texts[i] for i in own])
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        live = np.searchsorted(-size, -np.arange(size[0]), side="left")  # sequences longer than t
        bounds = np.concatenate([[0], np.cumsum(live)])
        state = np.zeros((live[0], h), dtype=flat.dtype)
        t = 0
        while t < size[0]:
            end = min(int(np.searchsorted(bounds, bounds[t] + rows)), int(size[0]))
            steps, lane = np.repeat(np.arange(t, end), live[t:end]), np.arange(bounds[t], bounds[end]) - np.repeat(bounds[t:end], live[t:end])
            place = starts[lane] + steps
            wanted, given = flat_text[place], flat_text[place - 1]
            if t == 0:
                given[: live[0]] = shape.start
            held, low = np.empty((len(lane), h), dtype=flat.dtype), 0
            for n in live[t:end].tolist():
                state = _step(inputs.take(given[low : low + n], axis=1), np.matmul(state[:n], u), state[:n], held[low : low + n])
                low += n
            logs = log_probability(shape, p, classes, held, wanted)
            total[own] += np.bincount(lane, weights=logs, minlength=len(own))
            t = end
    return total


def gradient(shape: Shape, p: dict, classes: np.ndarray, x: np.ndarray, y: np.ndarray, state: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """Gradient of the mean negative log probability over one window.

    ``x`` and ``y`` are steps by lanes; a lane whose input is the start symbol begins anew. A target of -1 is no token: it
    fills up the lanes and counts nowhere. Returns the gradient, the state after the window and the mean loss.
    """
    steps, lanes = x.shape
    h, kind = shape.hidden, p["u"].dtype
    x, y = np.ascontiguousarray(x), np.ascontiguousarray(y)  # windows of lanes are far apart in memory
    inputs, u = _by_gate(p)
    gates = np.empty((steps, 3, lanes, h), dtype=kind)
    before, after, recs = (np.empty((steps, lanes, h), dtype=kind) for _ in range(3))
    begins = x == shape.start
    anew = begins.any(axis=1)
    for t in range(steps):
        before[t] = state
        if anew[t]:
            before[t, begins[t]] = 0
        g = np.matmul(before[t], u)
        recs[t] = g[2]
        state = _step(inputs.take(x[t], axis=1, out=gates[t], mode="clip"), g, before[t], after[t])
    out = {name: np.zeros_like(v) for name, v in p.items()}
    # The tokens in the order of their classes.
    there = np.flatnonzero(y.reshape(-1) >= 0)
    targets = y.reshape(-1)[there]
    order, spans = by_class(shape, classes[targets])
    targets, order = targets[order], there[order]
    states = after.reshape(steps * lanes, h).take(order, axis=0)
    n = len(order)
    at, ones, loss = np.arange(n), np.ones(n, dtype=kind), 0.0

    def slopes(logits: np.ndarray, own: np.ndarray) -> float:
        """The loss of rows whose wanted columns are ``own``; its slopes take the place of the logits."""
        rows = at[: len(own)]
        picked = logits[rows, own]
        sums, top = _relative(logits)
        logits *= (1 / (sums * n))[:, None]
        logits[rows, own] -= 1 / n
        return float((np.log(sums) + top - picked).sum())

    soft = states @ p["class_w"]
    soft += p["class_b"]
    loss += slopes(soft, classes[targets])
    out["class_w"][:] = (soft.T @ states).T
    out["class_b"][:] = ones @ soft
    d_rows = soft @ p["class_w"].T
    for a, b, low, high in spans:
        own, weights = states[a:b], p["word_w"][:, low:high]
        soft = own @ weights
        soft += p["word_b"][low:high]
        loss += slopes(soft, targets[a:b] - low)
        out["word_w"][:, low:high] = own.T @ soft
        out["word_b"][low:high] = ones[: b - a] @ soft
        d_rows[a:b] += soft @ weights.T
    d_all = np.zeros((steps * lanes, h), dtype=kind)
    d_all[order] = d_rows
    d_states = d_all.reshape(steps, lanes, h)
    d_gates, d_news = np.empty((steps, lanes, 3 * h), dtype=kind), np.empty_like(recs)
    back = np.zeros((lanes, h), dtype=kind)
    by_gate = np.ascontiguousarray(p["u"].T)
    for t in range(steps - 1, -1, -1):
        r, z, new = gates[t]
        own, d, d_new = d_gates[t], d_states[t], d_news[t]
        d += back
        back = d * z
        np.subtract(d, back, out=d_new)
        d_new *= 1 - new * new
        d_rec = d_new * r
        own[:, 2 * h :] = d_rec
        d_rec *= recs[t]
        np.multiply(d_rec, 1 - r, out=own[:, :h])
        d_z = before[t] - new
        d_z *= back
        np.multiply(d_z, 1 - z, out=own[:, h : 2 * h])
        back += own @ by_gate
        if anew[t]:
            back[begins[t]] = 0
    out["u"][:] = np.matmul(before.transpose(0, 2, 1), d_gates).sum(axis=0)
    d_gates[:, :, 2 * h :] = d_news  # from here on what the inputs send
    out["w"][:] = np.matmul(p["embed"].take(x, axis=0).transpose(0, 2, 1), d_gates).sum(axis=0)
    out["b"][:] = (np.ones(lanes, dtype=kind) @ d_gates).sum(axis=0)
    d_embed = p["w"] @ d_gates.reshape(steps * lanes, 3 * h).T
    flat_x = x.reshape(-1)
    for k, row in enumerate(d_embed):
        out["embed"][:, k] = np.bincount(flat_x, weights=row, minlength=len(p["embed"]))
    return out, state.copy(), loss / n


def train(shape: Shape, flat: np.ndarray, texts: list[np.ndarray], lanes: int = 256, window: int = 32, rate: float = 0.01, updates: int = 128) -> np.ndarray:
    """One pass over the sequences by truncated back-propagation with Adam; returns new weights.

    The sequences are laid end to end over parallel lanes, at most ``lanes`` and so many that about ``updates`` windows
    follow one another. Every token takes part; the last lane is filled up with no tokens.
    """
    texts = [t for t in texts if len(t)]
    if not texts:
        return flat.copy()
    flat = flat.copy()
    p = unpack(shape, flat)
    classes = np.repeat(np.arange(len(shape.edges) - 1), np.diff(shape.edges))
    y = np.concatenate(texts)
    x = np.concatenate([np.concatenate([[shape.start], t[:-1]]) for t in texts])
    lanes = max(1, min(lanes, len(y) // (window * updates)))
    length = -(-len(y) // lanes)
    spare = lanes * length - len(y)
    x = np.concatenate([x, np.full(spare, shape.start)]).reshape(lanes, length).T
    y = np.concatenate([y, np.full(spare, -1)]).reshape(lanes, length).T
    state = np.zeros((lanes, shape.hidden), dtype=np.float32)
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    for step, at in enumerate(range(0, length, window), 1):
        g, state, _ = gradient(shape, p, classes, x[at : at + window], y[at : at + window], state)
        g = np.concatenate([v.reshape(-1) for v in g.values()])
        g *= np.float32(min(1.0, 1.0 / (float(np.sqrt(np.dot(g, g))) + 1e-12)))
        first += np.float32(0.1) * (g - first)
        g *= g
        g -= second
        g *= np.float32(0.005)
        second += g
        np.multiply(second, np.float32(1 / (1 - 0.995**step)), out=g)
        np.sqrt(g, out=g)
        g += np.float32(1e-8)
        np.divide(first, g, out=g)
        g *= np.float32(rate / (1 - 0.9**step))
        flat -= g
    return flat
