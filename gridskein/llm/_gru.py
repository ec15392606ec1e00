"""A gated recurrent unit with a class-factored softmax, in numpy: training by truncated backpropagation, and scoring."""

from __future__ import annotations

import numpy as np

#: Classes of frequent words, words of each, classes that rare words share by their last letters, units.
CLASSES, CLASS_SIZE, RARE, UNITS = 32, 64, 32, 16
VOCABULARY = CLASSES * CLASS_SIZE
#: Streams trained side by side, tokens of a backpropagation window, step size.
LANES, WINDOW, RATE = 512, 16, 0.02
#: Rows of logits handled at a time (they then fit a processor's cache), and tokens whose probabilities are found together.
ROWS, SCORED = 2048, 50_000

#: Order of the parameters in a flat vector.  Output layers have their bias as last row; ``ww`` has one for each class.
SHAPES = {
    "embed": (VOCABULARY + RARE, UNITS),
    "wx": (UNITS, 3 * UNITS),
    "wh": (UNITS, 3 * UNITS),
    "b": (3 * UNITS,),
    "wc": (UNITS + 1, CLASSES + RARE),
    "ww": (CLASSES, UNITS + 1, CLASS_SIZE),
}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def unflat(values: np.ndarray) -> dict[str, np.ndarray]:
    """Views of a flat vector."""
    p, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        p[k] = values[at : at + n].reshape(s)
        at += n
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def initial(counts: np.ndarray, rare: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters before training: the output biases hold the counts of frequent words and of rare words by class."""
    rng = np.random.default_rng(5)
    p = {k: (rng.normal(size=s) * (0.3 if len(s) > 1 else 0)).astype(np.float32) for k, s in SHAPES.items()}
    p["ww"] *= 0
    p["wc"] *= 0
    by_class = counts.reshape(CLASSES, CLASS_SIZE)
    totals = np.r_[by_class.sum(axis=1), rare] + 0.5
    p["wc"][UNITS] = np.log(totals / totals.sum())
    inside = by_class + 0.01
    p["ww"][:, UNITS] = np.log(inside / inside.sum(axis=1, keepdims=True))
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _step(p, x, h):
    """Gates, candidate, its recurrent part and the next state; x has the inputs' part of all gates."""
    u = UNITS
    g = h @ p["wh"]
    z, r = (_sigmoid(x[:, at] + g[:, at]) for at in (slice(u), slice(u, 2 * u)))
    inner = g[:, 2 * u :]
    c = r * inner
    c += x[:, 2 * u :]
    np.tanh(c, out=c)
    new = h - c
    new *= z
    new += c
    return z, r, c, inner, new


def _with_ones(states: np.ndarray) -> np.ndarray:
    return np.concatenate([states, np.ones((len(states), 1), states.dtype)], axis=1)


def _classes_of(ids: np.ndarray) -> np.ndarray:
    return np.where(ids < VOCABULARY, ids // CLASS_SIZE, ids - VOCABULARY + CLASSES)


class _Output:
    """The two softmax layers."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.outer, self.inner = p["wc"], p["ww"]
        self.tame = self._is_tame(self.outer), self._is_tame(self.inner)

    @staticmethod
    def _is_tame(w: np.ndarray) -> bool:
        """States lie in (-1, 1): whether no exponential of a logit can overflow, nor all of a row underflow."""
        reach, bias = np.abs(w[..., :-1, :]).sum(axis=-2), w[..., -1, :]
        return bool((bias + reach).max() < 60 and (bias - reach).max(axis=-1).min() > -60)

    def targets(self) -> np.ndarray:
        """For each id the weights of its logits, summed: its class and, in it, itself."""
        t = self.outer.T[_classes_of(np.arange(VOCABULARY + RARE))]
        t[:VOCABULARY] += self.inner.transpose(0, 2, 1).reshape(VOCABULARY, -1)
        return t

    def blocks(self, cls: np.ndarray):
        """(class or None for the outer layer, its matrix, tame, rows) for rows sorted by class."""
        cuts = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()  # rare words have no second layer
        for a in range(0, len(cls), ROWS):
            yield None, self.outer, self.tame[0], slice(a, a + ROWS)
        for k in range(CLASSES):
            for a in range(cuts[k], cuts[k + 1], ROWS):
                yield k, self.inner[k], self.tame[1], slice(a, min(a + ROWS, cuts[k + 1]))


def _exponentials(states: np.ndarray, w: np.ndarray, tame: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """Exponentials of the logits less a number, their sums, and that number."""
    e = states @ w
    top = 0.0
    if not tame:
        top = e.max(axis=1)
        e -= top[:, None]
    np.exp(e, out=e)
    return e, e @ np.ones(e.shape[1], e.dtype), top


def log_probabilities(p: dict[str, np.ndarray], states: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Natural log-probability of each id (of a rare word: of its class) after each state."""
    ids = np.asarray(ids).astype(np.int16)
    order = np.argsort(ids, kind="stable")
    ids, states, layers = ids[order], _with_ones(states[order]), _Output(p)
    found = np.einsum("ij,ij->i", states, layers.targets()[ids]).astype(np.float64)
    for _, w, tame, at in layers.blocks(_classes_of(ids)):
        _, total, top = _exponentials(states[at], w, tame)
        found[at] -= np.log(total) + top
    out = np.empty(len(ids))
    out[order] = found
    return out


def add_gradients(p: dict[str, np.ndarray], states: np.ndarray, ids: np.ndarray, grads: dict[str, np.ndarray]) -> np.ndarray:
    """Add the gradients of the loss to those of the output's parameters; rows are sorted by id.  Returns the states' gradients."""
    cls = _classes_of(ids)
    places = np.where(ids < VOCABULARY, ids % CLASS_SIZE, 0)
    back = np.zeros_like(states)
    states = _with_ones(states)
    for k, w, tame, at in _Output(p).blocks(cls):
        own = states[at]
        e, total, _ = _exponentials(own, w, tame)
        e[np.arange(len(e)), (cls if k is None else places)[at]] -= total
        share = np.reciprocal(total)[:, None]
        g = grads["wc"] if k is None else grads["ww"][k]
        g += (own * share).T @ e
        e = e @ w[:-1].T
        e *= share
        back[at] += e
    return back


class Trainer:
    """Trains on streams of documents: windows follow each other in a lane and hand their state on."""

    def __init__(self, p: dict[str, np.ndarray], lanes: int = LANES, window: int = WINDOW, rate: float = RATE):
        self.values = flat(p)
        self.p = unflat(self.values)
        self.m, self.v = np.zeros_like(self.values), np.zeros_like(self.values)
        self.lanes, self.window, self.rate, self.steps, self.seen = lanes, window, rate, 0, 0

    def train(self, docs: list[np.ndarray]) -> None:
        """One pass over some documents' ids; a document begins with the state zero."""
        sizes = np.array([len(d) for d in docs])
        if not sizes.sum():
            return
        stream = np.concatenate(docs).astype(np.int16)
        fresh = np.zeros(len(stream), bool)
        fresh[np.cumsum(sizes) - sizes] = True
        lanes = min(self.lanes, -(-len(stream) // self.window))
        length = -(-len(stream) // lanes)
        pad = length * lanes - len(stream)
        ids = np.r_[stream, np.full(pad, -1, np.int16)].reshape(lanes, length).T.copy()
        fresh = np.r_[fresh, np.zeros(pad, bool)].reshape(lanes, length).T.copy()
        self.h = np.zeros((lanes, UNITS), self.values.dtype)
        for t in range(0, length, self.window):
            self._update(ids[t : t + self.window], fresh[t : t + self.window])
        self.seen += len(stream)

    def _update(self, ids, fresh) -> None:
        """A window of all lanes (steps, lanes); ids of -1 are padding."""
        p, u = self.p, UNITS
        steps, lanes = ids.shape
        kind = self.values.dtype
        flat_grads = np.zeros_like(self.values)
        grads = unflat(flat_grads)
        h, resets = self.h, fresh.any(axis=1).tolist()
        inputs = p["embed"] @ p["wx"]
        inputs += p["b"]
        states = np.empty((steps, lanes, u), kind)
        cache = []
        for t in range(steps):
            if resets[t]:
                h = np.where(fresh[t][:, None], kind.type(0), h)
            states[t] = h
            *kept, new = _step(p, inputs[ids[t]], h)
            cache.append(kept)
            h = new
        self.h = h
        every, used = states.reshape(-1, u), ids.ravel()
        order = np.argsort(used, kind="stable")
        order = order[np.searchsorted(used[order], 0) :]
        sorted_ids = used[order]
        back = np.zeros((steps * lanes, u), kind)
        back[order] = add_gradients(p, every[order], sorted_ids, grads)
        back = back.reshape(steps, lanes, u)
        dh = np.zeros_like(h)
        # Gradients of both gates, of the candidate, and of its recurrent part, each in one piece of memory.
        gates = np.empty((4, steps, lanes, u), kind)
        turned = [p["wh"][:, k * u : (k + 1) * u].T.copy() for k in range(3)]
        slope = np.empty_like(h)
        for t in range(steps - 1, -1, -1):
            z, r, c, inner = cache[t]
            dz, dr, dc, di = gates[:, t]
            np.subtract(1, z, out=dc)
            dc *= dh
            np.multiply(c, c, out=slope)
            np.subtract(1, slope, out=slope)
            dc *= slope
            np.subtract(states[t], c, out=dz)
            dz *= dh
            np.multiply(dc, inner, out=dr)
            np.multiply(dc, r, out=di)
            dh *= z
            for gate, d in ((z, dz), (r, dr)):
                np.multiply(gate, gate, out=slope)
                np.subtract(gate, slope, out=slope)
                d *= slope
            for d, w in zip((dz, dr, di), turned, strict=True):
                dh += d @ w
            dh += back[t]
            if resets[t]:
                dh[fresh[t]] = 0
        dz, dr, dc, di = gates.reshape(4, -1, u)
        for k, d in enumerate((dz, dr, di)):
            grads["wh"][:, k * u : (k + 1) * u] = every.T @ d
        rows = np.concatenate([dz, dr, dc], axis=1)
        grads["b"][:] = rows.sum(axis=0)
        grads["wx"][:] = p["embed"][used].T @ rows
        first = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]])
        grads["embed"][sorted_ids[first]] = np.add.reduceat((rows @ p["wx"].T)[order], first, axis=0)
        self._adam(flat_grads, max(1, len(order)))

    def _adam(self, g: np.ndarray, n: int) -> None:
        self.steps += 1
        norm = np.sqrt(float(np.vdot(g, g))) / n
        g *= min(1.0, 1.0 / max(norm, 1e-9)) / n
        self.m += 0.1 * (g - self.m)
        g *= g
        g -= self.v
        g *= 0.01
        self.v += g
        np.divide(self.v, 1 - 0.99**self.steps, out=g)
        np.sqrt(g, out=g)
        g += 1e-6
        np.divide(self.m, g, out=g)
        g *= self.rate / (1 - 0.9**self.steps)
        self.values -= g


def score(p: dict[str, np.ndarray], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of whole documents, the state carried from token to token; ``ids`` are theirs in turn."""
    begin = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    begin, ends = begin[order], sizes[order]
    longest = int(ends[0]) if len(ends) else 0
    running = len(ends) - np.searchsorted(ends[::-1], np.arange(longest), side="right")
    inputs = p["embed"] @ p["wx"] + p["b"]
    h = np.zeros((len(ends), UNITS), p["wh"].dtype)
    total = np.zeros(len(ends))
    states, targets, rows = [], [], []
    held = 0
    for t in range(longest):
        n = running[t]
        own = ids[begin[:n] + t]
        states.append(h[:n])
        targets.append(own)
        rows.append(np.arange(n))
        h = _step(p, inputs[own], h[:n])[-1]
        held += n
        if held >= SCORED or t == longest - 1:
            found = log_probabilities(p, np.concatenate(states), np.concatenate(targets))
            total += np.bincount(np.concatenate(rows), found, minlength=len(ends))
            states, targets, rows, held = [], [], [], 0
    out = np.empty(len(ends))
    out[order] = total
    return out
