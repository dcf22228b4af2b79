"""A gated recurrent network in numpy with a class-factored softmax: training step and scoring.

Words 0..classes*CLASS-1 have an output of their own, P(class) * P(word in class); word ``rest`` stands for
all others and is a class by itself."""

from __future__ import annotations

import heapq

import numpy as np

#: WINDOW: words that go through the output layer at once; TRUNCATE: words that gradients go back.
HIDDEN, CLASSES, CLASS, WINDOW, TRUNCATE = 24, 64, 64, 32, 32
WORDS = CLASSES * CLASS
REST = WORDS
NAMES = ("embed", "input", "bias", "gates", "cand", "class_w", "class_b", "word_w", "word_b")


def start(counts: np.ndarray, rest: float, seed: int = 5) -> dict[str, np.ndarray]:
    """Small random weights; output biases that give the unigram distribution of counts (WORDS) and rest."""
    rng = np.random.default_rng(seed)
    f = lambda *s, by=1.0: (rng.standard_normal(s) * by).astype(np.float32)
    c = counts + 0.1
    mass = np.r_[c.reshape(CLASSES, CLASS).sum(1), rest + 0.1]
    return {
        "embed": f(WORDS + 1, HIDDEN, by=0.3),
        "input": f(HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5),
        "bias": np.r_[np.full(HIDDEN, 1.0), np.zeros(2 * HIDDEN)].astype(np.float32),
        "gates": f(HIDDEN, 2 * HIDDEN, by=HIDDEN**-0.5),
        "cand": f(HIDDEN, HIDDEN, by=HIDDEN**-0.5),
        "class_w": f(HIDDEN, CLASSES + 1, by=0.05),
        "class_b": np.log(mass / mass.sum()).astype(np.float32),
        "word_w": f(CLASSES, HIDDEN, CLASS, by=0.05),
        "word_b": np.log(c.reshape(CLASSES, CLASS) / c.reshape(CLASSES, CLASS).sum(1, keepdims=True)).astype(np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def step(p: dict, x: np.ndarray, h: np.ndarray):
    """x: input projections (n, 3 * HIDDEN). z keeps the old state, r opens it to the candidate."""
    zr = h @ p["gates"]
    zr += x[:, : 2 * HIDDEN]
    zr = _sigmoid(zr)
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    c = np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ p["cand"])
    return c + z * (h - c), z, r, c


def _exp(x: np.ndarray, bounded: bool) -> np.ndarray:
    """In place. Scores without a bound are first taken from their greatest."""
    if not bounded:
        x -= x.max(0)
    return np.exp(x, out=x)


def _softmax_error(x: np.ndarray, at: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of the outputs ``at`` of scores x (outputs, rows), which become probabilities less one at ``at``,
    each times a row's sum; and one over the sums."""
    i = np.arange(len(at))
    _exp(x, bounded)
    s = x.sum(0)
    y = x[at, i]
    x[at, i] = y - s
    return np.log(np.maximum(y, TINY) / s), 1 / s


#: Rows that go through the class layer at once; the greatest score of an output whose exp and sums of it are floats.
ROWS, BOUND, TINY = 512, 60.0, 1e-37


def _layers(p: dict) -> tuple[np.ndarray, np.ndarray, bool]:
    """Weights of classes and words with the biases as one more row, and whether no score can pass BOUND: states lie
    between -1 and 1."""
    c, w = np.concatenate([p["class_w"], p["class_b"][None]]), np.concatenate([p["word_w"], p["word_b"][:, None]], 1)
    return c, w, max(float(np.abs(c).sum(0).max()), float(np.abs(w).sum(1).max())) < BOUND


def _log_chosen(x: np.ndarray, at: np.ndarray, bounded: bool) -> np.ndarray:
    if not bounded:
        x -= x.max(0)
    lp = x[at, np.arange(len(at))]
    np.exp(x, out=x)
    return lp - np.log(x.sum(0))


def log_prob(p: dict, h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Natural log probability of each word after state h; of a word of no class, that of ``rest``."""
    order = np.argsort((word // CLASS).astype(np.int16), kind="stable")  # so that each class has its rows side by side
    hh, at = np.ones((HIDDEN + 1, len(order)), h.dtype), word[order]
    hh[:HIDDEN] = h[order].T
    class_w, word_w, bounded = _layers(p)
    c = at // CLASS
    bounds = np.searchsorted(c, np.arange(CLASSES + 1))
    lp, out = np.empty(len(at), h.dtype), np.empty(len(at), h.dtype)
    for a in range(0, len(at), ROWS):
        lp[a : a + ROWS] = _log_chosen(class_w.T @ hh[:, a : a + ROWS], c[a : a + ROWS], bounded)
    for k in np.flatnonzero(np.diff(bounds)):
        for a in range(bounds[k], bounds[k + 1], ROWS):
            b = min(a + ROWS, bounds[k + 1])
            lp[a:b] += _log_chosen(word_w[k].T @ hh[:, a:b], at[a:b] - k * CLASS, bounded)
    out[order] = lp
    return out


def zeros(p: dict) -> dict:
    """Sums of gradients to add to. Those of the embedding are kept as rows until ``whole``."""
    return {k: np.zeros_like(v) for k, v in p.items() if k != "embed"} | {"at": [], "by": []}


def whole(p: dict, g: dict) -> dict:
    at, by = np.concatenate(g.pop("at")), np.concatenate(g.pop("by"))
    order = np.argsort(at.astype(np.int16), kind="stable")
    at = at[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    g["embed"] = np.zeros_like(p["embed"])
    g["embed"][at[first]] = np.add.reduceat(by[order], first)
    return g


def gradient(p: dict, words: np.ndarray, h0: np.ndarray, before: np.ndarray, valid: np.ndarray, end: int, g: dict):
    """Add to g the gradient of the negative log probability of one window (n, t), by backpropagation that stops at
    the window's start.

    before: the word ahead of each window; after an ``end`` token a new document begins, with a state of
    zeros. Places that are not ``valid`` lie behind a lane's end and do not count. Returns the state behind the
    window and the sum of log probabilities."""
    n, t_len = words.shape
    ins = np.concatenate([before[None], words.T[:-1]])  # by time, then lane
    go_on = (ins != end).astype(p["embed"].dtype)[:, None]
    # states, gates and their gradients by time, unit and lane, so that all parts of a step are contiguous
    e = np.ascontiguousarray(p["embed"][ins].transpose(0, 2, 1))
    to_input, to_gates, to_cand = (np.ascontiguousarray(p[k].T) for k in ("input", "gates", "cand"))
    hs, out, rh, c, past = (np.empty_like(e) for _ in range(5))
    zr, x = np.empty((t_len, 2 * HIDDEN, n), e.dtype), np.empty((3 * HIDDEN, n), e.dtype)
    h = np.ascontiguousarray(h0.T)
    for t in range(t_len):
        np.matmul(to_input, e[t], out=x)
        x += p["bias"][:, None]
        np.multiply(h, go_on[t], out=hs[t])
        np.matmul(to_gates, hs[t], out=zr[t])
        zr[t] += x[: 2 * HIDDEN]
        _sigmoid(zr[t])
        np.multiply(zr[t, HIDDEN:], hs[t], out=rh[t])
        np.matmul(to_cand, rh[t], out=c[t])
        c[t] += x[2 * HIDDEN :]
        np.tanh(c[t], out=c[t])
        np.subtract(hs[t], c[t], out=past[t])
        np.multiply(zr[t, :HIDDEN], past[t], out=out[t])
        out[t] += c[t]
        h = out[t]
    # by class, so that each class has its rows side by side
    flat = words.T.ravel()
    cls = np.where(valid.T.ravel(), flat // CLASS, CLASSES + 1).astype(np.int16)
    order = np.argsort(cls, kind="stable")
    bounds = np.searchsorted(cls[order], np.arange(CLASSES + 2))
    order = order[: bounds[-1]]
    hh, at, cls = np.ones((HIDDEN + 1, len(order)), x.dtype), flat[order], cls[order]
    hh[:HIDDEN] = out.transpose(0, 2, 1).reshape(n * t_len, HIDDEN)[order].T
    lp, dh = np.empty(len(order), x.dtype), np.empty((HIDDEN, len(order)), x.dtype)
    class_w, word_w, bounded = _layers(p)
    for a in range(0, len(order), ROWS):
        b = min(a + ROWS, len(order))
        y = class_w.T @ hh[:, a:b]
        lp[a:b], over = _softmax_error(y, cls[a:b], bounded)
        by = (hh[:, a:b] * over) @ y.T
        g["class_w"] += by[:HIDDEN]
        g["class_b"] += by[HIDDEN]
        dh[:, a:b] = (p["class_w"] @ y) * over
    for k in np.flatnonzero(np.diff(bounds[: CLASSES + 1])):
        for a in range(bounds[k], bounds[k + 1], ROWS):
            b = min(a + ROWS, bounds[k + 1])
            y = word_w[k].T @ hh[:, a:b]
            lp_k, over = _softmax_error(y, at[a:b] - k * CLASS, bounded)
            lp[a:b] += lp_k
            by = (hh[:, a:b] * over) @ y.T
            g["word_w"][k] += by[:HIDDEN]
            g["word_b"][k] += by[HIDDEN]
            dh[:, a:b] += (p["word_w"][k] @ y) * over
    back_to = np.zeros((n * t_len, HIDDEN), x.dtype)
    back_to[order] = dh.T
    dh = np.ascontiguousarray(back_to.reshape(t_len, n, HIDDEN).transpose(0, 2, 1))
    dx, back, rows = np.empty_like(x), np.zeros((HIDDEN, n), x.dtype), np.empty((t_len, n, HIDDEN), x.dtype)
    for t in range(t_len - 1, -1, -1):
        z, r = zr[t, :HIDDEN], zr[t, HIDDEN:]
        d = dh[t]
        d += back
        dz = d * z
        left = d - dz
        np.multiply(left, 1 - c[t] * c[t], out=dx[2 * HIDDEN :])
        drh = p["cand"] @ dx[2 * HIDDEN :]
        np.multiply(left * z, past[t], out=dx[:HIDDEN])
        drh *= r
        np.multiply(drh, hs[t] * (1 - r), out=dx[HIDDEN : 2 * HIDDEN])
        back = p["gates"] @ dx[: 2 * HIDDEN]
        back += dz
        back += drh
        back *= go_on[t]
        g["gates"] += hs[t] @ dx[: 2 * HIDDEN].T
        g["cand"] += rh[t] @ dx[2 * HIDDEN :].T
        g["input"] += e[t] @ dx.T
        g["bias"] += dx.sum(1)
        np.matmul(dx.T, to_input, out=rows[t])
    g["at"].append(ins.ravel())
    g["by"].append(rows.reshape(-1, HIDDEN))
    return np.ascontiguousarray(h.T), float(lp.sum())


class Trainer:
    """Adam over whole documents, each ending with ``end``, by truncated backpropagation.

    Documents go one after the other through lanes, which advance together by windows: the state goes on
    from window to window to a document's end, gradients do not. Every word is learned from once."""

    def __init__(self, p: dict, end: int, lanes: int, rate: float = 0.01):
        self.p = {k: v.copy() for k, v in p.items()}
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        self.end, self.lanes, self.rate, self.t = end, lanes, rate, 0
        self.h, self.before = np.zeros((lanes, HIDDEN), p["embed"].dtype), np.full(lanes, end)
        self.queue: list[np.ndarray] = [np.zeros(0, np.int16)] * lanes
        self.sums, self.seen = zeros(p), 0

    def _update(self) -> None:
        if not self.seen:
            return
        self.t += 1
        for k, g in whole(self.p, self.sums).items():
            g /= self.seen
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= (self.rate / (1 - 0.9**self.t)) * self.m[k] / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
        self.sums, self.seen = zeros(self.p), 0

    def learn(self, docs: list[np.ndarray], last: bool = False) -> None:
        """Add documents and learn until a quarter of the lanes has nothing left; with ``last``, to the end.

        A lane that ran out waits for the next documents, so long ones keep no other lane from going on."""
        load = [(len(q), i) for i, q in enumerate(self.queue)]
        heapq.heapify(load)
        parts = [[q] for q in self.queue]
        for d in sorted(docs, key=len, reverse=True):
            n, i = load[0]
            parts[i].append(d)
            heapq.heapreplace(load, (n + len(d), i))
        flat = np.concatenate([x for q in parts for x in q])
        size = np.array([sum(map(len, q)) for q in parts])
        stop = np.cumsum(size)
        at = stop - size
        while True:
            i = np.flatnonzero(at < stop)
            if not len(i) or (not last and 4 * len(i) < 3 * self.lanes):
                break
            place = at[i, None] + np.arange(TRUNCATE)
            valid = place < stop[i, None]
            x = flat[np.where(valid, place, at[i, None])].astype(np.int64)
            h, _ = gradient(self.p, x, self.h[i], self.before[i], valid, self.end, self.sums)
            self.h[i], self.before[i] = h, np.where(valid[:, -1], x[:, -1], self.end)
            at[i] = np.minimum(at[i] + TRUNCATE, stop[i])
            self.seen += int(valid.sum())
            if 2 * self.seen >= self.lanes * TRUNCATE:
                self._update()
        self.queue = [flat[a:b] for a, b in zip(at, stop, strict=True)]
        if last:
            self._update()


def score(p: dict, words: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """Natural log probability of each document's words[first[d]:first[d+1]], state carried to its end.

    All documents advance together, longest first, a window of words at a time through the output layer."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    s, n = first[:-1][order], size[order]
    out = np.zeros(len(n))
    table = p["embed"] @ p["input"] + p["bias"]
    h, last = np.zeros((len(n), HIDDEN), table.dtype), np.full(len(n), end)
    for lo in range(0, int(n[0]) if len(n) else 0, WINDOW):
        c = int(np.searchsorted(-n, -lo))  # documents longer than lo
        hs, ws, ds = [], [], []
        for t in range(lo, min(lo + WINDOW, int(n[0]))):
            m = int(np.searchsorted(-n[:c], -t))
            if not m:
                break
            h[:m] = step(p, table[last[:m]], h[:m])[0]
            last[:m] = words[s[:m] + t]
            hs.append(h[:m].copy())
            ws.append(last[:m].copy())
            ds.append(m)
        lp = log_prob(p, np.concatenate(hs), np.concatenate(ws))
        out[: ds[0]] += np.bincount(np.concatenate([np.arange(m) for m in ds]), lp, ds[0])
    res = np.empty(len(n))
    res[order] = out
    return res
