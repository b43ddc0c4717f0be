"""A small gated recurrent language model in numpy with a class-factored softmax.

Input symbols are the frequent words, one symbol per shape of the other words, and the end mark.  The output
is P(class | state) * P(word | class, state): each class holds some frequent words, or all other
words of one shape, whose words follow their corpus counts (the caller's part).  Training is
truncated backpropagation through windows of ``WINDOW`` steps with Adam; the state goes on from window to
window until a document ends.
"""

from __future__ import annotations

import numpy as np

HIDDEN, WINDOW = 16, 32
F = np.float32


class Layout:
    """Symbols 0..n-1; ``cls[s]`` is the class of a symbol, ``at[s]`` its place in the class.
    ``members[c]`` are a class's symbols; classes of one symbol have no softmax of their own."""

    def __init__(self, counts: np.ndarray, singles: int, classes: int):
        """``counts`` by symbol; the last ``singles`` symbols are classes of their own, the others
        (most frequent first) are cut into ``classes`` classes of equal mass of square-rooted counts."""
        n = len(counts)
        free = n - singles
        mass = np.cumsum(np.sqrt(counts[:free].astype(float) + 1))
        own = np.minimum((mass / mass[-1] * classes).astype(np.int64), classes - 1) if free else np.zeros(0, np.int64)
        _, own = np.unique(own, return_inverse=True) if free else (None, own)
        top = int(own.max()) + 1 if free else 0
        self.cls = np.concatenate([own, top + np.arange(singles)])
        self.members = [np.flatnonzero(self.cls == c) for c in range(top + singles)]
        self.first = np.array([m[0] for m in self.members])
        self.n, self.counts = n, counts


def initial(layout: Layout, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    h, n = HIDDEN, layout.n
    by_class = np.bincount(layout.cls, layout.counts + 0.1)
    return {"x": rng.normal(0, 0.1, (n, 3 * h)).astype(F), "u": rng.normal(0, 0.15, (h, 3 * h)).astype(F),
            "wc": np.zeros((h, len(layout.members)), F), "bc": np.log(by_class / by_class.sum()).astype(F),
            "ww": np.zeros((n, h), F),
            "bw": np.log((layout.counts + 0.1) / by_class[layout.cls]).astype(F)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= F(0.5)
    np.tanh(x, out=x)
    x += 1
    x *= F(0.5)
    return x


def gates(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The reset, update and candidate thirds of an array's last axis, each in one piece: what works on whole
    arrays then runs over them end to end."""
    return tuple(np.ascontiguousarray(w[..., k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))


def step(u: tuple, h: np.ndarray, xr: np.ndarray, xz: np.ndarray, xc: np.ndarray):
    """The next state, and reset, update, candidate and the candidate's product with the state."""
    ur, uz, uc = u
    r = h @ ur
    r += xr
    r = _sigmoid(r)
    z = h @ uz
    z += xz
    z = _sigmoid(z)
    v = h @ uc
    c = r * v
    c += xc
    np.tanh(c, out=c)
    new = h - c
    new *= z
    new += c
    return new, r, z, c, v


def _exp(w: np.ndarray) -> np.ndarray:
    """Row-wise exponentials of scores, in place, and their sums.  Scores are shifted only where they must be: all by
    the greatest if that is large, and a row by its own where nothing would be left of it."""
    top = float(w.max(initial=0.0))
    if top > 60:
        w -= F(top)
    low = w.max(axis=1) if top > 60 or float(w.min(initial=0.0)) < -60 else None
    if low is not None and (low < -60).any():
        at = low < -60
        w[at] -= low[at][:, None]
    np.exp(w, out=w)
    return w.sum(axis=1)


def _log_probs(w: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise log of the softmax of ``w`` (which is used up) at ``y``."""
    if w.size and (float(w.max()) > 60 or float(w.min()) < -60):
        w -= w.max(axis=1, keepdims=True)
    own = w[np.arange(len(y)), y]
    np.exp(w, out=w)
    return own - np.log(w.sum(axis=1))


def log_probs(p: dict, layout: Layout, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probability of symbol ``y`` given each state row."""
    logit = h @ p["wc"]
    logit += p["bc"]
    cls = layout.cls[y]
    out = _log_probs(logit, cls)
    order = np.argsort(cls.astype(np.uint8) if len(layout.members) < 256 else cls, kind="stable")
    cuts = np.searchsorted(cls[order], np.arange(len(layout.members) + 1))
    for c, m in enumerate(layout.members):
        if len(m) > 1 and cuts[c] < cuts[c + 1]:
            i = order[cuts[c]:cuts[c + 1]]
            a, b = m[0], m[-1] + 1
            w = h[i] @ p["ww"][a:b].T
            w += p["bw"][a:b]
            out[i] += _log_probs(w, y[i] - a)
    return out


class Lanes:
    """Documents of symbols laid end to end on lanes, longest lane first.  At time t the first
    ``live[t]`` lanes have a symbol; ``place[lane, t]`` is its position in the joined symbols."""

    def __init__(self, off: np.ndarray, lanes: int):
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")
        lanes = max(1, min(lanes, len(order)))
        filled = np.zeros(lanes, np.int64)
        spots: list[list[int]] = [[] for _ in range(lanes)]
        for at in range(0, len(order), lanes):  # the longest rest to the emptiest lane
            some = order[at:at + lanes]
            to = np.argsort(filled, kind="stable")[:len(some)]
            filled[to] += size[some]
            for d, lane in zip(some.tolist(), to.tolist()):
                spots[lane].append(d)
        rank = np.argsort(-filled, kind="stable")
        self.steps = int(filled.max()) if len(filled) else 0
        self.start, self.length = [], []
        for lane in rank.tolist():
            self.start.append(np.array(spots[lane], np.int64))
        self.filled = filled[rank]
        self.off, self.size = off, size
        self.live = np.searchsorted(-self.filled, -np.arange(self.steps), side="left")

    def window(self, t: int, w: int):
        """(positions, is first of its document) as arrays [step, lane]; -1 where a lane is over."""
        n = int(self.live[t])
        if not hasattr(self, "flat"):
            self.flat = [np.concatenate([np.arange(self.off[d], self.off[d] + self.size[d]) for d in s])
                         if len(s) else np.zeros(0, np.int64) for s in self.start]
        out = np.full((w, n), -1, np.int64)
        for lane in range(n):
            part = self.flat[lane][t:t + w]
            out[:len(part), lane] = part
        return out


def score(p: dict, layout: Layout, symbols: np.ndarray, off: np.ndarray, lanes: int = 512) -> np.ndarray:
    """Log probability of every symbol; each document (``off``) starts from the zero state, which
    is carried over its windows to its end."""
    out = np.zeros(len(symbols), F)
    if not len(symbols):
        return out
    plan = Lanes(off, lanes)
    fresh = np.zeros(len(symbols) + 1, dtype=bool)
    fresh[off[:-1]] = True
    state = np.zeros((len(plan.filled), HIDDEN), F)
    into = np.zeros(len(plan.filled), np.int64)
    u = gates(p["u"])
    for t in range(0, plan.steps, WINDOW):
        w = min(WINDOW, plan.steps - t)
        pos = plan.window(t, w)
        new_text = fresh[pos]
        some = new_text.any(axis=1)
        sym = symbols[pos]
        xr, xz, xc = gates(p["x"][np.vstack([into[None, :sym.shape[1]], sym[:-1]])])
        held = []
        for k in range(w):
            n = int(plan.live[t + k])
            h, *_ = step(u, state[:n], xr[k, :n], xz[k, :n], xc[k, :n])
            if some[k]:
                h[new_text[k, :n]] = 0
            state[:n] = h
            held.append(h)
        into[:n] = sym[-1, :n]
        at = pos[pos >= 0]
        out[at] = log_probs(p, layout, np.concatenate(held), symbols[at])
    return out


class Adam:
    def __init__(self, p: dict, rate: float):
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def update(self, p: dict, g: dict) -> None:
        self.t += 1
        rate = F(self.rate * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t))
        norm = F(min(1.0, 5.0 / (1e-6 + np.sqrt(sum(float((x * x).sum()) for x in g.values())))))
        for k, x in g.items():
            x *= norm
            self.m[k] += F(0.1) * (x - self.m[k])
            self.v[k] += F(0.001) * (x * x - self.v[k])
            p[k] -= rate * self.m[k] / (np.sqrt(self.v[k]) + F(1e-6))


def train(p: dict, layout: Layout, symbols: np.ndarray, off: np.ndarray, rate: float, lanes: int = 256,
          opt: Adam | None = None) -> Adam:
    """One pass of truncated backpropagation over the documents; ``p`` is changed in place."""
    opt = opt or Adam(p, rate)
    if not len(symbols):
        return opt
    plan = Lanes(off, lanes)
    fresh = np.zeros(len(symbols) + 1, dtype=bool)
    fresh[off[:-1]] = True
    k3 = HIDDEN
    state = np.zeros((len(plan.filled), HIDDEN), F)
    last = np.full(len(plan.filled), -1)
    for t in range(0, plan.steps, WINDOW):
        w = min(WINDOW, plan.steps - t)
        pos = plan.window(t, w)
        # What goes in is known ahead: the symbol before, or none at a document's start.
        lanes_now = int(plan.live[t])
        before = np.vstack([last[None, :lanes_now], pos[:-1]])
        goes = ~fresh[pos] & (before >= 0)
        intos = symbols[before]
        xr, xz, xc = gates(p["x"][intos])
        u = gates(p["u"])
        # Lanes end from the last one on, so the window's steps lie one after the other, each a prefix of the lanes.
        live = [int(n) for n in plan.live[t:t + w]]
        ends = np.cumsum(live)
        on = np.concatenate([np.arange(n) + k * lanes_now for k, n in enumerate(live)]) if live[-1] < lanes_now else slice(None)
        flat = lambda x: x.reshape(w * lanes_now, *x.shape[2:])[on]
        olds, rs, zs, cs, vs, news = (np.empty((w, lanes_now, HIDDEN), F) for _ in range(6))
        stop = ~goes
        some = stop.any(axis=1)
        for k, n in enumerate(live):
            old = state[:n]
            olds[k, :n] = old
            new, rs[k, :n], zs[k, :n], cs[k, :n], vs[k, :n] = step(u, old, xr[k, :n], xz[k, :n], xc[k, :n])
            if some[k]:
                new[stop[k, :n]] = 0
            news[k, :n] = state[:n] = new
            last[:n] = pos[k, :n]
        at = flat(pos)
        stop, into, old, r, z, new, v, h = map(flat, (stop, intos, olds, rs, zs, cs, vs, news))
        y = symbols[at]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        scale = F(1.0 / len(y))
        e = h @ p["wc"]
        e += p["bc"]
        cls = layout.cls[y]
        e *= (scale / _exp(e))[:, None]
        e[np.arange(len(y)), cls] -= scale
        g["wc"], g["bc"] = h.T @ e, e.sum(axis=0)
        dh = e @ p["wc"].T
        order = np.argsort(cls.astype(np.uint8) if len(layout.members) < 256 else cls, kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(len(layout.members) + 1))
        sorted_h, sorted_y = h[order], y[order]
        inner = np.zeros_like(sorted_h)
        for c, m in enumerate(layout.members):
            lo, hi = cuts[c], cuts[c + 1]
            if len(m) > 1 and lo < hi:
                a, b = m[0], m[-1] + 1
                own = sorted_h[lo:hi]
                q = own @ p["ww"][a:b].T
                q += p["bw"][a:b]
                q *= (scale / _exp(q))[:, None]
                q[np.arange(hi - lo), sorted_y[lo:hi] - a] -= scale
                g["ww"][a:b] = q.T @ own
                g["bw"][a:b] = q.sum(axis=0)
                np.matmul(q, p["ww"][a:b], out=inner[lo:hi])
        dh[order] += inner
        # Per position what a state's gradient is worth to the gates; nothing where a document starts.
        zero = np.flatnonzero(stop)
        to_c = (1 - z) * (1 - new * new)
        to_z = old - new
        to_z *= z
        to_z *= 1 - z
        to_r = to_c * v
        to_r *= r
        to_r *= 1 - r
        to_v = to_c * r
        for x in (to_c, to_z, to_r, to_v, z, dh):
            x[zero] = 0
        back = np.zeros((live[0], HIDDEN), F)
        ur, uz, uc = (np.ascontiguousarray(x.T) for x in u)
        held = ~stop
        for k in range(w - 1, -1, -1):
            n, e = live[k], int(ends[k])
            d = dh[e - n:e]
            if some[k]:
                d += back[:n] * held[e - n:e, None]
            else:
                d += back[:n]
            to_r[e - n:e] *= d
            to_z[e - n:e] *= d
            to_v[e - n:e] *= d
            back[:n] = to_r[e - n:e] @ ur
            back[:n] += to_z[e - n:e] @ uz
            back[:n] += to_v[e - n:e] @ uc
            back[:n] += d * z[e - n:e]
        to_c *= dh
        g["u"] = np.concatenate([old.T @ to_r, old.T @ to_z, old.T @ to_v], axis=1)
        gate = np.concatenate([to_r, to_z, to_c], axis=1)
        order = np.argsort(into.astype(np.uint16) if layout.n < 1 << 16 else into, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], into[order][1:] != into[order][:-1]]))
        g["x"][into[order][at]] = np.add.reduceat(gate[order], at, axis=0)
        opt.update(p, g)
    return opt
