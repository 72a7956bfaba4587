"""A gated recurrent language model with a class-factored softmax, in numpy.

Word 0 stands for all words outside the vocabulary, word 1 for the end of a document; either is a class of its
own. The other words, most frequent first, make classes of ``per_class``. The state before a document is zero;
each word is scored from the state before it and then read. Learning runs back through ``window`` steps; the
state itself is carried from window to window, so a document is scored as a whole.
"""

from __future__ import annotations

import numpy as np

OTHER, END = 0, 1
#: Weights and output biases stay within these: no logit of up to 16 states exceeds 84, whose exponential is a float32.
LARGEST, LARGEST_BIAS = 4.0, 20.0


class Shape:
    def __init__(self, words: int, hidden: int, per_class: int):
        """``words``: the vocabulary without the two special words; rounded up to whole classes."""
        if hidden > 16:
            raise ValueError("at most 16 hidden units")
        self.m, self.h = per_class, hidden
        self.groups = -(-words // per_class)
        self.classes, self.vocab = 2 + self.groups, 2 + self.groups * per_class
        h = hidden
        sizes = {"gates": (self.vocab, 3 * h), "turn": (h, 3 * h), "bias": (3 * h,), "class_w": (h, self.classes), "class_b": (self.classes,), "word_w": (self.groups, h, per_class), "word_b": (self.groups, per_class)}
        self.at, n = {}, 0
        for k, s in sizes.items():
            self.at[k] = (n, n + int(np.prod(s)), s)
            n += int(np.prod(s))
        self.size = n

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        return {k: flat[a:b].reshape(s) for k, (a, b, s) in self.at.items()}

    def start(self, counts: np.ndarray, seed: int = 3) -> np.ndarray:
        """Small random weights; biases such that the model begins at the frequencies ``counts`` of its words."""
        flat = np.zeros(self.size, np.float32)
        p, draw = self.views(flat), np.random.default_rng(seed)
        p["gates"][:] = draw.normal(0, 0.3, p["gates"].shape)
        p["turn"][:] = draw.normal(0, 0.5 / np.sqrt(self.h), p["turn"].shape)
        p["bias"][self.h : 2 * self.h] = 1.0  # keep most of the state at first
        p["class_w"][:] = draw.normal(0, 0.05, p["class_w"].shape)
        p["word_w"][:] = draw.normal(0, 0.05, p["word_w"].shape)
        full = np.zeros(self.vocab)
        full[: len(counts)] = counts
        logs = np.log(full + 0.5)
        groups = full[2:].reshape(self.groups, self.m)
        p["class_b"][:2] = logs[:2]
        p["class_b"][2:] = np.log(groups.sum(1) + 0.5)
        p["class_b"] -= p["class_b"].max()
        p["word_b"][:] = logs[2:].reshape(self.groups, self.m) - logs[2:].reshape(self.groups, self.m).max(1, keepdims=True)
        p["word_b"][full[2:].reshape(self.groups, self.m) == 0] = -LARGEST_BIAS  # places that no word has
        return flat


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


def _softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials, in place, and their sums over each column. The logits are weights of a clipped size times states within 1,
    so no maximum needs to be taken out first."""
    e = np.exp(x, out=x)
    return e, e.sum(0)


class Lanes:
    """Documents laid end to end in lanes that are read side by side; the fullest lanes come first."""

    def __init__(self, docs: list[np.ndarray], lanes: int):
        import heapq

        n = max(1, min(lanes, len(docs)))
        heap, held = [(0, i) for i in range(n)], [[] for _ in range(n)]
        for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
            load, i = heapq.heappop(heap)
            held[i].append(d)
            heapq.heappush(heap, (load + len(docs[d]), i))
        loads = [sum(len(docs[d]) for d in x) for x in held]
        order = sorted(range(n), key=lambda i: -loads[i])
        self.length = np.array([loads[i] for i in order])
        self.begin = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        ids = [d for i in order for d in held[i]]
        self.words = np.concatenate([docs[d] for d in ids]) if ids else np.empty(0, np.int64)
        self.doc = np.repeat(np.array(ids, np.int64), [len(docs[d]) for d in ids])

    def windows(self, steps: int):
        """``(words, doc, mask)``, each step x lane; the mask is 0 past a lane's end."""
        at = 0
        while (n := int((self.length > at).sum())) > 0:
            t = at + np.arange(min(steps, int(self.length[0]) - at))[:, None]
            mask = t < self.length[:n]
            place = np.minimum(self.begin[:n] + t, len(self.words) - 1)
            yield self.words[place].astype(np.int64), self.doc[place], mask
            at += steps


class Model:
    def __init__(self, shape: Shape, flat: np.ndarray):
        self.shape, self.flat, self.p = shape, flat, shape.views(flat)

    def _parts(self) -> list[np.ndarray]:
        """The weights by the state of each gate, in one piece each: numpy is slow on slices of short rows."""
        n = self.shape.h
        return [np.ascontiguousarray(self.p["turn"][:, k * n : (k + 1) * n]) for k in range(3)]

    def _read(self, words: np.ndarray, h: np.ndarray, keep: bool):
        """States before each step, the state after the last, and what learning needs."""
        p, n = self.p, self.shape.h
        steps, lanes = words.shape
        states = np.empty((steps, lanes, n), np.float32)
        kept = []
        table = p["gates"] + p["bias"]
        tables, turns = [np.ascontiguousarray(table[:, k * n : (k + 1) * n]) for k in range(3)], self._parts()
        for t in range(steps):
            states[t] = h
            r, z, new = (x.take(words[t], axis=0) for x in tables)
            r += h @ turns[0]
            z += h @ turns[1]
            turn = h @ turns[2]
            _sigmoid(r)
            _sigmoid(z)
            new += r * turn
            np.tanh(new, out=new)
            ended = np.flatnonzero(words[t] == END)  # a document's end clears the state
            if keep:
                kept.append((r, z, new, turn, ended))
            h = states[t] - new
            h *= z
            h += new
            h[ended] = 0
        return states, h, kept

    def _score(self, states: np.ndarray, words: np.ndarray, learn: dict | None):
        """Natural-log probability of each word from its state; with ``learn``, also the gradient of minus their sum
        by the states, the other gradients being added to ``learn``. Logits have a column for each word."""
        p, m = self.p, self.shape.m
        of = np.where(words < 2, words, 2 + (words - 2) // m).astype(np.uint16)
        d, whole = _softmax(p["class_w"].T @ states.T + p["class_b"][:, None])
        at = np.arange(len(words))
        out = np.log(d[of, at] / whole)
        back = None
        if learn is not None:
            d /= whole
            d[of, at] -= 1
            learn["class_w"] += (d @ states).T
            learn["class_b"] += d.sum(1)
            back = d.T @ p["class_w"].T
        order = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[order], np.arange(2, self.shape.classes + 1))
        order = order[bounds[0] :]
        own_states, which = states[order], (words[order] - 2) % m
        more, own_back = np.empty(len(order), np.float32), np.empty_like(own_states) if learn is not None else None
        bounds = bounds - bounds[0]
        for g in range(self.shape.groups):
            b, e = bounds[g], bounds[g + 1]
            if b == e:
                continue
            own = own_states[b:e]
            d, whole = _softmax(p["word_w"][g].T @ own.T + p["word_b"][g][:, None])
            k = np.arange(e - b)
            more[b:e] = np.log(d[which[b:e], k] / whole)
            if learn is not None:
                d /= whole
                d[which[b:e], k] -= 1
                learn["word_w"][g] += (d @ own).T
                learn["word_b"][g] += d.sum(1)
                own_back[b:e] = d.T @ p["word_w"][g].T
        out[order] += more
        if learn is not None:
            back[order] += own_back
        return out, back

    def score(self, docs: list[np.ndarray], lanes: int = 1024, window: int = 32) -> np.ndarray:
        """Natural-log probability of each document, given as word numbers with the end at its end."""
        total = np.zeros(len(docs))
        h = None
        for words, doc, mask in Lanes(docs, lanes).windows(window):
            h = np.zeros((words.shape[1], self.shape.h), np.float32) if h is None else h[: words.shape[1]]
            states, h, _ = self._read(words, h, False)
            logs, _ = self._score(states[mask], words[mask], None)
            total += np.bincount(doc[mask], weights=logs, minlength=len(docs))
        return total

    def gradient(self, words: np.ndarray, mask: np.ndarray, h: np.ndarray):
        """Gradient of the mean of minus the log probabilities, their sum, and the state after the window."""
        p, n = self.p, self.shape.h
        flat = np.zeros(self.shape.size, np.float32)
        g = self.shape.views(flat)
        states, after, kept = self._read(words, h, True)
        logs, back = self._score(states[mask], words[mask], g)
        d_states = np.zeros_like(states)
        d_states[mask] = back
        d_gates = np.empty((3, *words.shape, n), np.float32)
        turned = np.empty((*words.shape, n), np.float32)  # the third gate's, by what its state gave
        turns = [np.ascontiguousarray(x.T) for x in self._parts()]
        d_h = np.zeros_like(h)
        for t in reversed(range(len(words))):
            r, z, new, turn, ended = kept[t]
            d_h[ended] = 0
            d_r, d_z, d_new = d_gates[:, t]
            rest = 1 - z
            np.multiply(d_h, rest, out=d_new)
            d_new *= 1 - new * new
            np.multiply(d_h, states[t] - new, out=d_z)
            d_z *= z
            d_z *= rest
            np.multiply(d_new, turn, out=d_r)
            d_r *= r
            d_r *= 1 - r
            np.multiply(d_new, r, out=turned[t])
            d_h *= z
            d_h += d_r @ turns[0]
            d_h += d_z @ turns[1]
            d_h += turned[t] @ turns[2]
            d_h += d_states[t]
        before = states.reshape(-1, n).T
        g["turn"] += np.concatenate([before @ x.reshape(-1, n) for x in (d_gates[0], d_gates[1], turned)], 1)
        every = np.concatenate([x.reshape(-1, n) for x in d_gates], 1)
        g["bias"] += every.sum(0)
        # Rows of the table of gates are summed up word by word.
        w = words.ravel()
        order = np.argsort(w.astype(np.uint16), kind="stable")
        names, first = np.unique(w[order], return_index=True)
        g["gates"][names] += np.add.reduceat(every[order], first, axis=0)
        flat /= max(1, int(mask.sum()))
        return flat, float(logs.sum()), after


class Learner:
    """Adam over windows; ``rate`` is scaled down for windows of few words."""

    def __init__(self, model: Model, rate: float = 0.01, full: int = 2048, clip: float = 1.0):
        self.model, self.rate, self.full, self.clip = model, rate, full, clip
        self.a, self.b, self.t = np.zeros_like(model.flat), np.zeros_like(model.flat), 0
        self.words = 0

    def learn(self, docs: list[np.ndarray], lanes: int = 512, window: int = 16) -> float:
        h, total = None, 0.0
        for words, _, mask in Lanes(docs, lanes).windows(window):
            h = np.zeros((words.shape[1], self.model.shape.h), np.float32) if h is None else h[: words.shape[1]]
            g, logs, h = self.model.gradient(words, mask, h)
            total += logs
            n = int(mask.sum())
            self.words += n
            norm = float(np.sqrt((g * g).sum()))
            if norm > self.clip:
                g *= self.clip / norm
            self.t += 1
            self.a += 0.1 * (g - self.a)
            self.b += 0.005 * (g * g - self.b)
            step = self.rate * min(1.0, n / self.full) * np.sqrt(1 - 0.995**self.t) / (1 - 0.9**self.t)
            self.model.flat -= step * self.a / (np.sqrt(self.b) + 1e-8)
            for k, v in self.model.p.items():
                np.clip(v, -(top := LARGEST_BIAS if k in ("class_b", "word_b") else LARGEST), top, v)
        return total
