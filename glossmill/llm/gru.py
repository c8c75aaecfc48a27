"""A gated recurrent language model over words, with a class-factored softmax, in numpy.

P(word) = P(class | state) * P(word | class, state). The most frequent words, more of them the more words the corpus
has, are dealt into classes of about equal frequency, in which the model tells them apart. All other words are of
SHAPES further classes by their first two bytes, in which the caller tells them apart by counts; so the vocabulary is all
the corpus, and what language or subject a rare word is of counts. Training is truncated backpropagation over windows,
with the state carried from one to the next.
"""

from __future__ import annotations

import math

import numpy as np

#: Reserved hash of the end of a text, and its place in the vocabulary.
END_HASH, END = np.uint64(0), 0
#: Classes, and inputs, of rare words; the lowest bits of a word's hash tell which of them it is in.
SHAPES = 64
EMBEDDING, STATE = 24, 24
#: Texts side by side in a window: fewer for a small corpus, so that it still gives STEPS windows.
LEAST_STREAMS, STREAMS, WINDOW, STEPS, RATE = 64, 1024, 16, 200, 0.006
#: Rows of states that the output layer takes at a time.
OUTPUT_ROWS = 1 << 14
#: Rows whose classes are priced at once, and streams of a window that go through the model at once, so that they stay in a core's cache.
CACHED_ROWS, CACHED_STREAMS = 1 << 11, 512


def head_size(distinct: int) -> int:
    """How many of the distinct words of a corpus the model tells apart by their states, the end included: it grows with their root."""
    return max(1024, math.isqrt(max(0, distinct)))


def sort_key(x: np.ndarray, most: int) -> np.ndarray:
    """Small numbers as 16 bits, which numpy sorts by radix."""
    return x.astype(np.int16) if most < 1 << 15 else x


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):  # infinity gives 0, as it should
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def log_at(x: np.ndarray, at: np.ndarray, shares: bool) -> np.ndarray:
    """The logarithm of the softmax at one place of each row; x is overwritten, by the shares if they are wanted.

    Values have to stay within what exponents of 32-bit floats take; see _bounded.
    """
    chosen = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    total = x.sum(-1)
    if shares:
        x /= total[:, None]
    return chosen - np.log(total)


class Vocabulary:
    def __init__(self, hashes: np.ndarray, counts: np.ndarray, size: int | None = None, ends: int = 1, shapes: np.ndarray | None = None):
        """The most frequent words after the end, size with it; ties go to the smaller hash. ends: how often a text ends; shapes: tokens of each shape, frequent words included."""
        size = size or head_size(len(hashes))
        order = np.lexsort((hashes, -counts))
        order = order[hashes[order] != END_HASH][: size - 1]
        self.hashes = np.concatenate(([END_HASH], hashes[order]))
        weight = np.sqrt(np.concatenate(([1], counts[order])).astype(np.float64))
        share, classes = np.cumsum(weight) / weight.sum(), max(1, math.isqrt(size // 6))
        own = np.unique(np.minimum((share * classes).astype(np.int64), classes - 1), return_inverse=True)[1]
        self.classes = int(own.max()) + 1
        self.class_of = np.concatenate([own, self.classes + np.arange(SHAPES)])
        self.first = np.searchsorted(own, np.arange(self.classes + 1))
        self.sizes = np.diff(self.first)
        self.sorted = np.argsort(self.hashes)
        # What counts alone say of classes and of words in them, as the model's first biases.
        often = np.concatenate(([max(1, ends)], counts[order])).astype(np.float64)
        in_class = np.bincount(own, often)
        self.word_logs = np.log(often / in_class[own])
        rare = np.zeros(SHAPES) if shapes is None else shapes - np.bincount(shape_of(hashes[order]), counts[order], SHAPES)
        of_class = np.concatenate([in_class, np.maximum(rare, 0) + 0.5])
        self.class_logs = np.log(of_class / of_class.sum())

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the vocabulary; behind its frequent words the classes of the others."""
        at = np.searchsorted(self.hashes, hashes, sorter=self.sorted)
        at = self.sorted[np.minimum(at, len(self.sorted) - 1)]
        return np.where(self.hashes[at] == hashes, at, len(self.hashes) + shape_of(hashes))


def shape_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SHAPES - 1)).astype(np.int64)


class LanguageModel:
    def __init__(self, vocabulary: Vocabulary, seed: int = 5):
        self.v = vocabulary
        r = np.random.default_rng(seed)
        wide = int(vocabulary.sizes.max())
        shapes = {
            "embed": (len(vocabulary.hashes) + SHAPES, EMBEDDING), "w": (EMBEDDING, 3 * STATE), "u": (STATE, 3 * STATE), "b": (3 * STATE,),
            "c": (STATE, vocabulary.classes + SHAPES), "c_b": (vocabulary.classes + SHAPES,), "o": (vocabulary.classes, STATE, wide), "o_b": (vocabulary.classes, wide),
        }
        self.p = {k: (r.normal(0, 0.1 if k == "embed" else s[-2] ** -0.5, s) if len(s) > 1 and not k.endswith("_b") else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
        self.p["c_b"][:] = vocabulary.class_logs
        for k in range(vocabulary.classes):  # places past a class's words never get a share
            self.p["o_b"][k, : vocabulary.sizes[k]] = vocabulary.word_logs[vocabulary.first[k] : vocabulary.first[k + 1]]
            self.p["o_b"][k, vocabulary.sizes[k] :] = -1e4
        self.p["o"][:] *= 0.1
        self.p["c"][:] *= 0.1

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def load(self, flat: np.ndarray) -> LanguageModel:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = flat[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n
        return self

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """x: the input's part of the gates."""
        hu = h @ self.p["u"]
        zr = sigmoid(x[:, : 2 * STATE] + hu[:, : 2 * STATE])
        z, r, hu = zr[:, :STATE], zr[:, STATE:], hu[:, 2 * STATE :]
        n = r * hu
        n += x[:, 2 * STATE :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n, hu

    @staticmethod
    def _logits(states: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """States are from -1 to 1, so that most weights can't lead beyond what exponents take; where they might, values are held."""
        out = states @ weights
        out += bias
        if np.abs(weights).sum(0).max(initial=0) + np.abs(bias).max(initial=0) > 80:
            np.clip(out, -80, 80, out=out)
        return out

    def _output(self, states: np.ndarray, ids: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each word (of the class alone for rare ones), and the gradient of its negative sum by the states."""
        v, p, n = self.v, self.p, len(ids)
        classes, out = v.class_of[ids], np.empty(n)
        d_states = None
        if grads is not None:
            d_states = np.empty_like(states)
            grads |= {k: np.zeros_like(p[k]) for k in ("c", "c_b", "o", "o_b")}
        for low in range(0, n, CACHED_ROWS):
            own, part = classes[low : low + CACHED_ROWS], states[low : low + CACHED_ROWS]
            d = self._logits(part, p["c"], p["c_b"])
            out[low : low + len(own)] = log_at(d, own, grads is not None)
            if grads is not None:
                d[np.arange(len(own)), own] -= 1
                grads["c"] += part.T @ d
                grads["c_b"] += d.sum(0)
                np.matmul(d, p["c"].T, out=d_states[low : low + len(own)])
        frequent = np.flatnonzero(classes < v.classes)
        order = frequent[np.argsort(sort_key(classes[frequent], v.classes), kind="stable")]
        borders = np.searchsorted(classes[order], np.arange(v.classes + 1))
        for k in range(v.classes):
            own = order[borders[k] : borders[k + 1]]
            if not len(own):
                continue
            size, part, place = v.sizes[k], states[own], ids[own] - v.first[k]
            weights = p["o"][k, :, :size]
            d = self._logits(part, weights, p["o_b"][k, :size])
            out[own] += log_at(d, place, grads is not None)
            if grads is not None:
                d[np.arange(len(own)), place] -= 1
                grads["o"][k, :, :size], grads["o_b"][k, :size] = part.T @ d, d.sum(0)
                d_states[own] += d @ weights.T
        return out, d_states

    def train(self, texts: list[np.ndarray], rate: float = RATE, passes: int = 1, seed: int = 3, least: int = STEPS) -> int:
        """texts: hashes of words, without their end; least: windows that a pass has at least, if it can; returns the number of words learned from."""
        texts = [x for x in texts if len(x)]
        if not texts:
            return 0
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(x) for k, x in self.p.items()}
        s = {k: np.zeros_like(x) for k, x in self.p.items()}
        steps, learned = 0, 0
        for _ in range(passes):
            order = r.permutation(len(texts))
            joined = np.concatenate([y for i in order for y in (texts[i], np.zeros(1, np.uint64))])
            streams = max(1, min(max(LEAST_STREAMS, min(STREAMS, len(joined) // (WINDOW * least))), len(joined) // WINDOW))
            length = len(joined) // streams
            hashes = joined[: streams * length].reshape(streams, length)
            ids = self.v.ids(hashes).astype(np.int32)
            inputs = np.zeros_like(ids)
            inputs[:, 1:] = ids[:, :-1]
            h, total = np.zeros((streams, STATE), np.float32), passes * -(-length // WINDOW)
            for low in range(0, length, WINDOW):
                grads, h = self.gradients(inputs[:, low : low + WINDOW], ids[:, low : low + WINDOW], h)
                steps += 1
                for g in grads.values():
                    g /= streams * WINDOW
                norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
                scale = min(1.0, 1.0 / max(norm, 1e-9))
                now = rate * (1 - 0.9 * steps / total) * math.sqrt(1 - 0.99**steps) / (1 - 0.9**steps)
                for k, g in grads.items():
                    g *= scale
                    d = np.subtract(g, m[k])
                    d *= 0.1
                    m[k] += d
                    np.multiply(g, g, out=d)
                    d -= s[k]
                    d *= 0.01
                    s[k] += d
                    np.sqrt(s[k], out=d)
                    d += 1e-8
                    np.divide(m[k], d, out=d)
                    d *= now
                    self.p[k] -= d
            learned += streams * length
        return learned

    def gradients(self, inputs: np.ndarray, ids: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the negative sum of log probabilities, and the last states. inputs and ids: a row a stream, a column a step.

        Inputs are words, of which there are few kinds, so that their part of the gates and its gradient are made a kind at a time.
        """
        p, grads, after = self.p, None, np.empty_like(h)
        table = p["embed"] @ p["w"] + p["b"]
        for low in range(0, len(h), CACHED_STREAMS):
            own = slice(low, low + CACHED_STREAMS)
            part, after[own] = self._window(inputs[own], ids[own], h[own], table)
            grads = part if grads is None else {k: np.add(g, part[k], out=g) for k, g in grads.items()}
        d = grads.pop("table")
        return grads | {"embed": d @ p["w"].T, "w": p["embed"].T @ d, "b": d.sum(0)}, after

    def _window(self, inputs: np.ndarray, ids: np.ndarray, h: np.ndarray, table: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """As gradients(), for streams that fit a cache, with the gradient of the table of gates by input."""
        p, kept = self.p, []
        inputs, ids = np.ascontiguousarray(inputs.T), np.ascontiguousarray(ids.T)
        steps, streams = inputs.shape
        gates = table[inputs]
        states, before = np.empty((steps, streams, STATE), gates.dtype), np.empty((steps, streams, STATE), gates.dtype)
        going = (inputs != END)[:, :, None].astype(gates.dtype)
        for t in range(steps):
            np.multiply(h, going[t], out=before[t])  # a text starts from nothing
            h, z, r, n, hu = self.step(gates[t], before[t])
            kept.append((z, r, n, hu))
            states[t] = h
        grads: dict[str, np.ndarray] = {}
        _, d = self._output(states.reshape(-1, STATE), ids.ravel(), grads)
        d = d.reshape(states.shape)
        d_gates, d_hu = np.empty_like(gates), np.empty_like(states)
        d_h = np.zeros_like(h)
        to_zr, to_n = p["u"][:, : 2 * STATE].T.copy(), p["u"][:, 2 * STATE :].T.copy()
        for t in range(steps - 1, -1, -1):
            z, r, n, hu = kept[t]
            g = d[t] + d_h
            left = 1 - z
            d_n = g * left
            d_n *= 1 - n * n
            np.multiply(d_n, r, out=d_hu[t])
            own = d_gates[t]
            own[:, 2 * STATE :] = d_n
            own[:, STATE : 2 * STATE] = d_hu[t] * hu * (1 - r)
            g *= z
            own[:, :STATE] = g * (before[t] - n) * left
            g += own[:, : 2 * STATE] @ to_zr
            g += d_hu[t] @ to_n
            g *= going[t]
            d_h = g
        flat, past = d_gates.reshape(-1, 3 * STATE), before.reshape(-1, STATE)
        d_u = np.concatenate([past.T @ flat[:, : 2 * STATE], past.T @ d_hu.reshape(-1, STATE)], 1)
        grads |= {"u": d_u, "table": np.zeros_like(table)}
        order = np.argsort(sort_key(inputs, len(table)), axis=None, kind="stable")
        own = inputs.ravel()[order]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        grads["table"][own[starts]] = np.add.reduceat(flat[order], starts, axis=0)
        return grads, h

    def score(self, hashes: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For whole texts: log10 probability of words and end (of the class alone for rare words), rare words, and all ids."""
        lengths = np.diff(borders)
        ids = self.v.ids(hashes)
        rest = np.bincount(np.repeat(np.arange(len(lengths)), lengths), ids >= len(self.v.hashes), minlength=len(lengths)).astype(np.int64)
        order = np.argsort(-lengths, kind="stable")
        start, length = borders[:-1][order], lengths[order]
        table = (self.p["embed"] @ self.p["w"] + self.p["b"]).astype(np.float32)
        h = np.zeros((len(order), STATE), np.float32)
        out = np.zeros(len(order))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def flush() -> None:
            logs, _ = self._output(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
            at = 0
            for a, _ in held:  # the texts of a step are the first ones
                out[: len(a)] += logs[at : at + len(a)]
                at += len(a)

        ended = np.searchsorted(-length, -np.arange(int(length[0]) + 2 if len(length) else 0), "right")  # texts of at least so many words
        for t in range(int(length[0]) + 1 if len(length) else 0):
            k = int(ended[t])
            gates = table[ids[start[:k] + t - 1]] if t else np.broadcast_to(table[END], (k, 3 * STATE))
            now = self.step(gates, h[:k])[0]
            h[:k] = now
            going = int(ended[t + 1])  # those with a word here; for the others this is the end
            target = np.zeros(k, np.int64)
            target[:going] = ids[start[:going] + t]
            held.append((now, target))
            rows += k
            if rows >= OUTPUT_ROWS:
                flush()
                held, rows = [], 0
        if held:
            flush()
        scores = np.empty(len(order))
        scores[order] = out / np.log(10)
        return scores, rest, ids
