"""A small bidirectional LSTM with CRF transitions over character classes, in NumPy."""

from __future__ import annotations

import numpy as np

PUNCTUATION = "@.-+()_%:/,;'\"#&*!?=<>[]{}|\\^~`$"
#: Classes: 0 outside the text, 1 digit, 2 lower, 3 upper, 4 blank, 5 line end, 6 beyond ASCII, 7 other, then each mark.
_CLASS = np.full(256, 7, np.int64)
_CLASS[48:58], _CLASS[97:123], _CLASS[65:91] = 1, 2, 3
_CLASS[[32, 9]], _CLASS[[10, 11, 12, 13]], _CLASS[128:] = 4, 5, 6
for _i, _c in enumerate(PUNCTUATION):
    _CLASS[ord(_c)] = 8 + _i
N_CLASSES = 8 + len(PUNCTUATION)


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS[np.minimum(points, 255)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, tags: int, hidden: int = 16, seed: int = 11):
        rng = np.random.default_rng(seed)
        h = hidden
        self.h, self.k = h, tags
        self.p = {"fx": rng.normal(0, 0.2, (N_CLASSES, 4 * h)), "fh": rng.normal(0, 0.2, (h, 4 * h)),
                  "bx": rng.normal(0, 0.2, (N_CLASSES, 4 * h)), "bh": rng.normal(0, 0.2, (h, 4 * h)),
                  "o": rng.normal(0, 0.2, (2 * h, tags)), "ob": np.zeros(tags), "a": np.zeros((tags, tags))}
        for side in "fb":
            self.p[side + "x"][:, h: 2 * h] += 1.0  # remember at first

    def _run(self, x: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        h = self.h
        wx, wh = self.p[side + "x"], self.p[side + "h"]
        state = cell = np.zeros((len(x), h))
        out, kept = np.empty((len(x), x.shape[1], h)), []
        for t in range(x.shape[1]):
            z = wx[x[:, t]] + state @ wh
            i, f, o = (_sigmoid(z[:, j * h: (j + 1) * h]) for j in range(3))
            g = np.tanh(z[:, 3 * h:])
            new = f * cell + i * g
            th = np.tanh(new)
            kept.append((state, cell, i, f, o, g, th))
            state, cell = o * th, new
            out[:, t] = state
        return out, kept

    def _back(self, x: np.ndarray, side: str, grad: np.ndarray, kept: list) -> dict[str, np.ndarray]:
        h = self.h
        wh = self.p[side + "h"]
        dx, dh = np.zeros_like(self.p[side + "x"]), np.zeros_like(wh)
        ds = dc = np.zeros((len(x), h))
        for t in range(x.shape[1] - 1, -1, -1):
            state, cell, i, f, o, g, th = kept[t]
            ds = ds + grad[:, t]
            dc = dc + ds * o * (1 - th * th)
            dz = np.concatenate([dc * g * i * (1 - i), dc * cell * f * (1 - f), ds * th * o * (1 - o),
                                 dc * i * (1 - g * g)], axis=1)
            np.add.at(dx, x[:, t], dz)
            dh += state.T @ dz
            ds, dc = dz @ wh.T, dc * f
        return {side + "x": dx, side + "h": dh}

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores (rows, positions, tags) of windows of classes."""
        f, _ = self._run(x, "f")
        b, _ = self._run(x[:, ::-1], "b")
        return np.concatenate([f, b[:, ::-1]], axis=2) @ self.p["o"] + self.p["ob"]

    def _grads(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        f, kf = self._run(x, "f")
        b, kb = self._run(x[:, ::-1], "b")
        both = np.concatenate([f, b[:, ::-1]], axis=2)
        e, a = both @ self.p["o"] + self.p["ob"], self.p["a"]
        n, steps, _ = e.shape
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, steps):
            alpha[:, t] = e[:, t] + _logsum(alpha[:, t - 1][:, :, None] + a, 1)
        for t in range(steps - 2, -1, -1):
            beta[:, t] = _logsum(a + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = _logsum(alpha[:, -1], 1)
        rows = np.arange(n)[:, None]
        de = np.exp(alpha + beta - z[:, None, None])
        gold = e[rows, np.arange(steps), y].sum(1) + a[y[:, :-1], y[:, 1:]].sum(1)
        de[rows, np.arange(steps), y] -= 1
        da = np.zeros_like(a)
        for t in range(1, steps):
            da += np.exp(alpha[:, t - 1][:, :, None] + a + (e[:, t] + beta[:, t])[:, None, :]
                         - z[:, None, None]).sum(0)
        np.add.at(da, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        flat = both.reshape(-1, 2 * self.h)
        dboth = de @ self.p["o"].T
        out = {"o": flat.T @ de.reshape(-1, self.k), "ob": de.sum((0, 1)), "a": da}
        out |= self._back(x, "f", dboth[:, :, : self.h], kf)
        out |= self._back(x[:, ::-1], "b", dboth[:, ::-1, self.h:], kb)
        return float((z - gold).mean()), {k: v / n for k, v in out.items()}

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 32, rate: float = 0.02,
              seed: int = 3) -> list[float]:
        """Adam on the negative log likelihood of the labelled paths; returns each epoch's loss."""
        rng, m, v, step, losses = np.random.default_rng(seed), {}, {}, 0, []
        for _ in range(-(-steps * batch // max(1, len(x)))):
            order, total = rng.permutation(len(x)), 0.0
            for lo in range(0, len(x), batch):
                pick = order[lo: lo + batch]
                loss, grads = self._grads(x[pick], y[pick])
                total += loss * len(pick)
                step += 1
                for k, g in grads.items():
                    g = np.clip(g, -5, 5)
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
            losses.append(total / max(1, len(x)))
        return losses

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Best tag path of one sequence of emissions (positions, tags)."""
        a, n = self.p["a"], len(e)
        score, back = e[0], np.zeros((n, self.k), np.int64)
        for t in range(1, n):
            every = score[:, None] + a
            back[t] = every.argmax(0)
            score = every.max(0) + e[t]
        path = np.empty(n, np.int64)
        path[-1] = score.argmax()
        for t in range(n - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path

    def margin(self, e: np.ndarray) -> np.ndarray:
        """Each position's log odds of its best tag over the outside tag, from emissions alone."""
        return e.max(1) - e[:, 0]
