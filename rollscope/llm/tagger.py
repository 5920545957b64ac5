"""Character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

PAD = 0
# Characters with a number of their own; digits share one, and so do all other letters and signs.
SIGNS = "abcdefghijklmnopqrstuvwxyz@.+-()[]_%/:,;='\" \n"
DIGIT, LETTER, OTHER = len(SIGNS) + 1, len(SIGNS) + 2, len(SIGNS) + 3
_NUMBER = {c: i for i, c in enumerate(SIGNS, 1)} | {str(d): DIGIT for d in range(10)}


def encoded(text: str) -> np.ndarray:
    """One number a character; case doesn't matter."""
    low = text.lower()
    if len(low) != len(text):  # a few letters have two lower-case ones
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    numbers = (_NUMBER.get(c) or (LETTER if c.isalpha() else OTHER) for c in low)
    return np.fromiter(numbers, dtype=np.int64, count=len(low))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class Tagger:
    """Scores every character of windows for each tag and decodes paths under tag transitions."""

    def __init__(self, n_tags: int, embedding: int = 12, hidden: int = 16, seed: int = 0):
        rng = np.random.default_rng(seed)
        scaled = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.n_tags, self.hidden = n_tags, hidden
        self.p = {"embed": scaled(OTHER + 1, embedding), "out": scaled(2 * hidden, n_tags)}
        self.p |= {"bias": np.zeros(n_tags, np.float32), "move": np.zeros((n_tags, n_tags), np.float32)}
        for way in "fb":
            self.p |= {f"x{way}": scaled(embedding, 4 * hidden), f"h{way}": scaled(hidden, 4 * hidden)}
            self.p[f"b{way}"] = np.repeat(np.float32([0, 1, 0, 0]), hidden)  # the forget gate starts open

    def _run(self, way: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states over (batch, time, embedding); gates are input, forget, output, candidate."""
        n, time, _ = x.shape
        h = c = np.zeros((n, self.hidden), np.float32)
        given = x @ self.p[f"x{way}"] + self.p[f"b{way}"]
        out = np.empty((n, time, self.hidden), np.float32)
        for t in range(time) if way == "f" else range(time - 1, -1, -1):
            z = given[:, t] + h @ self.p[f"h{way}"]
            gates, g = _sigmoid(z[:, : 3 * self.hidden]), np.tanh(z[:, 3 * self.hidden :])
            i, f, o = np.split(gates, 3, axis=1)
            before, c_before = h, c
            c = f * c + i * g
            s = np.tanh(c)
            h = o * s
            out[:, t] = h
            if keep is not None:
                keep.append((t, before, c_before, i, f, o, g, s))
        return out

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """(windows, characters) numbers -> (windows, characters, tags) scores."""
        x = self.p["embed"][ids]
        h = np.concatenate([self._run("f", x), self._run("b", x)], axis=2)
        return h @ self.p["out"] + self.p["bias"]

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag paths, and its gradients."""
        n, time = ids.shape
        x = self.p["embed"][ids]
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self._run(way, x, kept[way]) for way in "fb"], axis=2)
        scores = (h @ self.p["out"] + self.p["bias"]).astype(np.float64)
        move = self.p["move"].astype(np.float64)
        alpha = np.empty_like(scores)
        beta = np.zeros_like(scores)
        alpha[:, 0] = scores[:, 0]
        for t in range(1, time):
            alpha[:, t] = scores[:, t] + _logsumexp(alpha[:, t - 1, :, None] + move, 1)
        for t in range(time - 2, -1, -1):
            beta[:, t] = _logsumexp(move + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        total = _logsumexp(alpha[:, -1], 1)
        d_scores = np.exp(alpha + beta - total[:, None, None])
        pairs = np.exp(
            alpha[:, :-1, :, None] + move + (scores[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
        ).sum(axis=(0, 1))
        np.subtract.at(pairs, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1.0)
        rows, at = np.arange(n)[:, None], np.arange(time)[None, :]
        path = scores[rows, at, tags].sum(axis=1) + move[tags[:, :-1], tags[:, 1:]].sum(axis=1)
        d_scores[rows, at, tags] -= 1.0
        d_scores = (d_scores / n).astype(np.float32)
        grads = {
            "move": (pairs / n).astype(np.float32),
            "out": h.reshape(-1, 2 * self.hidden).T @ d_scores.reshape(-1, self.n_tags),
            "bias": d_scores.sum(axis=(0, 1)),
        }
        d_h = d_scores @ self.p["out"].T
        d_x = np.zeros_like(x)
        for k, way in enumerate("fb"):
            part = d_h[:, :, k * self.hidden : (k + 1) * self.hidden]
            d_given = np.zeros((n, time, 4 * self.hidden), np.float32)
            back_h = back_c = np.zeros((n, self.hidden), np.float32)
            grads[f"h{way}"] = np.zeros_like(self.p[f"h{way}"])
            for t, before, c_before, i, f, o, g, s in reversed(kept[way]):
                dh = part[:, t] + back_h
                dc = back_c + dh * o * (1 - s * s)
                z = np.concatenate(
                    [dc * g * i * (1 - i), dc * c_before * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)], axis=1
                )
                d_given[:, t] = z
                grads[f"h{way}"] += before.T @ z
                back_h, back_c = z @ self.p[f"h{way}"].T, dc * f
            flat = d_given.reshape(-1, 4 * self.hidden)
            grads[f"x{way}"] = x.reshape(-1, x.shape[2]).T @ flat
            grads[f"b{way}"] = flat.sum(axis=0)
            d_x += d_given @ self.p[f"x{way}"].T
        grads["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(grads["embed"], ids.ravel(), d_x.reshape(-1, x.shape[2]))
        return float((total - path).mean()), grads

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int = 12, batch: int = 48, rate: float = 0.01, seed: int = 0):
        """Adam over shuffled batches; the same input gives the same parameters."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, losses = 0, []
        for epoch in range(epochs):
            order, lost = rng.permutation(len(ids)), 0.0
            for start in range(0, len(ids), batch):
                some = order[start : start + batch]
                loss, grads = self.gradients(ids[some], tags[some])
                lost += loss * len(some)
                step += 1
                for k, g in grads.items():
                    g = np.clip(g, -1.0, 1.0)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                    self.p[k] = (self.p[k] - rate * 0.85**epoch * move).astype(np.float32)
            losses.append(lost / max(1, len(ids)))
        return losses

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tag path of each of (paths, time, tags) padded scores; entries beyond a length mean nothing."""
        n, time, _ = scores.shape
        best, back = scores[:, 0], np.zeros(scores.shape, dtype=np.int8)
        rows = np.arange(n)
        for t in range(1, time):
            through = best[:, :, None] + self.p["move"]
            back[:, t] = through.argmax(axis=1)
            going = (t < lengths)[:, None]
            best = np.where(going, np.take_along_axis(through, back[:, t][:, None, :].astype(np.int64), 1)[:, 0] + scores[:, t], best)
        path = np.zeros((n, time), dtype=np.int64)
        tag = best.argmax(axis=1)
        for t in range(time - 1, -1, -1):
            path[:, t] = tag
            tag = np.where(t < lengths, back[rows, t, tag], tag) if t else tag
        return path
