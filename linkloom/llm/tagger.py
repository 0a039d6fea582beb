"""A character-level bidirectional LSTM with CRF transitions, in numpy: training and decoding.

Windows are rows of character classes, labelled ``O`` or the first (``B``) or a later (``I``) character
of a span of some kind. Each direction has one LSTM over the classes; their states together give each
label's score at each character, and the CRF adds a score for each pair of labels in a row. Training
maximizes the likelihood of whole label sequences by Adam over shuffled batches from a fixed seed;
decoding takes the best sequence (Viterbi).
"""

from __future__ import annotations

import numpy as np

# --- fixed values: a class per printable character that spans may hold, by groups ---------------
MARKS = "@.-+()[]{}_%/:, \t\n\"'=#|*<>"
# -------------------------------------------------------------------------------------------------
PAD, DIGIT, LOWER, UPPER, WIDE, OTHER = range(6)
AT_WORD = "at do"  # letters of the words that stand for marks have classes of their own
N_CLASSES = 6 + len(MARKS) + len(AT_WORD)


def _class_table() -> np.ndarray:
    table = np.full(128, OTHER, np.int8)
    for c in range(128):
        ch = chr(c)
        if ch.isdigit():
            table[c] = DIGIT
        elif ch in AT_WORD and ch != " ":
            table[c] = 6 + len(MARKS) + AT_WORD.index(ch)
        elif ch.isalpha():
            table[c] = LOWER if ch.islower() else UPPER
        elif ch in MARKS:
            table[c] = 6 + MARKS.index(ch)
    return table


CLASS = _class_table()


def classes(text: str) -> np.ndarray:
    """The class of each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, CLASS[np.minimum(points, 127)], np.int8(WIDE)).astype(np.int8)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lse(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Parameters: per direction a table of gate inputs by class and a recurrent matrix; emissions; transitions."""

    def __init__(self, n_labels: int, hidden: int = 16, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.hidden, self.n_labels = hidden, n_labels
        self.p = {}
        for d in "fb":
            self.p[f"in_{d}"] = rng.normal(0, 0.3, (N_CLASSES, 4 * hidden))
            self.p[f"in_{d}"][:, hidden : 2 * hidden] += 1  # forget gates start open
            self.p[f"re_{d}"] = rng.normal(0, 0.3 / np.sqrt(hidden), (hidden, 4 * hidden))
        self.p["out"] = rng.normal(0, 0.2, (2 * hidden, n_labels))
        self.p["bias"] = np.zeros(n_labels)
        self.p["move"] = np.zeros((n_labels, n_labels))
        self.p["first"] = np.zeros(n_labels)

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """States of one direction, ``(T, N, H)``; with ``keep`` what the backward pass needs."""
        table, re, hidden = self.p[f"in_{d}"], self.p[f"re_{d}"], self.hidden
        n, length = x.shape
        h = c = np.zeros((n, hidden), table.dtype)
        states, kept = np.empty((length, n, hidden), table.dtype), []
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            gates = table[x[:, t]] + h @ re
            gates[:, : 3 * hidden] = _sigmoid(gates[:, : 3 * hidden])
            gates[:, 3 * hidden :] = np.tanh(gates[:, 3 * hidden :])
            before, last = c, h
            c = gates[:, hidden : 2 * hidden] * c + gates[:, :hidden] * gates[:, 3 * hidden :]
            squashed = np.tanh(c)
            h = gates[:, 2 * hidden : 3 * hidden] * squashed
            states[t] = h
            if keep:
                kept.append((t, gates, before, squashed, last))
        return states, kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """``(T, N, labels)`` scores of windows ``x`` (N, T)."""
        both = np.concatenate([self._run(x, d, False)[0] for d in "fb"], axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def best(self, e: np.ndarray) -> np.ndarray:
        """The best label sequence of each window, ``(N, T)``."""
        move, length = self.p["move"], len(e)
        score = e[0] + self.p["first"]
        back = np.empty((length, *score.shape), np.int8)
        for t in range(1, length):
            ways = score[:, :, None] + move
            back[t] = ways.argmax(axis=1)
            score = ways.max(axis=1) + e[t]
        out = np.empty((length, len(score)), np.int8)
        out[-1] = score.argmax(axis=1)
        rows = np.arange(len(score))
        for t in range(length - 1, 0, -1):
            out[t - 1] = back[t][rows, out[t]]
        return out.T

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Label probabilities ``(T, N, labels)``, the sums before and after each place, and the log of all paths' sum."""
        move = self.p["move"]
        before, after = np.empty_like(e), np.zeros_like(e)
        before[0] = e[0] + self.p["first"]
        for t in range(1, len(e)):
            before[t] = _lse(before[t - 1][:, :, None] + move, 1) + e[t]
        for t in range(len(e) - 2, -1, -1):
            after[t] = _lse(move + (e[t + 1] + after[t + 1])[:, None, :], 2)
        total = _lse(before[-1], 1)
        return np.exp(before + after - total[:, None]), before, after, total

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        p, hidden = self.p, self.hidden
        runs = {d: self._run(x, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        e = both @ p["out"] + p["bias"]
        gold, n = y.T, len(x)
        probability, before, after, total = self.marginals(e)
        rows = np.arange(n)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        score = p["first"][gold[0]] + e[0][rows, gold[0]]
        for t in range(1, len(e)):
            score = score + p["move"][gold[t - 1], gold[t]] + e[t][rows, gold[t]]
            pair = before[t - 1][:, :, None] + p["move"] + (e[t] + after[t])[:, None, :] - total[:, None, None]
            g["move"] += np.exp(pair).sum(axis=0)
            np.subtract.at(g["move"], (gold[t - 1], gold[t]), 1)
        de = probability
        de[np.arange(len(e))[:, None], rows, gold] -= 1
        g["first"] = de[0].sum(axis=0)
        g["bias"] = de.sum(axis=(0, 1))
        g["out"] = both.reshape(-1, 2 * hidden).T @ de.reshape(-1, self.n_labels)
        dboth = de @ p["out"].T
        for k, d in enumerate("fb"):
            dstate, dh, dc = dboth[:, :, k * hidden : (k + 1) * hidden], 0, 0
            dgates = np.empty((len(e), n, 4 * hidden))
            for t, gates, c, squashed, last in reversed(runs[d][1]):
                i, f, o, u = (gates[:, j * hidden : (j + 1) * hidden] for j in range(4))
                dh = dh + dstate[t]
                dc = dc + dh * o * (1 - squashed**2)
                dg = np.concatenate([dc * u * i * (1 - i), dc * c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - u**2)], axis=1)
                dgates[t] = dg
                g[f"re_{d}"] += last.T @ dg
                dh, dc = dg @ p[f"re_{d}"].T, dc * f
            onehot = np.zeros((x.size, N_CLASSES))
            onehot[np.arange(x.size), x.T.reshape(-1)] = 1
            g[f"in_{d}"] = onehot.T @ dgates.reshape(-1, 4 * hidden)
        return float((total - score).sum()) / n, {k: v / n for k, v in g.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 64, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam over shuffled batches; returns the loss of each step."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        order, losses = np.empty(0, np.int64), []
        for step in range(1, steps + 1):
            if len(order) < batch:
                order = np.concatenate([order, rng.permutation(len(x))])
            rows, order = order[:batch], order[batch:]
            loss, g = self._gradients(x[rows], y[rows])
            losses.append(loss)
            norm = np.sqrt(sum((a**2).sum() for a in g.values()))
            now = rate * (0.05 + 0.95 * 0.5 * (1 + np.cos(np.pi * step / steps)))
            for k, a in g.items():
                a = a * min(1.0, 20.0 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return losses

    def single(self) -> Tagger:
        """The same model in single precision, for decoding."""
        other = Tagger(self.n_labels, self.hidden)
        other.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        return other
