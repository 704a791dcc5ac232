"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Windows of equal length are batched.  The input weights are folded into a table
by character, so a step costs one small product for each direction.
"""

from __future__ import annotations

import numpy as np

#: Characters that have a symbol of their own; digits, letters, marks.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz@.+-()_%:/#,;=\"'<>[]{}|&*!? \n\t"
UPPER, OTHER, PAD = len(ALPHABET), len(ALPHABET) + 1, len(ALPHABET) + 2
SYMBOLS = PAD + 1

_TABLE = np.full(0x180, OTHER, dtype=np.int64)
for _k, _c in enumerate(ALPHABET):
    _TABLE[ord(_c)] = _k
_TABLE[ord("A") : ord("Z") + 1] = UPPER


def symbols_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return _TABLE[np.minimum(codes, 0x17F)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Weights: embedding, two LSTMs (f, b), output layer, transitions."""

    def __init__(self, tags: int, hidden: int = 24, embed: int = 12, seed: int = 8):
        rng = np.random.default_rng(seed)
        new = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.tags, self.hidden = tags, hidden
        self.w: dict[str, np.ndarray] = {"embed": new(SYMBOLS, embed) * 2, "out": new(2 * hidden, tags), "out_b": np.zeros(tags, np.float32), "trans": np.zeros((tags, tags), np.float32), "start": np.zeros(tags, np.float32)}
        for d in "fb":
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1  # remember at first
            self.w |= {f"x{d}": new(embed, 4 * hidden), f"h{d}": new(hidden, 4 * hidden), f"c{d}": bias}

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """States over time of one direction; x is (time, batch)."""
        n, h = self.hidden, np.zeros((x.shape[1], self.hidden), np.float32)
        c = h.copy()
        table = self.w["embed"] @ self.w[f"x{d}"] + self.w[f"c{d}"]
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        out, tape = np.empty((*x.shape, n), np.float32), []
        for t in steps:
            z = table[x[t]] + h @ self.w[f"h{d}"]
            gates = _sigmoid(z[:, : 3 * n])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            g = np.tanh(z[:, 3 * n :])
            before, last = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                tape.append((t, i, f, o, g, before, last, tc))
        return out, tape

    def emissions(self, x: np.ndarray, keep: bool = False):
        """Tag scores (time, batch, tags) of symbols (batch, time)."""
        xt = np.ascontiguousarray(x.T)
        f, tf = self._run(xt, "f", keep)
        b, tb = self._run(xt, "b", keep)
        both = np.concatenate([f, b], axis=2)
        e = both @ self.w["out"] + self.w["out_b"]
        return (e, (xt, both, tf, tb)) if keep else e

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """The best tags of one sequence of emissions (time, tags)."""
        score, back = self.w["start"] + e[0], np.empty((len(e), self.tags), np.int32)
        for t in range(1, len(e)):
            s = score[:, None] + self.w["trans"]
            back[t] = s.argmax(axis=0)
            score = s[back[t], np.arange(self.tags)] + e[t]
        best = np.empty(len(e), np.int64)
        best[-1] = score.argmax()
        for t in range(len(e) - 1, 0, -1):
            best[t - 1] = back[t][best[t]]
        return best

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags y, and its gradients."""
        e, (xt, both, tf, tb) = self.emissions(x, keep=True)
        yt, (time, batch) = y.T, xt.shape
        trans, rows = self.w["trans"], np.arange(batch)
        alpha = np.empty_like(e)
        alpha[0] = self.w["start"] + e[0]
        for t in range(1, time):
            alpha[t] = _logsum(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        beta = np.zeros_like(e)
        for t in range(time - 2, -1, -1):
            beta[t] = _logsum(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = _logsum(alpha[-1], 1)
        de = np.exp(alpha + beta - total[:, None])
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        gold = self.w["start"][yt[0]] + e[0][rows, yt[0]]
        g["start"] = de[0].sum(axis=0)
        np.add.at(g["start"], yt[0], -1)
        for t in range(1, time):
            pair = alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - total[:, None, None]
            g["trans"] += np.exp(pair).sum(axis=0)
            np.add.at(g["trans"], (yt[t - 1], yt[t]), -1)
            gold = gold + trans[yt[t - 1], yt[t]] + e[t][rows, yt[t]]
        de[np.arange(time)[:, None], rows[None, :], yt] -= 1
        flat = de.reshape(-1, self.tags)
        g["out"] = both.reshape(-1, both.shape[2]).T @ flat
        g["out_b"] = flat.sum(axis=0)
        dboth = de @ self.w["out"].T
        n = self.hidden
        for d, tape, dh_out in (("f", tf, dboth[:, :, :n]), ("b", tb, dboth[:, :, n:])):
            dh, dc = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
            dtable = np.zeros((SYMBOLS, 4 * n), np.float32)
            for t, i, f, o, gg, before, last, tc in reversed(tape):
                dh = dh + dh_out[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                g[f"h{d}"] += last.T @ dz
                np.add.at(dtable, xt[t], dz)
                dh, dc = dz @ self.w[f"h{d}"].T, dc * f
            g[f"x{d}"] += self.w["embed"].T @ dtable
            g[f"c{d}"] += dtable.sum(axis=0)
            g["embed"] += dtable @ self.w[f"x{d}"].T
        return float((total - gold).mean()), {k: v / batch for k, v in g.items()}

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 48, rate: float = 0.012, seed: int = 9) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        rng, step, losses = np.random.default_rng(seed), 0, []
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(w) for k, w in self.w.items()}
        for epoch in range(epochs):
            order, sums = rng.permutation(len(x)), []
            for k in range(0, len(x), batch):
                now = order[k : k + batch]
                value, grads = self.loss(x[now], y[now])
                sums.append(value)
                step += 1
                norm = np.sqrt(sum(float((q * q).sum()) for q in grads.values()))
                for name, q in grads.items():
                    q = q * min(1.0, 5 / (norm + 1e-6))
                    m[name] += 0.1 * (q - m[name])
                    v[name] += 0.01 * (q * q - v[name])
                    self.w[name] -= (rate / (1 + epoch / 3) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            losses.append(float(np.mean(sums)))
        return losses
