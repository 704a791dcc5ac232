"""A convolutional network over bytes, in numpy.

A text is a sequence of bytes, cut into chunks of ``CHUNK`` bytes that overlap,
so that the filters, which go on by ``STEP`` bytes, see the whole text as if it
had not been cut.  A byte that is in the midst of a string that goes on repeating
itself has a symbol of its own beside the plain one.

A filter's largest answer in a chunk is the chunk's feature.  Features are
combined over all chunks twice, as their mean and as their largest, and one
layer makes a probability of them.
"""

from __future__ import annotations

import numpy as np

CHUNK, WIDTH, STEP = 512, 10, 2
PLACES = (CHUNK - WIDTH) // STEP + 1
STRIDE = PLACES * STEP
#: Symbols: bytes, bytes in a repetition, and what fills a last chunk.
PAD = 512
SYMBOLS = PAD + 1
#: Periods of repetitions that are seen, and for how many bytes they have to go on.
PERIODS = range(2, 33)
LASTING = 24
#: Chunks that are answered at once.
BATCH = 64
#: Bytes whose symbols are made at once.
BLOCK = 1 << 16


def _repeating(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Which bytes lie in ``LASTING`` bytes that equal those one period before.

    ``begins``: where texts begin; nothing goes on from one to the next.
    """
    out = np.zeros(len(data), bool)
    for period in PERIODS:
        same = data[period:] == data[:-period]
        if len(same) < LASTING:
            break
        if len(begins):
            other = (begins[:, None] - period + np.arange(period)).ravel()
            same[other[(other >= 0) & (other < len(same))]] = False
        # runs of equal bytes by doubling: 2, 4, 8, then 24
        run = same[1:] & same[:-1]
        run = run[2:] & run[:-2]
        run = run[4:] & run[:-4]
        if run.any():
            lasting = np.pad(run[16:] & run[8:-8] & run[:-16], (0, LASTING - 1))
            for by in (1, 2, 4, 8, 8):  # from where they begin to all of their bytes
                lasting[by:] |= lasting[:-by].copy()
            out[period:] |= lasting
    return out


def symbols_of(texts: list[bytes]) -> list[np.ndarray]:
    """The symbols of each whole text; texts are read together, block by block."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begins = ends[:-1]
    out = data.astype(np.uint16)
    around = PERIODS[-1] + LASTING
    for start in range(0, len(data), BLOCK):
        first, last = max(0, start - around), start + BLOCK + around
        near = begins[np.searchsorted(begins, first) : np.searchsorted(begins, last)] - first
        found = _repeating(data[first:last], near)[start - first :][:BLOCK]
        out[start : start + len(found)] += found * np.uint16(256)
    return np.split(out, begins)


def chunks_in(n: int) -> int:
    """Chunks of a text of ``n`` bytes."""
    return max(1, -(-(n - CHUNK) // STRIDE) + 1) if n else 0


def chunks_of(symbols: np.ndarray) -> np.ndarray:
    """Rows of ``CHUNK`` symbols that overlap; the last is filled up."""
    n = chunks_in(len(symbols))
    rest = n and (n - 1) * STRIDE + CHUNK - len(symbols)
    whole = np.concatenate([symbols, np.full(rest, PAD, symbols.dtype)])
    return np.lib.stride_tricks.sliding_window_view(whole, CHUNK)[::STRIDE] if n else whole.reshape(0, CHUNK)


class ByteCNN:
    """Weights: embedding, filters (place, embedding, filter), bias, last layer."""

    def __init__(self, filters: int = 16, embed: int = 8, seed: int = 12):
        rng = np.random.default_rng(seed)
        new = lambda *shape, by: (rng.standard_normal(shape) / np.sqrt(by)).astype(np.float32)
        self.filters = filters
        embedding = new(SYMBOLS, embed, by=1)
        embedding[256:PAD] = embedding[:256] + new(1, embed, by=1)
        self.w: dict[str, np.ndarray] = {"embed": embedding, "conv": new(WIDTH, embed, filters, by=WIDTH * embed), "bias": np.zeros(filters, np.float32), "out": new(2 * filters, by=2 * filters), "out_b": np.zeros(1, np.float32)}

    def answers(self, x: np.ndarray, at: bool = False):
        """The largest answer of each filter in each chunk, and where it is."""
        table = np.einsum("se,pef->psf", self.w["embed"], self.w["conv"])
        top, where = np.empty((len(x), self.filters), np.float32), np.empty((len(x), self.filters), np.int64)
        part = np.empty((min(len(x), BATCH), PLACES, self.filters), np.float32)
        for k in range(0, len(x), BATCH):
            z, rows = None, x[k : k + BATCH].astype(np.intp)
            for p in range(WIDTH):
                one = np.take(table[p], rows[:, p : p + STRIDE : STEP], axis=0, out=part[: len(rows)] if p else None, mode="clip")
                z = one if z is None else np.add(z, one, out=z)
            if at:
                where[k : k + BATCH] = STEP * z.argmax(axis=1)
            top[k : k + BATCH] = z.max(axis=1)
        top = top + self.w["bias"]
        return (top, where) if at else top

    def _probability(self, mean: np.ndarray, most: np.ndarray) -> np.ndarray:
        z = np.concatenate([mean, most], axis=1) @ self.w["out"] + self.w["out_b"]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of each whole text."""
        if not texts:
            return np.zeros(0)
        most: list[np.ndarray] = []
        waiting: list[np.ndarray] = []
        owners: list[int] = []
        sums: list[np.ndarray] = []

        def answer() -> None:
            if waiting:
                f = np.maximum(self.answers(np.concatenate(waiting)), 0)
                at = 0
                for part, owner in zip(waiting, owners):
                    own = f[at : at + len(part)]
                    sums[owner] += own.sum(axis=0)
                    most[owner] = np.maximum(most[owner], own.max(axis=0))
                    at += len(part)
                waiting.clear()
                owners.clear()

        counts = []
        for k, symbols in enumerate(symbols_of(texts)):
            sums.append(np.zeros(self.filters))
            most.append(np.zeros(self.filters, np.float32))
            rows = chunks_of(symbols)
            counts.append(max(1, len(rows)))
            for start in range(0, len(rows), BATCH):
                waiting.append(rows[start : start + BATCH])
                owners.append(k)
                if sum(map(len, waiting)) >= BATCH:
                    answer()
        answer()
        mean = np.stack(sums) / np.array(counts)[:, None]
        return self._probability(mean, np.stack(most)).astype(float)

    def _loss(self, x: np.ndarray, doc: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss of documents and its gradients; ``doc`` numbers the chunks' documents in order."""
        top, where = self.answers(x, at=True)
        f = np.maximum(top, 0)
        starts = np.searchsorted(doc, np.arange(len(y)))
        counts = np.bincount(doc, minlength=len(y))[:, None].astype(np.float32)
        mean, most = np.add.reduceat(f, starts) / counts, np.maximum.reduceat(f, starts)
        p = self._probability(mean, most)
        loss = -np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))
        dz = ((p - y) / len(y)).astype(np.float32)
        g = {"out": np.concatenate([mean, most], axis=1).T @ dz, "out_b": dz.sum(keepdims=True)}
        dmean, dmost = dz[:, None] * self.w["out"][: self.filters], dz[:, None] * self.w["out"][self.filters :]
        df = (dmean / counts)[doc] + dmost[doc] * (f == most[doc])
        df = np.where(top > 0, df, 0)
        g["bias"] = df.sum(axis=0)
        # only the place of a filter's largest answer in a chunk has a say
        seen = x[np.arange(len(x))[:, None, None], where[:, :, None] + np.arange(WIDTH)]
        g["conv"] = np.einsum("cf,cfpe->pef", df, self.w["embed"][seen], optimize=True)
        back = np.einsum("cf,pef->cfpe", df, self.w["conv"], optimize=True)
        g["embed"] = np.zeros_like(self.w["embed"])
        np.add.at(g["embed"], seen.ravel(), back.reshape(-1, back.shape[-1]))
        return float(loss), g

    def train(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 13) -> list[float]:
        """Adam over shuffled documents, each an array of chunks; the mean loss of each epoch."""
        rng, step, losses = np.random.default_rng(seed), 0, []
        m, v = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2))
        self.w["out_b"][:] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        for epoch in range(epochs):
            order, sums = rng.permutation(len(docs)), []
            for k in range(0, len(order), batch):
                now = order[k : k + batch]
                doc = np.repeat(np.arange(len(now)), [len(docs[i]) for i in now])
                value, grads = self._loss(np.concatenate([docs[i] for i in now]), doc, y[now])
                sums.append(value)
                step += 1
                for name, q in grads.items():
                    m[name] += 0.1 * (q - m[name])
                    v[name] += 0.01 * (q * q - v[name])
                    self.w[name] -= (rate / (1 + epoch / 4) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            losses.append(float(np.mean(sums)))
        return losses
