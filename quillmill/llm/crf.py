"""A linear-chain conditional random field over sparse binary features, in NumPy."""

from __future__ import annotations

from itertools import chain

import numpy as np


class ChainCRF:
    """States score by summed feature weights and by the transition from the state before."""

    def __init__(self, features: int, labels: int, scale: np.ndarray | None = None):
        self.scale = (np.ones(features) if scale is None else scale)[:, None]  # how loud a feature is, fixed beforehand
        self.emit = np.zeros((features, labels))
        self.move = np.zeros((labels, labels))
        self.ready: np.ndarray | None = None

    def scores(self, seq: list[list[int]]) -> np.ndarray:
        table = self.emit * self.scale if self.ready is None else self.ready
        sizes = np.fromiter(map(len, seq), np.intp, len(seq))  # every state has a feature that is always on
        on = np.fromiter(chain.from_iterable(seq), np.intp, int(sizes.sum()))
        return np.add.reduceat(table.take(on, axis=0), np.cumsum(sizes) - sizes, axis=0)

    @staticmethod
    def _lse(x: np.ndarray, axis: int) -> np.ndarray:
        m = x.max(axis=axis, keepdims=True)
        return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))

    def marginals(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State marginals and summed transition marginals, by the forward-backward recursion."""
        n, k = s.shape
        fwd, bwd = np.empty((n, k)), np.zeros((n, k))
        fwd[0] = s[0]
        for t in range(1, n):
            fwd[t] = s[t] + self._lse(fwd[t - 1][:, None] + self.move, 0)
        for t in range(n - 2, -1, -1):
            bwd[t] = self._lse(self.move + (s[t + 1] + bwd[t + 1])[None, :], 1)
        z = self._lse(fwd[-1], 0)
        pairs = np.zeros((k, k))
        for t in range(1, n):
            pairs += np.exp(fwd[t - 1][:, None] + self.move + (s[t] + bwd[t])[None, :] - z)
        return np.exp(fwd + bwd - z), pairs

    def fit(self, seqs: list[list[list[int]]], golds: list[list[int]], epochs: int = 4, rate: float = 0.3, decay: float = 1e-5, seed: int = 1) -> ChainCRF:
        """AdaGrad on the conditional likelihood."""
        rng = np.random.default_rng(seed)
        g_emit, g_move = np.full(self.emit.shape, 1e-6), np.full(self.move.shape, 1e-6)
        for _ in range(epochs):
            for i in rng.permutation(len(seqs)):
                seq, gold = seqs[i], golds[i]
                p, pairs = self.marginals(np.stack([(self.emit[f] * self.scale[f]).sum(axis=0) for f in seq]))
                for t, f in enumerate(seq):
                    d = -p[t]
                    d[gold[t]] += 1
                    f = np.asarray(f)
                    step = d[None, :] * self.scale[f] - decay * self.emit[f]
                    g_emit[f] += step**2
                    self.emit[f] += rate * step / np.sqrt(g_emit[f])
                d = -pairs
                for a, b in zip(gold, gold[1:]):
                    d[a, b] += 1
                g_move += d**2
                self.move += rate * d / np.sqrt(g_move)
        self.ready = self.emit * self.scale
        return self

    def decode(self, seq: list[list[int]]) -> list[int]:
        """The best sequence of states (Viterbi)."""
        return self.decode_all([seq])[0]

    def decode_all(self, seqs: list[list[list[int]]]) -> list[list[int]]:
        """The best states of each sequence, all sequences taken a step at a time."""
        sizes = np.fromiter(map(len, seqs), np.intp, len(seqs))
        if not sizes.sum():
            return [[] for _ in seqs]
        s = self.scores(list(chain.from_iterable(seqs)))
        ends = np.cumsum(sizes)
        order = np.argsort(-sizes, kind="stable")
        starts = (ends - sizes)[order]
        longer = [int((sizes > t).sum()) for t in range(sizes.max())]  # the first so many in order have a state t
        best, back = s[starts[: longer[0]]], np.zeros(s.shape, dtype=np.intp)
        last = np.zeros(len(s), dtype=np.intp)
        for t, n in enumerate(longer):
            if t:
                m = best[:n, :, None] + self.move
                back[starts[:n] + t] = m.argmax(axis=1)
                best[:n] = m.max(axis=1) + s[starts[:n] + t]
            over = slice(longer[t + 1] if t + 1 < len(longer) else 0, n)
            last[starts[over] + t] = best[over].argmax(axis=1)
        for t in range(len(longer) - 1, 0, -1):
            at = starts[: longer[t]] + t
            last[at - 1] = back[at, last[at]]
        tags = last.tolist()
        return [tags[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
