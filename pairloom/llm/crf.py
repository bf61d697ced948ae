"""Linear-chain conditional random fields over arrays of tokens.

Texts of a block lie end to end; `first` marks each text's first token. The recursions run
over columns of the array at once: a column's transfer matrices are multiplied down, the few
column results are chained, and a second pass starts every column from its true vector. That
is exact, and costs a few vector operations a token instead of a Python loop.
"""

from __future__ import annotations

import numpy as np


class Chain:
    """Emission scores (n, S), start (S,), transitions (S, S): row is the state before."""

    def __init__(self, emissions: np.ndarray, first: np.ndarray, start: np.ndarray, transitions: np.ndarray):
        n, s = emissions.shape
        self.n, self.s = n, s
        self.steps = steps = max(1, min(256, int(np.sqrt(n)) or 1))
        self.columns = columns = -(-n // steps)
        pad = steps * columns - n
        self.top = emissions.max(axis=1)
        weight = np.exp(emissions - self.top[:, None])
        self._first = np.concatenate([first, np.ones(pad, bool)]).reshape(columns, steps).T.copy()
        self._weight = np.concatenate([weight, np.ones((pad, s))]).reshape(columns, steps, s).transpose(1, 2, 0).copy()
        self._start, self._trans = np.exp(start), np.exp(transitions)
        self._flat_first = first

    def _step(self, rows: np.ndarray, t: int) -> np.ndarray:
        """Vectors (..., S, columns) before token t to after it."""
        moved = np.stack([sum(rows[..., a, :] * self._trans[a, b] for a in range(self.s)) for b in range(self.s)], axis=-2)
        anew = rows.sum(axis=-2, keepdims=True) * self._start[:, None]
        return np.where(self._first[t], anew, moved) * self._weight[t]

    def _products(self) -> np.ndarray:
        p = np.broadcast_to(np.eye(self.s)[:, :, None], (self.s, self.s, self.columns)).copy()
        for t in range(self.steps):
            p = self._step(p, t)
            if t % 4 == 3:
                p /= p.sum(axis=(0, 1)) + 1e-300
        return p / (p.sum(axis=(0, 1)) + 1e-300)

    def _flat(self, values: np.ndarray) -> np.ndarray:
        """(steps, S, columns) to (n, S)."""
        return values.transpose(2, 0, 1).reshape(-1, self.s)[: self.n]

    def forward(self) -> tuple[np.ndarray, np.ndarray]:
        """Normalised forward vectors (n, S) and each token's share of the log partition."""
        self._p = self._products()
        enter, v = np.empty((self.s, self.columns)), np.full(self.s, 1 / self.s)
        for c in range(self.columns):
            enter[:, c] = v
            v = v @ self._p[:, :, c]
            v = v / (v.sum() + 1e-300)
        alphas, logs = np.empty((self.steps, self.s, self.columns)), np.empty((self.steps, self.columns))
        a = enter
        for t in range(self.steps):
            a = self._step(a, t)
            c = a.sum(axis=0) + 1e-300
            a = a / c
            alphas[t], logs[t] = a, np.log(c)
        return self._flat(alphas), logs.T.ravel()[: self.n] + self.top

    def backward(self) -> np.ndarray:
        """Backward vectors (n, S), scaled at each token; after forward()."""
        leave, v = np.empty((self.s, self.columns)), np.ones(self.s)
        for c in range(self.columns - 1, -1, -1):
            leave[:, c] = v
            v = self._p[:, :, c] @ v
            v = v / (v.sum() + 1e-300)
        betas, b = np.empty((self.steps, self.s, self.columns)), leave
        for t in range(self.steps - 1, -1, -1):
            betas[t] = b
            seen = self._weight[t] * b
            back = np.stack([sum(self._trans[a, k] * seen[k] for k in range(self.s)) for a in range(self.s)])
            b = np.where(self._first[t], 1.0, back)
            b = b / (b.sum(axis=0) + 1e-300)
        return self._flat(betas)

    def expectations(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals (n, S), pair marginals (n, S, S) (zero at first tokens), log partition shares."""
        alpha, logs = self.forward()
        beta = self.backward()
        gamma = alpha * beta
        gamma /= gamma.sum(axis=1, keepdims=True) + 1e-300
        before = np.concatenate([np.zeros((1, self.s)), alpha[:-1]])
        weight = self._flat(self._weight)
        pair = before[:, :, None] * self._trans * (weight * beta)[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True) + 1e-300
        pair[self._flat_first] = 0
        return gamma, pair, logs


def viterbi(emissions: np.ndarray, start: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The best labelling of one text."""
    n, s = emissions.shape
    came = np.zeros((n, s), np.int8)
    score = (start + emissions[0]).tolist()
    trans, rows = transitions.T.tolist(), emissions.tolist()
    for i in range(1, n):
        nxt = []
        for b in range(s):
            best, at = max((score[a] + trans[b][a], -a) for a in range(s))
            came[i, b] = -at
            nxt.append(best + rows[i][b])
        score = nxt
    out = np.empty(n, np.int8)
    out[-1] = int(np.argmax(score))
    for i in range(n - 1, 0, -1):
        out[i - 1] = came[i, out[i]]
    return out


class Adagrad:
    """Steps scaled by each parameter's own past gradients; those that are small against 0.1 move little."""

    def __init__(self, rate: float):
        self.rate, self._sums = rate, {}

    def step(self, name: str, values: np.ndarray, gradient: np.ndarray) -> None:
        total = self._sums.setdefault(name, np.zeros_like(values))
        total += gradient * gradient
        values += self.rate * gradient / (np.sqrt(total) + 0.1)
