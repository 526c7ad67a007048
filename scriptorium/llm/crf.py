"""A linear-chain conditional random field over sparse features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Sequences:
    """Position p of all sequences, laid end to end, has the features ``ids[ptr[p]:ptr[p + 1]]``, one at least; sequence s has the positions
    ``bounds[s]:bounds[s + 1]``, one at least."""

    ids: np.ndarray
    ptr: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def take(self, chosen: np.ndarray) -> tuple[Sequences, np.ndarray]:
        """The chosen sequences, and the numbers of their positions."""
        lengths = np.diff(self.bounds)[chosen]
        positions = _ranges(self.bounds[chosen], lengths)
        sizes = np.diff(self.ptr)[positions]
        return Sequences(self.ids[_ranges(self.ptr[positions], sizes)], _bounds(sizes), _bounds(lengths)), positions


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    return np.repeat(starts - _bounds(sizes)[:-1], sizes) + np.arange(sizes.sum())


@dataclass
class ChainCRF:
    """``weights`` features x labels, ``moves`` labels x labels."""

    weights: np.ndarray
    moves: np.ndarray

    @staticmethod
    def empty(features: int, labels: int) -> ChainCRF:
        return ChainCRF(np.zeros((features, labels)), np.zeros((labels, labels)))

    def _padded(self, rows: Sequences, barred: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores as sequences x positions x labels, and which positions exist."""
        flat = np.add.reduceat(self.weights[rows.ids], rows.ptr[:-1], axis=0)
        if barred is not None:
            flat = np.where(barred, -1e3, flat)
        lengths = np.diff(rows.bounds)
        mask = np.arange(lengths.max()) < lengths[:, None]
        unary = np.zeros((*mask.shape, flat.shape[1]))
        unary[mask] = flat
        return unary, mask

    def marginals(self, unary: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities, and expected moves summed over all sequences."""
        n, length, labels = unary.shape
        alpha, beta = np.zeros_like(unary), np.zeros_like(unary)
        alpha[:, 0] = unary[:, 0]
        for t in range(1, length):
            step = _logsum(alpha[:, t - 1, :, None] + self.moves, 1) + unary[:, t]
            alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            step = _logsum(self.moves + (unary[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], step, 0)
        total = _logsum(alpha[:, -1], 1)
        single = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
        pair = np.zeros((labels, labels))
        for t in range(1, length):
            p = np.exp(alpha[:, t - 1, :, None] + self.moves + (unary[:, t] + beta[:, t])[:, None, :] - total[:, None, None])
            pair += (p * mask[:, t, None, None]).sum(axis=0)
        return single, pair

    def label(self, rows: Sequences, barred: np.ndarray, batch: int = 512) -> np.ndarray:
        """The most probable label of each position; ``barred`` (positions x labels) are ruled out."""
        out = np.zeros(len(rows.ptr) - 1, np.int64)
        order = np.argsort(np.diff(rows.bounds), kind="stable")  # sequences of like length share a batch, so little is padded
        for at in range(0, len(order), batch):
            part, positions = rows.take(order[at : at + batch])
            unary, mask = self._padded(part, barred[positions])
            out[positions] = self.marginals(unary, mask)[0].argmax(axis=-1)[mask]
        return out

    def fit(self, rows: Sequences, labels: np.ndarray, epochs: int, rate: float = 0.05, decay: float = 1e-5, batch: int = 64, seed: int = 0) -> ChainCRF:
        """Maximise the likelihood of ``labels`` (of all positions) by Adam."""
        rng = np.random.default_rng(seed)
        state = [np.zeros_like(x) for x in (self.weights, self.weights, self.moves, self.moves)]
        lengths = np.diff(rows.bounds)
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            order = order[np.argsort(lengths[order], kind="stable")]
            for at in rng.permutation(range(0, len(order), batch)):
                part, positions = rows.take(order[at : at + batch])
                unary, mask = self._padded(part)
                single, pair = self.marginals(unary, mask)
                gold = labels[positions]
                delta = single[mask]
                delta[np.arange(len(gold)), gold] -= 1
                counts = np.diff(part.ptr)
                grad = np.stack([np.bincount(part.ids, np.repeat(delta[:, k], counts), len(self.weights)) for k in range(delta.shape[1])], axis=1)
                inner = np.ones(len(gold), bool)
                inner[part.bounds[:-1]] = False
                np.subtract.at(pair, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
                step += 1
                n = len(part)
                for value, g, k in ((self.weights, grad / n + decay * self.weights, 0), (self.moves, pair / n, 2)):
                    state[k] = 0.9 * state[k] + 0.1 * g
                    state[k + 1] = 0.99 * state[k + 1] + 0.01 * g * g
                    value -= rate * (state[k] / (1 - 0.9**step)) / (np.sqrt(state[k + 1] / (1 - 0.99**step)) + 1e-8)
        return self
