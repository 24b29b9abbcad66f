"""Mean and variance of every prefix of a history, where each prefix has a smoothing factor of its own.

A prefix of n gaps is folded with alpha = 2 / (n + 1) from its first gap on, so no prefix is a step on from the one before.
But the fold is a weighted mean and variance: gap k weighs alpha * q ** (n - 1 - k) with q = 1 - alpha, and the first one
q ** (n - 1). With lam = -log(q), about 2 / n, and S gaps before a batch, the weight is exp(-lam * (n - 1 - S)) times
exp(lam * S * x) at x = (k - S) / S, where |lam * S * x| <= 2: a series of TERMS powers of x gives it to 2 ** 24 / 24! < 3e-17.
So the sums of x ** p, x ** p * gap and x ** p * gap ** 2 over a history stand for all of it, for any later prefix.

Gaps are taken from a whole number near their mean, from which no prefix's weighted variance is far in proportion, as no
weight is below a quarter of an even one: subtracting the square of the mean loses no more than a few digits.
"""

from __future__ import annotations

import math

import numpy as np

#: Prefixes of so many gaps are folded one by one: exact where sums of halves and quarters are.
FOLDED = 256
TERMS = 24


def refolded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of every prefix by definition, all prefixes side by side: quadratic."""
    alpha = 2.0 / (np.arange(1, len(values) + 1) + 1)
    rest = 1 - alpha
    mean, variance = np.full(len(values), values[0] if len(values) else 0.0), np.zeros(len(values))
    for k in range(1, len(values)):
        variance[k:] = rest[k:] * (variance[k:] + alpha[k:] * (values[k] - mean[k:]) ** 2)
        mean[k:] = rest[k:] * mean[k:] + alpha[k:] * values[k]
    return mean, variance


def _powers(x: np.ndarray) -> np.ndarray:
    return np.vander(x, TERMS, increasing=True).T


_CHOOSE = np.array([[math.comb(p, j) for j in range(TERMS)] for p in range(TERMS)], dtype=np.float64)
_LESS = np.maximum(np.arange(TERMS)[:, None] - np.arange(TERMS)[None, :], 0)


def _moved(r: float, d: float) -> np.ndarray:
    """The matrix that makes sums of (r * x + d) ** p of sums of x ** p; with r + |d| = 1 it lets no error grow."""
    return _CHOOSE * r ** np.arange(TERMS) * d**_LESS


class Prefixes:
    """One history, taken batch by batch; its state is the first FOLDED gaps, then three rows of TERMS sums."""

    def __init__(self) -> None:
        self.size, self.total, self.first, self.near = 0, 0.0, 0.0, 0.0
        self.early = np.empty(0)
        self.sums = np.zeros((3, TERMS))

    def take(self, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and variance of the prefixes that end at each of these gaps, which follow those taken before."""
        parts = []
        while len(gaps):
            if self.size < FOLDED:
                batch, gaps = np.split(gaps, [FOLDED - self.size])
                self.early = np.concatenate([self.early, batch])
                parts.append(tuple(found[self.size :] for found in refolded(self.early)))
                self.size = len(self.early)
                if self.size == FOLDED:
                    self.first, self.size = self.early[0], 0
                    self._keep(self.early)
                    self.early = np.empty(0)
            else:
                # no batch is longer than what came before it
                batch, gaps = np.split(gaps, [self.size])
                parts.append(self._extended(batch))
                self._keep(batch)
        if not parts:
            return np.empty(0), np.empty(0)
        mean, variance = zip(*parts, strict=True)
        return np.concatenate(mean), np.concatenate(variance)

    def _extended(self, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, apart = self.size, batch - self.near
        n = size + np.arange(1.0, len(batch) + 1)
        lam, alpha = np.log1p(2 / (n - 1)), 2 / (n + 1)
        powers = _powers(np.arange(len(batch)) / size)
        scale, oldest = alpha * np.exp(-lam * (n - 1 - size)), (1 - alpha) * np.exp(-lam * (n - 1))

        def weighed(before: np.ndarray, what: np.ndarray, first: float) -> np.ndarray:
            upto = before[:, None] + np.cumsum(powers * what, axis=1)
            value = upto[TERMS - 1]
            for p in range(TERMS - 2, -1, -1):
                value = upto[p] + value * (lam * size / (p + 1))
            return scale * value + oldest * first

        first = self.first - self.near
        mean, square = weighed(self.sums[1], apart, first), weighed(self.sums[2], apart**2, first**2)
        return self.near + mean, np.maximum(square - mean**2, 0.0)

    def _keep(self, batch: np.ndarray) -> None:
        """The sums after this batch, around its end and the mean of all gaps."""
        size = self.size + len(batch)
        self.total += float(batch.sum())
        near = float(np.rint(self.total / size))
        by = near - self.near
        none, one, two = self.sums @ _moved(self.size / size, -len(batch) / size).T if self.size else self.sums
        powers, apart = _powers((np.arange(self.size, size) - size) / size), batch - near
        self.sums = np.stack([none + powers.sum(axis=1), one - by * none + powers @ apart, two - 2 * by * one + by**2 * none + powers @ apart**2])
        self.size, self.near = size, near
