"""Small gradient-boosted trees, trained on the driver from generated examples and written out as a SQL expression."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

Tree = tuple  # (feature, cut, below, above), or a number for a leaf


def _fit(rows: Sequence[Sequence[float]], grad: list[float], hess: list[float], members: list[int], depth: int, cuts: list[list[float]]) -> Tree | float:
    g, h = sum(grad[i] for i in members), sum(hess[i] for i in members)
    best = (1e-6, None)
    if depth:
        for f, values in enumerate(cuts):
            for cut in values:
                gl = hl = 0.0
                for i in members:
                    if rows[i][f] <= cut:
                        gl += grad[i]
                        hl += hess[i]
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if gain > best[0]:
                    best = (gain, (f, cut))
    if best[1] is None:
        return round(0.5 * g / (h + 1), 6)
    f, cut = best[1]
    return (f, cut, _fit(rows, grad, hess, [i for i in members if rows[i][f] <= cut], depth - 1, cuts), _fit(rows, grad, hess, [i for i in members if rows[i][f] > cut], depth - 1, cuts))


def boost(rows: Sequence[Sequence[float]], good: Sequence[bool], trees: int = 12, depth: int = 2) -> list[Tree]:
    """Trees for the logistic loss; the score is the sum of their leaves."""
    cuts = []
    for f in range(len(rows[0])):
        values = sorted({r[f] for r in rows})
        cuts.append([(a + b) / 2 for a, b in zip(values, values[1:], strict=False)][:: max(1, len(values) // 8)])
    score, out = [0.0] * len(rows), []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-s)) for s in score]
        tree = _fit(rows, [float(y) - q for y, q in zip(good, p, strict=True)], [q * (1 - q) for q in p], list(range(len(rows))), depth, cuts)
        out.append(tree)
        score = [s + leaf(tree, r) for s, r in zip(score, rows, strict=True)]
    return out


def leaf(tree: Tree | float, row: Sequence[float]) -> float:
    while isinstance(tree, tuple):
        f, cut, below, above = tree
        tree = below if row[f] <= cut else above
    return tree


def as_expression(trees: Sequence[Tree], feature: Callable[[int], object], when: Callable, number: Callable) -> object:
    """The score as nested conditions over feature(i)."""

    def node(tree: Tree | float) -> object:
        if not isinstance(tree, tuple):
            return number(float(tree))
        f, cut, below, above = tree
        return when(feature(f) <= number(float(cut)), node(below)).otherwise(node(above))

    total = node(trees[0])
    for tree in trees[1:]:
        total = total + node(tree)
    return total
