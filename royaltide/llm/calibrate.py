"""Isotonic calibration: pooled adjacent violators over weighted points."""

from __future__ import annotations

import numpy as np


def isotonic(x, y, weight) -> tuple[np.ndarray, np.ndarray]:
    """Knots ``(score, probability)`` of the monotone fit with least squared error."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for i in order:
        blocks.append([float(x[i]), float(x[i]), float(y[i]), float(weight[i])])
        while len(blocks) > 1 and (blocks[-2][2] >= blocks[-1][2] or blocks[-2][1] == blocks[-1][0]):
            low, high = blocks[-2], blocks.pop()
            total = low[3] + high[3]
            blocks[-1] = [low[0], high[1], (low[2] * low[3] + high[2] * high[3]) / total, total]
    if not blocks:
        return np.array([0.0, 1.0]), np.array([0.0, 0.0])
    return (np.array([v for b in blocks for v in b[:2]]), np.array([b[2] for b in blocks for _ in (0, 1)]))


def apply(knots: tuple[np.ndarray, np.ndarray], x) -> np.ndarray:
    return np.clip(np.interp(x, *knots), 0.0, 1.0)
