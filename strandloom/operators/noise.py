"""Noise models on arrays: loss, slope and curvature of observations at latent values."""

from __future__ import annotations

import numpy as np

from strandloom.functions.scalars import DISTRIBUTIONS

THRESHOLDS = (-1.0, 1.0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * z) + 0.5


def noise_terms(kind: str, z: np.ndarray, d: np.ndarray, cuts: tuple = THRESHOLDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elementwise loss, its derivative in z and a curvature; zero where d is missing.

    ``cuts``: the two thresholds of ordinal noise, numbers or one for each column.
    """
    seen = np.isfinite(d)
    d = np.where(seen, d, 0.0)
    if kind == "normal":
        loss, g, h = 0.5 * (z - d) ** 2, z - d, np.ones_like(z)
    elif kind == "bernoulli":
        p = _sigmoid(z)
        loss, g, h = np.logaddexp(0, z) - d * z, p - d, p * (1 - p)
    elif kind == "poisson":
        e = np.exp(np.minimum(z, 30))
        loss, g, h = e - d * z, e - d, e
    elif kind == "bernoulli_sq_hinge":
        s = 2 * d - 1
        m = np.maximum(1 - s * z, 0)
        loss, g, h = 0.5 * m * m, -s * m, (m > 0) * s * s
    elif kind == "ordinal3":
        low, high = (np.broadcast_to(c, z.shape) for c in cuts)
        level = np.clip(np.where(seen, d, 1), 1, 3)
        a = np.where(level == 1, 0.0, _sigmoid(np.where(level == 2, low, high) - z))
        b = np.where(level == 3, 1.0, _sigmoid(np.where(level == 1, low, high) - z))
        loss, g, h = -np.log(np.maximum(b - a, 1e-12)), 1 - a - b, a * (1 - a) + b * (1 - b)
    elif kind == "ordinal_sq_hinge3":
        loss, g, h = np.zeros_like(z), np.zeros_like(z), np.zeros_like(z)
        for i, t in enumerate(cuts):
            s = np.where(d > i + 1, 1.0, -1.0)
            m = np.maximum(1 - s * (z - t), 0)
            loss, g, h = loss + 0.5 * m * m, g - s * m, h + (m > 0)
    else:
        raise ValueError(f"unknown distribution {kind!r}; known: {DISTRIBUTIONS}")
    return loss * seen, g * seen, np.maximum(h, 1e-6) * seen


def column_estimates(kind: str, levels: np.ndarray, cuts: tuple[np.ndarray, np.ndarray], rounds: int = 60) -> np.ndarray:
    """The best shift of each column alone, by Newton steps on the counts of its levels (rows: columns)."""
    mu = np.zeros(len(levels))
    values = [0.0, 0.0, 1.0] if kind == "bernoulli_sq_hinge" else [1.0, 2.0, 3.0]
    for _ in range(rounds):
        g, h = np.zeros(len(levels)), np.full(len(levels), 1e-9)
        for i, v in enumerate(values):
            _, slope, bend = noise_terms(kind, mu, np.full(len(levels), v), cuts)
            g, h = g + levels[:, i] * slope, h + levels[:, i] * bend
        step = np.clip(g / h, -1, 1)
        mu = np.clip(mu - step, -10, 10)
        if np.abs(step).max(initial=0) < 1e-9:
            break
    return mu
