"""Optimisers on driver arrays and row-parallel least squares.

Parameters of K x N size live in numpy on the driver; gradients come from one
job per step, or from closed forms.  Row problems are independent and run on
the executors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class AdaGrad:
    """p -= rate g / (sqrt(sum g^2) + eps), in place."""

    def __init__(self, rate: float = 1.0, eps: float = 1e-8) -> None:
        self.rate, self.eps, self.seen = rate, eps, {}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        for k, g in grads.items():
            acc = self.seen.setdefault(k, np.zeros_like(g))
            acc += g * g
            params[k] -= self.rate * g / (np.sqrt(acc) + self.eps)


def ista_nonnegative(p: np.ndarray, g: np.ndarray, ssq: np.ndarray, lam: np.ndarray, rate: float = 1.0) -> np.ndarray:
    """One proximal AdaGrad step on p >= 0 with an L1 penalty; ``ssq`` is updated."""
    ssq += g * g
    eta = rate / np.sqrt(ssq)
    return np.maximum(np.maximum(p - eta * g, 0) - lam * eta, 0)


def with_halving(run: Callable[[float, int], dict], rate: float = 1.0, least: float = 0.01) -> dict:
    """Call run(rate, first epoch); halve the rate and resume while the loss rises, down to ``least``."""
    epoch = 0
    while True:
        h = run(rate, epoch)
        epoch = h.get("epochs", epoch)
        if h.get("term_code") != "loss_increase" or rate / 2 < least:
            return h | {"rate": rate}
        rate /= 2


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, memory: int = 10, rounds: int = 200, rel_tol: float = 1e-9, abs_tol: float = 1e-12) -> tuple[np.ndarray, list[float]]:
    """Limited-memory BFGS with backtracking; f gives value and gradient."""
    fx, g = f(x)
    s_y: list[tuple[np.ndarray, np.ndarray]] = []
    losses = [fx]
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y in reversed(s_y):
            a = s @ q / (s @ y)
            alphas.append(a)
            q -= a * y
        if s_y:
            s, y = s_y[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(s_y, reversed(alphas), strict=True):
            q += (a - y @ q / (s @ y)) * s
        d, slope = -q, -(g @ q)
        if slope >= 0:
            s_y, d, slope = [], -g, -(g @ g)
        if slope == 0:
            break
        step = 1.0 if s_y else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12))
        while True:
            new = x + step * d
            fn, gn = f(new)
            if fn <= fx + 1e-4 * step * slope or step < 1e-20:
                break
            step *= 0.8
        s, y = new - x, gn - g
        s_y = [*s_y[-memory + 1 :], (s, y)] if s @ y > 1e-4 * (y @ y) * 1e-8 else []
        done = abs(fx - fn) < abs_tol or abs(fx - fn) < rel_tol * abs(fx)
        x, fx, g = new, fn, gn
        losses.append(fx)
        if done:
            break
    return x, losses


def masked_least_squares(z: np.ndarray, y: np.ndarray, ridge: np.ndarray | float = 0.0, weight: np.ndarray | None = None) -> np.ndarray:
    """Rows x minimising sum_j w_j (x.y_j - z_j)^2 + ridge |x|^2 over the finite z_j of each row.

    z: rows x features, y: K x features.  A row without values gets zeros.
    """
    k, n = y.shape
    mask = np.isfinite(z)
    w = mask * (1.0 if weight is None else weight)
    pairs = (y[:, None, :] * y[None, :, :]).reshape(k * k, n).T
    a = (w @ pairs).reshape(-1, k, k) + np.eye(k) * (np.asarray(ridge) + 1e-10)
    b = (w * np.where(mask, z, 0.0)) @ y.T
    return np.linalg.solve(a, b[..., None])[..., 0]


def bisect_monotone(f: Callable[[float], float], target: float, start: float = 1.0, x_tol: float = 1e-9, y_tol: float = 1e-9, rounds: int = 200) -> float:
    """x > 0 with f(x) = target for an increasing f: double or halve to a bracket, then bisect."""
    low = high = start
    while f(high) < target and rounds:
        low, high, rounds = high, high * 2, rounds - 1
    while f(low) > target and rounds:
        low, high, rounds = low / 2, low, rounds - 1
    while high - low > x_tol and rounds:
        mid, rounds = (low + high) / 2, rounds - 1
        y = f(mid)
        if abs(y - target) <= y_tol:
            return mid
        low, high = (mid, high) if y < target else (low, mid)
    return (low + high) / 2
