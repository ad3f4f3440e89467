"""Logistic regression on hashed features, fitted from rows on the driver or from sums over rows that lie elsewhere."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable

import numpy as np


def hashed(features: Iterable[str], dims: int) -> list[int]:
    """The distinct places of features in a weight vector, in order; place 0 is the intercept."""
    return [0, *sorted({1 + zlib.crc32(f.encode()) % (dims - 1) for f in features})]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def flat(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Where each row begins in the places of all rows, and these."""
    sizes = np.fromiter((len(r) for r in rows), dtype=np.int64, count=len(rows))
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), np.concatenate([np.asarray(r, dtype=np.int64) for r in rows])


def scores(rows: list, w: np.ndarray) -> np.ndarray:
    """Log-odds of rows (lists of places, none empty)."""
    if not len(rows):
        return np.zeros(0)
    starts, at = flat(rows)
    return np.add.reduceat(w[at], starts)


def fit(rows: list, target: np.ndarray, weight: np.ndarray, dims: int, steps: int = 150, rate: float = 0.15, ridge: float = 1e-4) -> np.ndarray:
    """Weights that bring the rows' probabilities near their targets (0 to 1), each row as heavy as its weight (Adam on all rows)."""
    w = np.zeros(dims)
    if not len(rows):
        return w
    starts, at = flat(rows)
    sizes = np.diff(np.append(starts, len(at)))
    weight = weight / weight.sum()
    m, v = np.zeros(dims), np.zeros(dims)
    for t in range(1, steps + 1):
        g = weight * (sigmoid(np.add.reduceat(w[at], starts)) - target)
        grad = np.bincount(at, weights=np.repeat(g, sizes), minlength=dims) + ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def loss_part(starts: np.ndarray, at: np.ndarray, target: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Some rows' part of the loss and, after it, of its gradient."""
    z = np.add.reduceat(w[at], starts)
    sizes = np.diff(np.append(starts, len(at)))
    loss = (weight * (np.logaddexp(0, z) - target * z)).sum()
    return np.concatenate([[loss], np.bincount(at, weights=np.repeat(weight * (sigmoid(z) - target), sizes), minlength=len(w))])


def lbfgs(value: Callable[[np.ndarray], tuple[float, np.ndarray]], dims: int, ridge: float = 1e-4, steps: int = 30, kept: int = 8, near: float = 3e-5) -> np.ndarray:
    """The weights of the least loss and ridge; ``value`` gives the loss and its gradient over all rows."""

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, grad = value(w)
        return loss + ridge / 2 * float(w @ w), grad + ridge * w

    w, past = np.zeros(dims), []
    loss, grad = at(w)
    for _ in range(steps):
        if np.abs(grad).max() < near:
            break
        q, scaled = grad.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (s @ y)
            q -= a * y
            scaled.append(a)
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(np.linalg.norm(grad), 1e-12)
        for (s, y), a in zip(past, reversed(scaled)):
            q += s * (a - (y @ q) / (s @ y))
        length, slope = 1.0, float(grad @ q)
        while True:
            new = w - length * q
            new_loss, new_grad = at(new)
            if new_loss <= loss - 1e-4 * length * slope or length < 1e-4:
                break
            length /= 2
        if new_loss >= loss:
            break
        if (new - w) @ (new_grad - grad) > 1e-14:
            past = [*past, (new - w, new_grad - grad)][-kept:]
        w, loss, grad = new, new_loss, new_grad
    return w


def newton_part(x: np.ndarray, target: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Some rows' part of the curvature of a loss over dense features and, after it, of its descent."""
    q = sigmoid(x @ w)
    return np.concatenate([((x * (weight * (q * (1 - q) + 1e-6))[:, None]).T @ x).ravel(), x.T @ (weight * (target - q))])


def newton(total: Callable[[np.ndarray], np.ndarray], dims: int, begin: np.ndarray | None = None, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights of a few dense features; ``total`` gives the sum of newton_part over all rows; the first feature should be one."""
    w = np.zeros(dims) if begin is None else begin.copy()
    penalty = ridge * np.eye(dims)
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        sums = total(w)
        step = np.linalg.solve(sums[: dims * dims].reshape(dims, dims) + penalty, sums[dims * dims :] - penalty @ w)
        w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return w
