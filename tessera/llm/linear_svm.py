"""Linear support vector machines by dual coordinate descent, with logistic calibration of margins."""

from __future__ import annotations

import numpy as np


def fit_dual(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, cost: np.ndarray, epochs: int = 20, seed: int = 7
) -> tuple[np.ndarray, float]:
    """Weights and bias under hinge loss. rows: (feature indices, values) of each example; cost: its upper bound.

    Solves the box-constrained dual one coordinate at a time in a shuffled order; the bias is a constant feature.
    An empty training set gives zero weights.
    """
    w, bias = np.zeros(size, rows[0][1].dtype if rows else np.float64), 0.0  # sums in the kind of the values
    sign = np.where(labels > 0, 1.0, -1.0)
    norm = np.array([float(v @ v) + 1.0 for _, v in rows])
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(seed)
    active = np.arange(len(rows))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(active):
            index, value = rows[i]
            gradient = sign[i] * (w[index] @ value + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if (step := (new - alpha[i]) * sign[i]) != 0.0:
                alpha[i] = new
                w[index] += value * w.dtype.type(step)
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def fit_primal(x: np.ndarray, labels: np.ndarray, cost: np.ndarray, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias under the squared hinge loss, by Newton steps over the examples inside the margin.

    Examples are taken in blocks, so beside x itself memory is that of one block and of one square of the features.
    """
    sign = np.where(labels > 0, 1.0, -1.0)
    size = x.shape[1] + 1
    ridge = np.ones(size)
    ridge[-1] = 1e-3
    blocks = [slice(i, i + 4096) for i in range(0, len(x), 4096)]

    def margins(at: np.ndarray) -> np.ndarray:
        return np.concatenate([x[b] @ at[:-1] + at[-1] for b in blocks]) if blocks else np.zeros(0)

    def loss(at: np.ndarray, m: np.ndarray) -> float:
        return float(ridge * at @ at / 2 + cost @ np.maximum(0.0, 1.0 - sign * m) ** 2)

    w = np.zeros(size)
    now = margins(w)
    for _ in range(steps):
        slack = np.maximum(0.0, 1.0 - sign * now)
        gradient, hessian = ridge * w, np.diag(ridge)
        for b in blocks:
            inside = slack[b] > 0
            part = np.column_stack([x[b][inside], np.ones(int(inside.sum()), x.dtype)])  # sums in the kind of x
            c = cost[b][inside].astype(x.dtype)
            gradient = gradient - 2 * part.T @ (c * slack[b][inside] * sign[b][inside])
            hessian += 2 * (part * c[:, None]).T @ part
        move = -np.linalg.solve(hessian, gradient)
        scale, before = 1.0, loss(w, now)
        while loss(w + scale * move, after := margins(w + scale * move)) > before and scale > 1e-6:
            scale /= 2
        w, now = w + scale * move, after
        if np.abs(scale * move).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_sigmoid(margins: np.ndarray, labels: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a * margin + b))) fits the labels, by Newton steps on smoothed targets."""
    up, down = float((labels > 0).sum()), float((labels <= 0).sum())
    if not up or not down:
        return 1.0, 0.0
    target = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.column_stack([margins, np.ones(len(margins))])
    theta = np.array([1.0, 0.0])

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float(np.logaddexp(0.0, z).sum() - target @ z + 1e-6 * at @ at / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        move = np.linalg.solve(hessian, x.T @ (target - p) - 1e-6 * theta)
        now = loss(theta)
        while loss(theta + move) > now and np.abs(move).max() > 1e-10:
            move = move / 2
        theta = theta + move
        if np.abs(move).max() < 1e-8:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
