"""A bidirectional gated recurrent network in numpy: forward pass, backpropagation through time, Adam."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class GRU:
    """One direction. Inputs come as gate inputs (T, N, 3H), in the order update, reset, candidate."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.u = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        n = self.h
        hu = h @ self.u
        zr = sigmoid(x[:, : 2 * n] + hu[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(x[:, 2 * n :] + r * hu[:, 2 * n :])
        return c + z * (h - c), z, r, c, hu[:, 2 * n :]

    def run(self, x: np.ndarray, keep: bool = False):
        t, n, _ = x.shape
        h = np.zeros((n, self.h), np.float32)
        out, cache = np.empty((t, n, self.h), np.float32), []
        for i in range(t):
            before = h
            h, *rest = self.step(x[i], h)
            out[i] = h
            if keep:
                cache.append((before, *rest))
        return out, cache

    def back(self, d_out: np.ndarray, cache: list) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the gate inputs and of ``u``."""
        n = self.h
        dx, du = np.empty((*d_out.shape[:2], 3 * n), np.float32), np.zeros_like(self.u)
        dh = np.zeros(d_out.shape[1:], np.float32)
        for i in range(len(cache) - 1, -1, -1):
            h, z, r, c, hc = cache[i]
            dh = dh + d_out[i]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * hc * r * (1 - r)
            dx[i] = np.concatenate([dz, dr, dc], 1)
            dg = np.concatenate([dz, dr, dc * r], 1)
            du += h.T @ dg
            dh = dh * z + dg @ self.u.T
        return dx, du


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            norm = float(np.sqrt((g * g).sum()))
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-7)


class RowAdam:
    """Adam on the rows of a table that a step touches; other rows and their moments rest."""

    def __init__(self, table: np.ndarray, rate: float):
        self.p, self.rate, self.t = table, rate, 0
        self.m, self.v = np.zeros_like(table), np.zeros_like(table)

    def update(self, rows: np.ndarray, grads: np.ndarray) -> None:
        self.t += 1
        grads = grads * min(1.0, 5.0 / (float(np.sqrt((grads * grads).sum())) + 1e-9))
        self.m[rows] += 0.1 * (grads - self.m[rows])
        self.v[rows] += 0.01 * (grads * grads - self.v[rows])
        self.p[rows] -= self.rate * (self.m[rows] / (1 - 0.9**self.t)) / (np.sqrt(self.v[rows] / (1 - 0.99**self.t)) + 1e-6)


def scatter(index: np.ndarray, grads: np.ndarray, rows: int) -> np.ndarray:
    """Sums the gradients of table rows: index (M,), grads (M, D)."""
    return np.stack([np.bincount(index, grads[:, j], rows) for j in range(grads.shape[1])], 1).astype(np.float32)
