"""Recurrent layers in numpy: forward passes that keep what the backward passes need, and Adam.

Sequences are time-major (T, N, D); mask (T, N) is 1 where a step is real. A masked step leaves the state as it is.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32


def _sig(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5  # one transcendental, and no overflow


def init(rng, *shape, scale=None):
    return (rng.standard_normal(shape) * (scale or 1 / np.sqrt(shape[0]))).astype(F32)


def gru_params(rng, prefix: str, d: int, h: int) -> dict:
    return {f"{prefix}W": init(rng, d, 3 * h), f"{prefix}b": np.zeros(3 * h, F32), f"{prefix}U": init(rng, h, 3 * h)}


def lstm_params(rng, prefix: str, d: int, h: int) -> dict:
    b = np.zeros(4 * h, F32)
    b[h : 2 * h] = 1  # remember at first
    return {f"{prefix}W": init(rng, d, 4 * h), f"{prefix}b": b, f"{prefix}U": init(rng, h, 4 * h)}


def gru_step(gx, h, U):
    n = h.shape[1]
    gh = h @ U
    zr = _sig(gx[:, : 2 * n] + gh[:, : 2 * n])
    z, r = zr[:, :n], zr[:, n:]
    c = np.tanh(gx[:, 2 * n :] + r * gh[:, 2 * n :])
    return c + z * (h - c), z, r, c, gh[:, 2 * n :]


def gru(X, mask, W, b, U, reverse=False):
    T, N, _ = X.shape
    h, out, kept = np.zeros((N, U.shape[0]), F32), np.empty((T, N, U.shape[0]), F32), [None] * T
    gx = X @ W + b
    for t in range(T)[:: -1 if reverse else 1]:
        new, z, r, c, ghc = gru_step(gx[t], h, U)
        m = mask[t][:, None]
        kept[t] = (h, z, r, c, ghc)
        h = h + m * (new - h)
        out[t] = h
    return out, kept


def gru_back(dH, X, mask, W, b, U, kept, reverse=False):
    T, N, _ = X.shape
    n = U.shape[0]
    dh, dG, dU = np.zeros((N, n), F32), np.empty((T, N, 3 * n), F32), np.zeros_like(U)
    for t in range(T)[:: 1 if reverse else -1]:
        h, z, r, c, ghc = kept[t]
        dh = dh + dH[t]
        m = mask[t][:, None]
        d = dh * m
        dc = d * (1 - z) * (1 - c * c)
        dz = d * (h - c) * z * (1 - z)
        dr = dc * ghc * r * (1 - r)
        dG[t] = np.concatenate([dz, dr, dc], 1)
        dgh = np.concatenate([dz, dr, dc * r], 1)
        dU += h.T @ dgh
        dh = dh * (1 - m) + d * z + dgh @ U.T
    flat = dG.reshape(-1, 3 * n)
    return dG @ W.T, X.reshape(-1, X.shape[2]).T @ flat, flat.sum(0), dU


def lstm(X, mask, W, b, U, reverse=False, keep=True):
    T, N, _ = X.shape
    n = U.shape[0]
    h, c, out, kept = np.zeros((N, n), F32), np.zeros((N, n), F32), np.empty((T, N, n), F32), [None] * T
    gx = X @ W + b
    for t in range(T)[:: -1 if reverse else 1]:
        g = gx[t] + h @ U
        ifo, u = _sig(g[:, : 3 * n]), np.tanh(g[:, 3 * n :])
        i, f, o = ifo[:, :n], ifo[:, n : 2 * n], ifo[:, 2 * n :]
        m = mask[t][:, None]
        c2 = f * c + i * u
        tc = np.tanh(c2)
        if keep:
            kept[t] = (h, c, i, f, o, u, tc)
        h, c = h + m * (o * tc - h), c + m * (c2 - c)
        out[t] = h
    return out, kept


def lstm_back(dH, X, mask, W, b, U, kept, reverse=False):
    T, N, _ = X.shape
    n = U.shape[0]
    dh, dc, dG, dU = np.zeros((N, n), F32), np.zeros((N, n), F32), np.empty((T, N, 4 * n), F32), np.zeros_like(U)
    for t in range(T)[:: 1 if reverse else -1]:
        h, c, i, f, o, u, tc = kept[t]
        dh = dh + dH[t]
        m = mask[t][:, None]
        d = dh * m
        d2 = dc * m + d * o * (1 - tc * tc)
        g = np.concatenate([d2 * u * i * (1 - i), d2 * c * f * (1 - f), d * tc * o * (1 - o), d2 * i * (1 - u * u)], 1)
        dG[t] = g
        dU += h.T @ g
        dh = dh * (1 - m) + g @ U.T
        dc = dc * (1 - m) + d2 * f
    flat = dG.reshape(-1, 4 * n)
    return dG @ W.T, X.reshape(-1, X.shape[2]).T @ flat, flat.sum(0), dU


class Adam:
    def __init__(self, params: dict, rate: float = 3e-3):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict, clip: float = 5.0):
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, clip / (norm + 1e-9))
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            g = (g * scale).astype(F32)
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(F32)
