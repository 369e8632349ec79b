"""A bidirectional gated recurrent network with attention pooling, in numpy.

Inputs are windows of T steps of ``inputs`` numbers. Two GRU layers read a
window forwards and backwards; at each step their states are joined, a
softmax over the steps of a learnt score of the joined state weighs them,
and the weighted sum gives the logit.

    z, r = sigmoid(x Wz + h Uz + bz), sigmoid(x Wr + h Ur + br)
    n    = tanh(x Wn + bn + r * (h Un))
    h'   = (1 - z) * n + z * h

Weights are kept as (inputs, 3 hidden) and (hidden, 3 hidden) blocks in the
order z, r, n. Arrays are (steps, windows, ...).
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def initial(inputs: int, hidden: int, seed: int = 0) -> Params:
    rng = np.random.default_rng(seed)
    params: Params = {}
    for side in "fb":
        params[f"W{side}"] = rng.normal(0, inputs**-0.5, (inputs, 3 * hidden))
        params[f"U{side}"] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden))
        params[f"c{side}"] = np.zeros(3 * hidden)
    params["attend"] = rng.normal(0, 0.3, 2 * hidden)
    params["out"] = rng.normal(0, 0.3, 2 * hidden)
    params["bias"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in params.items()}


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def run_gru(projected, U: np.ndarray, steps: int, windows: int):
    """States of one direction; ``projected(t)`` gives x W + c of step t. Returns (h, gates) of every step."""
    hidden = U.shape[0]
    states = np.zeros((steps + 1, windows, hidden), np.float32)
    gates = []
    for t in range(steps):
        h, x = states[t], projected(t)
        u = h @ U
        zr = _sigmoid(x[:, : 2 * hidden] + u[:, : 2 * hidden])
        z, r = zr[:, :hidden], zr[:, hidden:]
        n = np.tanh(x[:, 2 * hidden :] + r * u[:, 2 * hidden :])
        states[t + 1] = n + z * (h - n)
        gates.append((z, r, n, u[:, 2 * hidden :]))
    return states, gates


def pool(params: Params, joined: np.ndarray, mask: np.ndarray):
    """(logits, weights): attention over the steps; a window without any step pools to zero."""
    weight = np.exp(joined @ params["attend"]) * mask
    total = weight.sum(axis=0)
    weight /= np.where(total > 0, total, 1)
    pooled = np.einsum("tb,tbh->bh", weight, joined)
    return pooled @ params["out"] + params["bias"][0], weight, pooled


def logits(params: Params, forward, backward, mask: np.ndarray) -> np.ndarray:
    """``forward(t)`` and ``backward(t)``: projected inputs of step t in reading order of each direction."""
    steps, windows = mask.shape
    f, _ = run_gru(forward, params["Uf"], steps, windows)
    b, _ = run_gru(backward, params["Ub"], steps, windows)
    return pool(params, np.concatenate([f[1:], b[:0:-1]], axis=2), mask)[0]


def loss_and_gradient(params: Params, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Weighted logistic loss of a batch, and its gradient by backpropagation through time."""
    steps, windows, _ = x.shape
    hidden = params["Uf"].shape[0]
    sides = {}
    for side, order in (("f", x), ("b", x[::-1])):
        W, c = params[f"W{side}"], params[f"c{side}"]
        sides[side] = (order, *run_gru(lambda t: order[t] @ W + c, params[f"U{side}"], steps, windows))
    joined = np.concatenate([sides["f"][1][1:], sides["b"][1][:0:-1]], axis=2)
    logit, attention, pooled = pool(params, joined, mask)
    p = _sigmoid(logit)
    scale = weight / weight.sum()
    loss = float(-(scale * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum())
    d_logit = (scale * (p - y)).astype(np.float32)
    grad: Params = {"bias": np.array([d_logit.sum()]), "out": d_logit @ pooled}
    d_pooled = d_logit[:, None] * params["out"]
    d_joined = attention[:, :, None] * d_pooled
    d_weight = np.einsum("tbh,bh->tb", joined, d_pooled)
    d_score = attention * (d_weight - (attention * d_weight).sum(axis=0))
    grad["attend"] = np.einsum("tb,tbh->h", d_score, joined)
    d_joined += d_score[:, :, None] * params["attend"]
    for side, d_states in (("f", d_joined[:, :, :hidden]), ("b", d_joined[::-1, :, hidden:])):
        order, states, gates = sides[side]
        U = params[f"U{side}"]
        d_W, d_U, d_c = np.zeros_like(params[f"W{side}"]), np.zeros_like(U), np.zeros_like(params[f"c{side}"])
        d_h = np.zeros((windows, hidden), np.float32)
        for t in range(steps - 1, -1, -1):
            z, r, n, u_n = gates[t]
            h = states[t]
            d_h = d_h + d_states[t]
            d_n = d_h * (1 - z) * (1 - n * n)
            d_z = d_h * (h - n) * z * (1 - z)
            d_r = d_n * u_n * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_n], axis=1)
            d_u = np.concatenate([d_z, d_r, d_n * r], axis=1)
            d_W += order[t].T @ d_x
            d_U += h.T @ d_u
            d_c += d_x.sum(axis=0)
            d_h = d_h * z + d_u @ U.T
        grad |= {f"W{side}": d_W, f"U{side}": d_U, f"c{side}": d_c}
    return loss, grad


class Adam:
    def __init__(self, params: Params, rate: float = 0.02) -> None:
        self.params, self.rate, self.step = params, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in params.items()}
        self.second = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grad: Params) -> None:
        self.step += 1
        for k, g in grad.items():
            g = np.clip(g, -1, 1)
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.99 * self.second[k] + 0.01 * g * g
            m, v = self.first[k] / (1 - 0.9**self.step), self.second[k] / (1 - 0.99**self.step)
            self.params[k] -= (self.rate * m / (np.sqrt(v) + 1e-6)).astype(np.float32)
