"""Small recurrent networks in numpy, trained by backpropagation through time."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01) -> None:
        self.params, self.rate, self.step = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.step), self.v[k] / (1 - 0.999**self.step)
            self.params[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(self.params[k].dtype)


def init_recurrent(rng: np.random.Generator, symbols: int, hidden: int, gates: int, out: int) -> dict[str, np.ndarray]:
    """Weights of both directions: ``x`` per input symbol (bias included), ``h`` recurrent, ``o`` output."""
    p: dict[str, np.ndarray] = {}
    for d in "fb":
        p[f"x{d}"] = rng.normal(0, 0.3, (symbols, gates * hidden)).astype(np.float32)
        p[f"h{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, gates * hidden)).astype(np.float32)
    p["o"] = rng.normal(0, 0.2, (2 * hidden, out)).astype(np.float32)
    p["c"] = np.zeros(out, np.float32)
    return p


def softsign(x: np.ndarray) -> np.ndarray:
    """Like tanh, from -1 to 1, at a fraction of the time."""
    return x / (1 + np.abs(x))


def gru_run(x: np.ndarray, xw: np.ndarray, hw: np.ndarray, keep: bool = False):
    """States [T, B, H] over symbols [T, B]; with ``keep`` also what the backward pass needs.  All functions are softsigns."""
    steps, batch = x.shape
    size = hw.shape[0]
    h = np.zeros((batch, size), np.float32)
    out, saved = np.empty((steps, batch, size), np.float32), []
    for t in range(steps):
        a = xw[x[t]]
        zr = 0.5 * (softsign(a[:, : 2 * size] + h @ hw[:, : 2 * size]) + 1)
        z, r = zr[:, :size], zr[:, size:]
        rh = r * h
        n = softsign(a[:, 2 * size :] + rh @ hw[:, 2 * size :])
        if keep:
            saved.append((h, z, r, rh, n))
        h = n + z * (h - n)
        out[t] = h
    return (out, saved) if keep else out


def gru_states(x: np.ndarray, xw: np.ndarray, hw: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """``gru_run`` with the batch last, [T, H, B]: the same numbers with less overhead."""
    size, batch = hw.shape[0], x.shape[1]
    table = np.ascontiguousarray(xw.T)
    gates_, new = np.ascontiguousarray(hw[:, : 2 * size].T), np.ascontiguousarray(hw[:, 2 * size :].T)
    h = np.zeros((size, batch), np.float32)
    out = np.empty((len(x), size, batch), np.float32) if out is None else out
    a, zr, low = np.empty((3 * size, batch), np.float32), np.empty((2 * size, batch), np.float32), np.empty((2 * size, batch), np.float32)
    n, rh = np.empty((size, batch), np.float32), np.empty((size, batch), np.float32)
    one, half = np.float32(1), np.float32(0.5)
    for t in range(len(x)):
        np.take(table, x[t], axis=1, out=a, mode="clip")
        np.matmul(gates_, h, out=zr)
        np.add(zr, a[: 2 * size], out=zr)
        np.abs(zr, out=low)
        np.add(low, one, out=low)
        np.divide(zr, low, out=zr)
        np.multiply(zr, half, out=zr)
        np.add(zr, half, out=zr)
        np.multiply(zr[size:], h, out=rh)
        np.matmul(new, rh, out=n)
        np.add(n, a[2 * size :], out=n)
        np.abs(n, out=rh)
        np.add(rh, one, out=rh)
        np.divide(n, rh, out=n)
        np.subtract(h, n, out=h)
        np.multiply(h, zr[:size], out=h)
        np.add(h, n, out=h)
        out[t] = h
    return out


def gru_back(x: np.ndarray, xw: np.ndarray, hw: np.ndarray, saved: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = hw.shape[0]
    dxw, dhw, dh = np.zeros_like(xw), np.zeros_like(hw), np.zeros_like(dout[0])
    for t in range(len(saved) - 1, -1, -1):
        h, z, r, rh, n = saved[t]
        dh = dh + dout[t]
        dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
        dz = dh * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        drh = dn @ hw[:, 2 * size :].T
        dr = drh * h * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        dzr = np.concatenate([dz, dr], 1)
        np.add.at(dxw, x[t], np.concatenate([dzr, dn], 1))
        dhw[:, : 2 * size] += h.T @ dzr
        dhw[:, 2 * size :] += rh.T @ dn
        dh = dh * z + drh * r + dzr @ hw[:, : 2 * size].T
    return dxw, dhw


def lstm_run(x: np.ndarray, xw: np.ndarray, hw: np.ndarray, keep: bool = False):
    steps, batch = x.shape
    size = hw.shape[0]
    h, c = np.zeros((batch, size), np.float32), np.zeros((batch, size), np.float32)
    out, saved = np.empty((steps, batch, size), np.float32), []
    for t in range(steps):
        a = xw[x[t]] + h @ hw
        s = sigmoid(a[:, : 3 * size])
        i, f, o = s[:, :size], s[:, size : 2 * size], s[:, 2 * size :]
        g = np.tanh(a[:, 3 * size :])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep:
            saved.append((h, before, i, f, o, g, tc))
        h = o * tc
        out[t] = h
    return (out, saved) if keep else out


def lstm_back(x: np.ndarray, xw: np.ndarray, hw: np.ndarray, saved: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dxw, dhw = np.zeros_like(xw), np.zeros_like(hw)
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    for t in range(len(saved) - 1, -1, -1):
        h, before, i, f, o, g, tc = saved[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        da = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        np.add.at(dxw, x[t], da)
        dhw += h.T @ da
        dh, dc = da @ hw.T, dc * f
    return dxw, dhw


RUN = {3: (gru_run, gru_back), 4: (lstm_run, lstm_back)}


def gates(p: dict[str, np.ndarray]) -> int:
    return p["hf"].shape[1] // p["hf"].shape[0]


def emissions(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Scores [T, B, out] of both directions over symbols [T, B]."""
    run = RUN[gates(p)][0]
    return np.concatenate([run(x, p["xf"], p["hf"]), run(x[::-1], p["xb"], p["hb"])[::-1]], 2) @ p["o"] + p["c"]


def emissions_grad(p: dict[str, np.ndarray], x: np.ndarray, loss) -> dict[str, np.ndarray]:
    """Gradients of ``loss``: a function from emissions to (their gradient, further gradients)."""
    run, back = RUN[gates(p)]
    fwd, kept_f = run(x, p["xf"], p["hf"], keep=True)
    bwd, kept_b = run(x[::-1], p["xb"], p["hb"], keep=True)
    both = np.concatenate([fwd, bwd[::-1]], 2)
    de, more = loss(both @ p["o"] + p["c"])
    flat = de.reshape(-1, de.shape[2])
    d = de @ p["o"].T
    size = p["hf"].shape[0]
    grads = {"o": both.reshape(-1, both.shape[2]).T @ flat, "c": flat.sum(0)}
    grads["xf"], grads["hf"] = back(x, p["xf"], p["hf"], kept_f, d[:, :, :size])
    grads["xb"], grads["hb"] = back(x[::-1], p["xb"], p["hb"], kept_b, d[::-1, :, size:])
    return grads | more


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def crf_alpha_beta(e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log scores [T, B, K] and log partition [B]; ``trans[i, j]``: from i to j."""
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, len(e)):
        alpha[t] = logsumexp(alpha[t - 1][:, :, None] + trans, 1) + e[t]
    for t in range(len(e) - 2, -1, -1):
        beta[t] = logsumexp(trans + (beta[t + 1] + e[t + 1])[:, None, :], 2)
    return alpha, beta, logsumexp(alpha[-1], 1)


def crf_marginals(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    alpha, beta, z = crf_alpha_beta(e, trans)
    return np.exp(alpha + beta - z[None, :, None])


def crf_loss(e: np.ndarray, trans: np.ndarray, gold: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negative log likelihood with respect to emissions and transitions."""
    alpha, beta, z = crf_alpha_beta(e, trans)
    count = e.shape[1]
    de = np.exp(alpha + beta - z[None, :, None])
    np.put_along_axis(de, gold[:, :, None], np.take_along_axis(de, gold[:, :, None], 2) - 1, 2)
    pair = np.exp(alpha[:-1][:, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]).sum((0, 1))
    np.subtract.at(pair, (gold[:-1].ravel(), gold[1:].ravel()), 1)
    return (de / count).astype(np.float32), (pair / count).astype(np.float32)


def crf_viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tag paths [T, B]; equal scores go to the lower tag."""
    steps, batch, _ = e.shape
    score, back = e[0], np.zeros(e.shape, np.int8)
    for t in range(1, steps):
        s = score[:, :, None] + trans
        back[t] = s.argmax(1)
        score = np.take_along_axis(s, back[t][:, None, :].astype(np.int64), 1)[:, 0, :] + e[t]
    path = np.empty((steps, batch), np.int64)
    path[-1] = score.argmax(1)
    rows = np.arange(batch)
    for t in range(steps - 1, 0, -1):
        path[t - 1] = back[t][rows, path[t]]
    return path
