"""A bidirectional gated recurrent network over bytes, in numpy: training by backpropagation through time, and scoring
of every position of many texts at once. A step takes two bytes, each by weights of its own, so a text has half as many
steps as bytes; the labels are by step."""

from __future__ import annotations

import numpy as np

HIDDEN = 32
CHUNK, CONTEXT, LANES = 256, 32, 1024


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """One direction's weights: W by first and second byte, U from the state, b, and V to the classes."""

    def __init__(self, classes: int, rng: np.random.Generator, hidden: int = HIDDEN) -> None:
        s = 1 / np.sqrt(hidden)
        self.W = rng.uniform(-0.3, 0.3, (512, 3 * hidden)).astype(np.float32)
        self.U = rng.uniform(-s, s, (hidden, 3 * hidden)).astype(np.float32)
        self.b = np.zeros(3 * hidden, np.float32)
        self.b[:hidden] = 1.0  # keeps the state at first
        self.V = rng.uniform(-s, s, (hidden, classes)).astype(np.float32)

    def arrays(self) -> list[np.ndarray]:
        return [self.W, self.U, self.b, self.V]

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        """x: bytes (2, lanes), h: states (lanes, hidden). The new states, and what the way back needs."""
        k = h.shape[1]
        a, u = self.W[x[0]] + self.W[x[1].astype(np.int64) + 256], h @ self.U
        gate = _sigmoid(a[:, : 2 * k] + u[:, : 2 * k] + self.b[: 2 * k])
        z, r = gate[:, :k], gate[:, k:]
        n = np.tanh(a[:, 2 * k :] + r * u[:, 2 * k :] + self.b[2 * k :])
        return n + z * (h - n), (z, r, n, h, u[:, 2 * k :])

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """x: (steps, 2, lanes). States (steps, lanes, hidden) and the steps' records."""
        h = np.zeros((x.shape[2], self.U.shape[0]), np.float32)
        states, kept = np.empty((len(x), *h.shape), np.float32), []
        for t in range(len(x)):
            h, k = self.step(x[t], h)
            states[t] = h
            kept.append(k)
        return states, kept

    def backward(self, x: np.ndarray, dstates: np.ndarray, kept: list[tuple]) -> list[np.ndarray]:
        """Gradients of W, U and b from those of the states, back through time."""
        k = self.U.shape[0]
        dU, dgates = np.zeros_like(self.U), np.empty((len(x), x.shape[2], 3 * k), np.float32)
        dh = np.zeros_like(dstates[0])
        for t in range(len(x) - 1, -1, -1):
            z, r, n, h, un = kept[t]
            dh = dh + dstates[t]
            dn = dh * (1 - z) * (1 - n * n)
            g = dgates[t]
            g[:, :k] = dh * (h - n) * z * (1 - z)
            g[:, k : 2 * k] = dn * un * r * (1 - r)
            g[:, 2 * k :] = dn * r  # for U; W and b get dn
            dU += h.T @ g
            dh = dh * z + g @ self.U.T
            g[:, 2 * k :] = dn
        rows, dW = dgates.reshape(-1, 3 * k), np.zeros_like(self.W)
        for i in (0, 1):
            flat = x[:, i].ravel().astype(np.int64) + 256 * i
            order = np.argsort(flat, kind="stable")
            start = np.flatnonzero(np.r_[True, flat[order][1:] != flat[order][:-1]])
            dW[flat[order][start]] = np.add.reduceat(rows[order], start, axis=0)
        return [dW, dU, rows.sum(0)]


    def scorer(self, lanes: int):
        """The steps without records: a function of (bytes, states) that changes the states in place."""
        k, f = self.U.shape[0], np.float32
        # a gate is half of a tanh of half its input, and a half
        gates, new = np.ascontiguousarray(self.W[:, : 2 * k]) * f(0.5), np.ascontiguousarray(self.W[:, 2 * k :])
        gates[:256] += self.b[: 2 * k] * f(0.5)
        new[:256] += self.b[2 * k :]
        u_gates, u_new = np.ascontiguousarray(self.U[:, : 2 * k]) * f(0.5), np.ascontiguousarray(self.U[:, 2 * k :])
        g, g2 = np.empty((2, lanes, 2 * k), f)
        n, n2 = np.empty((2, lanes, k), f)

        def step(first: np.ndarray, second: np.ndarray, h: np.ndarray) -> None:
            np.take(gates, first, axis=0, out=g, mode="clip")
            np.add(g, np.take(gates, second, axis=0, out=g2, mode="clip"), out=g)
            np.add(g, np.matmul(h, u_gates, out=g2), out=g)
            np.tanh(g, out=g)
            np.multiply(g, f(0.5), out=g)
            np.add(g, f(0.5), out=g)
            np.multiply(np.matmul(h, u_new, out=n), g[:, k:], out=n)
            np.add(n, np.take(new, first, axis=0, out=n2, mode="clip"), out=n)
            np.add(n, np.take(new, second, axis=0, out=n2, mode="clip"), out=n)
            np.tanh(n, out=n)
            np.subtract(h, n, out=h)
            np.multiply(h, g[:, :k], out=h)
            np.add(h, n, out=h)

        return step


def steps_of(x: np.ndarray) -> np.ndarray:
    """Bytes (2 steps, lanes) as (steps, 2, lanes)."""
    return x.reshape(len(x) // 2, 2, -1)


class Network:
    """Both directions and the output bias."""

    def __init__(self, classes: int, seed: int = 9) -> None:
        rng = np.random.default_rng(seed)
        self.ahead, self.back, self.c = Direction(classes, rng), Direction(classes, rng), np.zeros(classes, np.float32)

    def arrays(self) -> list[np.ndarray]:
        return [*self.ahead.arrays(), *self.back.arrays(), self.c]

    def loss_and_gradients(self, x: np.ndarray, y: np.ndarray, gradients: bool = True) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of the classes y (steps, lanes) over the bytes x (2 steps, lanes)."""
        x = steps_of(x)
        hf, kf = self.ahead.forward(x)
        hb, kb = self.back.forward(x[::-1])
        p = hf @ self.ahead.V + hb[::-1] @ self.back.V + self.c
        p -= p.max(-1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(-1, keepdims=True)
        t, b = np.indices(y.shape)
        loss = float(-np.log(p[t, b, y] + 1e-9).mean())
        if not gradients:
            return loss, []
        p[t, b, y] -= 1
        p /= y.size
        d = p.reshape(-1, p.shape[-1])
        dVf, dVb = hf.reshape(len(d), -1).T @ d, hb[::-1].reshape(len(d), -1).T @ d
        gf = self.ahead.backward(x, p @ self.ahead.V.T, kf)
        gb = self.back.backward(x[::-1], (p @ self.back.V.T)[::-1], kb)
        return loss, [*gf, dVf, *gb, dVb, d.sum(0)]

    def train(self, draw, steps: int, rate: float = 0.01, averaged: float = 0.0) -> float:
        """Adam over ``draw()`` -> (x, y), the rate falling to a tenth; the last losses' mean. The weights become their mean
        over the last share ``averaged`` of the steps."""
        ps = self.arrays()
        m, v = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps]
        means, counted = [np.zeros(p.shape, np.float64) for p in ps], 0
        losses = []
        for i in range(1, steps + 1):
            loss, gs = self.loss_and_gradients(*draw())
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in gs))
            scale = min(1.0, 1.0 / (norm + 1e-9))
            lr = rate * (1 - 0.9 * i / steps)
            for p, g, a, b in zip(ps, gs, m, v):
                g = g * scale
                a += 0.1 * (g - a)
                b += 0.005 * (g * g - b)
                p -= (lr / (1 - 0.9**i)) * a / (np.sqrt(b / (1 - 0.995**i)) + 1e-8)
            if i > steps * (1 - averaged):
                counted += 1
                for p, mean in zip(ps, means):
                    mean += (p - mean) / counted
        if counted:
            for p, mean in zip(ps, means):
                p[...] = mean
        return float(np.mean(losses[-20:]))

    def _lanes(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities (steps, lanes, classes) of bytes (2 steps, lanes)."""
        x = steps_of(x)
        first, second = x[:, 0].astype(np.int64), x[:, 1].astype(np.int64) + 256
        out = np.empty((len(x), x.shape[2], len(self.c)), np.float32)
        for way, d in ((1, self.ahead), (-1, self.back)):
            h, step = np.zeros((x.shape[2], d.U.shape[0]), np.float32), d.scorer(x.shape[2])
            for t in range(len(x))[::way]:
                step(first[t], second[t], h)
                if way == 1:
                    np.matmul(h, d.V, out=out[t])
                else:
                    out[t] += h @ d.V
        out += self.c
        # the states are within (-1, 1), so the sums are bounded by the weights
        total = np.exp(out) @ np.ones(len(self.c), np.float32)
        out -= np.log(total)[..., None]
        return out

    def unit_scores(self, data: np.ndarray, start: np.ndarray, units: int, texts: np.ndarray | None = None) -> np.ndarray:
        """Sums of log-probabilities (units, classes) over the steps of each unit, a step being of the unit of its first
        byte; ``start`` has each unit's first byte, ``texts`` each text's, both ascending. Every text begins a chunk of its
        own and is followed by CONTEXT spaces, so its scores don't depend on its neighbours; within it, each position sees
        CONTEXT bytes beyond its chunk at either side. Chunks run side by side, so memory doesn't grow with the texts."""
        out = np.zeros((units, len(self.c)), np.float64)
        texts = np.zeros(1, np.int64) if texts is None else texts
        size = np.diff(np.r_[texts, len(data)])
        room = -(-(size + CONTEXT) // CHUNK) * CHUNK
        at_text = np.cumsum(room) - room
        padded = np.full(2 * CONTEXT + int(room.sum()), 32, np.uint8)
        for a, n, to in zip(texts.tolist(), size.tolist(), at_text.tolist()):
            padded[CONTEXT + to : CONTEXT + to + n] = data[a : a + n]
        moved = start + (at_text - texts)[np.searchsorted(texts, start, "right") - 1]
        end = moved + np.diff(np.r_[start, len(data)])
        view = np.lib.stride_tricks.sliding_window_view(padded, CHUNK + 2 * CONTEXT)[::CHUNK]
        for at in range(0, len(view), LANES):
            p = self._lanes(np.ascontiguousarray(view[at : at + LANES].T))[CONTEXT // 2 : (CONTEXT + CHUNK) // 2]
            flat = p.transpose(1, 0, 2).reshape(-1, p.shape[-1])
            place = at * CHUNK + 2 * np.arange(len(flat))
            own = np.searchsorted(moved, place, "right") - 1
            inside = (own >= 0) & (place < end[own])
            own, flat = own[inside], flat[inside]
            if len(own):
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                out[own[first]] += np.add.reduceat(flat, first, axis=0, dtype=np.float64)
        return out
