"""Character tagger in numpy: embedding, one LSTM per direction, CRF transitions."""

from __future__ import annotations

import numpy as np


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def _logsumexp(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Windows of equal length (codes, batch x time) to tags; all weights are float32 arrays in ``p``."""

    def __init__(self, n_codes: int, n_tags: int, embed: int = 12, hidden: int = 20, seed: int = 1):
        rng = np.random.default_rng(seed)

        def normal(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.hidden = hidden
        self.p = {"emb": normal(n_codes, embed), "out": normal(2 * hidden, n_tags), "out_b": np.zeros(n_tags, np.float32),
                  "trans": np.zeros((n_tags, n_tags), np.float32), "begin": np.zeros(n_tags, np.float32)}
        for d in "fb":
            self.p |= {f"x_{d}": normal(embed, 4 * hidden), f"h_{d}": normal(hidden, 4 * hidden),
                       f"b_{d}": np.concatenate((np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden))).astype(np.float32)}

    def _lstm(self, x, d, trace=None):
        """Hidden states over time; ``trace`` collects what the backward pass needs."""
        n, hid = x.shape[0], self.hidden
        h = c = np.zeros((n, hid), np.float32)
        out = np.empty((n, x.shape[1], hid), np.float32)
        inputs = x @ self.p[f"x_{d}"] + self.p[f"b_{d}"]
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            z = inputs[:, t] + h @ self.p[f"h_{d}"]
            s = _sigmoid(z[:, :3 * hid])
            i, f, o = s[:, :hid], s[:, hid:2 * hid], s[:, 2 * hid:]
            g = np.tanh(z[:, 3 * hid:])
            before, old = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            if trace is not None:
                trace.append((t, i, f, o, g, tc, before, old))
        return out

    def _lstm_back(self, x, d, trace, grad_out, grads):
        hid = self.hidden
        dh = dc = np.zeros((x.shape[0], hid), np.float32)
        dz_all = np.empty((x.shape[0], x.shape[1], 4 * hid), np.float32)
        for t, i, f, o, g, tc, before, old in reversed(trace):
            dh = dh + grad_out[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate((dc * g * i * (1 - i), dc * old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), axis=1)
            dz_all[:, t] = dz
            grads[f"h_{d}"] += before.T @ dz
            dh = dz @ self.p[f"h_{d}"].T
            dc = dc * f
        flat = dz_all.reshape(-1, 4 * hid)
        grads[f"x_{d}"] += x.reshape(-1, x.shape[2]).T @ flat
        grads[f"b_{d}"] += flat.sum(axis=0)
        return dz_all @ self.p[f"x_{d}"].T

    def emissions(self, codes):
        x = self.p["emb"][codes]
        both = np.concatenate((self._lstm(x, "f"), self._lstm(x, "b")), axis=2)
        return both @ self.p["out"] + self.p["out_b"]

    def decode(self, codes):
        """Best tag path of every window (Viterbi)."""
        em = self.emissions(codes)
        score = em[:, 0] + self.p["begin"]
        back = np.empty(em.shape, np.int8)
        for t in range(1, em.shape[1]):
            step = score[:, :, None] + self.p["trans"]
            back[:, t] = step.argmax(axis=1)
            score = step.max(axis=1) + em[:, t]
        tags = np.empty(codes.shape, np.int8)
        tags[:, -1] = score.argmax(axis=1)
        rows = np.arange(len(codes))
        for t in range(em.shape[1] - 1, 0, -1):
            tags[:, t - 1] = back[rows, t, tags[:, t]]
        return tags

    def gradients(self, codes, tags):
        """Mean negative log-likelihood of the tag paths and its gradients."""
        p, (n, length) = self.p, codes.shape
        x = p["emb"][codes]
        traces = {"f": [], "b": []}
        both = np.concatenate([self._lstm(x, d, traces[d]) for d in "fb"], axis=2)
        em = both @ p["out"] + p["out_b"]
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[:, 0] = em[:, 0] + p["begin"]
        for t in range(1, length):
            alpha[:, t] = _logsumexp(alpha[:, t - 1, :, None] + p["trans"], 1) + em[:, t]
        for t in range(length - 2, -1, -1):
            beta[:, t] = _logsumexp(p["trans"] + (em[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        total = _logsumexp(alpha[:, -1], 1)
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        d_em = np.exp(alpha + beta - total[:, None, None])
        rows = np.arange(n)
        gold = p["begin"][tags[:, 0]] + em[rows, 0, tags[:, 0]]
        for t in range(1, length):
            pair = np.exp(alpha[:, t - 1, :, None] + p["trans"] + (em[:, t] + beta[:, t])[:, None, :] - total[:, None, None])
            grads["trans"] += pair.sum(axis=0)
            gold = gold + p["trans"][tags[:, t - 1], tags[:, t]] + em[rows, t, tags[:, t]]
        np.subtract.at(grads["trans"], (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        np.subtract.at(d_em, (rows[:, None], np.arange(length)[None, :], tags), 1)
        grads["begin"] = d_em[:, 0].sum(axis=0)
        flat = d_em.reshape(-1, d_em.shape[2])
        grads["out"] = both.reshape(-1, both.shape[2]).T @ flat
        grads["out_b"] = flat.sum(axis=0)
        d_both = d_em @ p["out"].T
        hid = self.hidden
        d_x = self._lstm_back(x, "f", traces["f"], d_both[:, :, :hid], grads)
        d_x = d_x + self._lstm_back(x, "b", traces["b"], d_both[:, :, hid:], grads)
        np.add.at(grads["emb"], codes.ravel(), d_x.reshape(-1, d_x.shape[2]))
        return float((total - gold).mean()), {k: v / n for k, v in grads.items()}

    def fit(self, codes, tags, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 1) -> float:
        """Adam over shuffled batches; returns the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, loss = 0, 0.0
        for epoch in range(epochs):
            lr = rate * (1 - epoch / (epochs + 1))
            order, losses = rng.permutation(len(codes)), []
            for a in range(0, len(order), batch):
                pick = order[a:a + batch]
                one, grads = self.gradients(codes[pick], tags[pick])
                losses.append(one)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                clip = min(1.0, 5.0 / (norm + 1e-9))
                step += 1
                for k, g in grads.items():
                    g = g * clip
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
            loss = float(np.mean(losses))
        return loss
