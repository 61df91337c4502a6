"""A set-value head: an MLP over the frames of a set, pooled, trained on preferences within questions, in numpy."""

from __future__ import annotations

import numpy as np


def gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """GELU (tanh form) and its slope."""
    k = np.sqrt(2 / np.pi)
    t = np.tanh(k * (x + 0.044715 * x**3))
    return 0.5 * x * (1 + t), 0.5 * (1 + t) + 0.5 * x * (1 - t**2) * k * (1 + 3 * 0.044715 * x**2)


def set_features(vectors: np.ndarray, scores: np.ndarray, times: np.ndarray, duration: float) -> np.ndarray:
    """Unit vectors, scores and times over the duration, side by side."""
    n = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.concatenate([np.divide(vectors, n, out=np.zeros_like(vectors, float), where=n > 0), scores[:, None], times[:, None] / duration], 1)


class SetValueHead:
    """Frames through two GELU layers; mean and maximum over the frames of a set; a linear score."""

    def __init__(self, size: int, hidden: tuple[int, int] = (128, 64), seed: int = 2027):
        rng = np.random.default_rng(seed)
        a, b = hidden
        self.p = {"w1": rng.normal(0, size**-0.5, (size, a)), "b1": np.zeros(a), "w2": rng.normal(0, a**-0.5, (a, b)), "b2": np.zeros(b), "w3": rng.normal(0, (2 * b) ** -0.5, 2 * b), "b3": np.zeros(1)}

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Scores of sets x (set, frame, feature) with a mask of frames."""
        p = self.p
        h1, d1 = gelu(x @ p["w1"] + p["b1"])
        h2, d2 = gelu(h1 @ p["w2"] + p["b2"])
        m = mask[:, :, None]
        n = np.maximum(mask.sum(1), 1)[:, None]
        top = np.where(m, h2, -np.inf)
        at = top.argmax(1)
        best = np.take_along_axis(h2, at[:, None, :], 1)[:, 0]
        pool = np.concatenate([(h2 * m).sum(1) / n, best], 1)
        return pool @ p["w3"] + p["b3"][0], (x, h1, d1, h2, d2, m, n, at, pool)

    def backward(self, ds: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
        x, h1, d1, h2, d2, m, n, at, pool = kept
        p, b = self.p, h2.shape[2]
        dpool = ds[:, None] * p["w3"]
        dh2 = dpool[:, None, :b] * m / n[:, :, None]
        extra = np.zeros_like(dh2)
        np.put_along_axis(extra, at[:, None, :], dpool[:, None, b:], 1)
        dz2 = (dh2 + extra) * d2
        dz1 = (dz2 @ p["w2"].T) * d1
        flat = lambda v: v.reshape(-1, v.shape[-1])
        return {"w3": ds @ pool, "b3": np.array([ds.sum()]), "w2": flat(h1).T @ flat(dz2), "b2": flat(dz2).sum(0), "w1": flat(x).T @ flat(dz1), "b1": flat(dz1).sum(0)}


def preference_loss(scores: np.ndarray, labels: np.ndarray, question: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean over questions of the mean softplus(-(right - wrong)) over pairs, and its slope; questions without both labels don't count."""
    slope, losses, used = np.zeros(len(scores)), [], []
    for q in np.unique(question):
        pos, neg = np.flatnonzero((question == q) & (labels == 1)), np.flatnonzero((question == q) & (labels == 0))
        if len(pos) and len(neg):
            d = scores[pos][:, None] - scores[neg][None, :]
            losses.append(np.logaddexp(0, -d).mean())
            used.append((pos, neg, -1 / (1 + np.exp(d)) / d.size))
    for pos, neg, g in used:
        slope[pos] += g.sum(1) / len(used)
        slope[neg] -= g.sum(0) / len(used)
    return float(np.mean(losses)) if losses else 0.0, slope


def train(x: np.ndarray, mask: np.ndarray, labels: np.ndarray, question: np.ndarray, epochs: int = 20, batch: int = 32, rate: float = 1e-3, decay: float = 1e-4, seed: int = 2027) -> SetValueHead:
    """AdamW over batches of questions."""
    head, rng = SetValueHead(x.shape[2], seed=seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in head.p.items()} for _ in range(2))
    t = 0
    for _ in range(epochs):
        qs = rng.permutation(np.unique(question))
        for at in range(0, len(qs), batch):
            rows = np.flatnonzero(np.isin(question, qs[at : at + batch]))
            s, kept = head.forward(x[rows], mask[rows])
            _, ds = preference_loss(s, labels[rows], question[rows])
            t += 1
            for k, g in head.backward(ds, kept).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                head.p[k] -= rate * (first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8) + decay * head.p[k])
    return head


def choose(scores: np.ndarray, order: np.ndarray, band: float = 1e-8) -> int:
    """The largest score; within the band of it, the first by source order."""
    near = np.flatnonzero(scores >= scores.max() - band)
    return int(near[np.argmin(order[near])])
