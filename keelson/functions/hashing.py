"""Perceptual hashes."""

from __future__ import annotations

import numpy as np


def cosine_basis(n: int) -> np.ndarray:
    """Rows of the DCT-II of n values."""
    k, i = np.mgrid[:n, :n]
    return np.cos(np.pi * k * (2 * i + 1) / (2 * n))


def perceptual_hash(gray: np.ndarray) -> int:
    """64 bits of a 32 x 32 gray image: which of the 8 x 8 lowest cosine terms exceed their median; the first bit is 0."""
    c = cosine_basis(32)[:8]
    low = (c @ np.asarray(gray, float) @ c.T).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return int("".join("1" if b else "0" for b in bits), 2)
