"""Hilbert keys of projected vectors, in numpy."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer cells (n, dims), dims * bits up to 62, as int64.

    The transpose form of the curve index is made by undoing the rotations bit by bit, then Gray decoding.
    """
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        top, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            on = (x[i] & top) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[dims - 1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


class Curve:
    """One shifted curve: a random orthogonal projection to a few dimensions, a random shift, and the curve's key."""

    def __init__(self, seed: int, width: int, dims: int, bits: int) -> None:
        rng = np.random.default_rng(seed)
        self.dims, self.bits = min(dims, width), bits
        self.axes = np.linalg.qr(rng.normal(size=(width, width)))[0][:, : self.dims]
        # A unit vector's projection on an axis has a spread of 1 / sqrt(width); five spreads fill the grid.
        self.scale = (1 << bits) / (5 / np.sqrt(width))
        self.shift = (1 << bits) / 2 + rng.uniform(-0.5, 0.5, self.dims) * (1 << bits) / 5

    def keys(self, unit: np.ndarray) -> np.ndarray:
        cells = np.clip(np.floor(unit @ self.axes * self.scale + self.shift), 0, (1 << self.bits) - 1)
        return hilbert_keys(cells.astype(np.int64), self.bits)
