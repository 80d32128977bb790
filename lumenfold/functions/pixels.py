"""Fingerprints and features of decoded images, in Arrow batches of numpy.

Decoding of image files needs a library that is optional; these functions begin at decoded luma and colour.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE, LOW, CHROMA = 32, 8, 8
SIG_BYTES = SIDE * SIDE + 2 * CHROMA * CHROMA


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


FEATURE_NAMES = ("lap_var", "luma_mean", "luma_std", "luma_p02", "luma_p98", "frac_dark", "frac_bright", "flat_frac", "colorfulness")
FINGERPRINT = T.StructType([T.StructField("phash64", T.LongType()), T.StructField("sig", T.BinaryType()), *_doubles(*FEATURE_NAMES).fields, T.StructField("err", T.StringType())])


def dct_matrix(n: int = SIDE) -> np.ndarray:
    """Orthonormal DCT-II."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    m = np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def phash(luma: np.ndarray) -> int:
    """64-bit hash of 32 by 32 luma as a signed integer: bit i is set where low frequency i exceeds their median, bit 0 the mean."""
    d = dct_matrix()
    low = (d @ luma.astype(np.float64) @ d.T)[:LOW, :LOW].ravel()
    return int(np.packbits(low > np.median(low), bitorder="little").view(np.int64)[0])


def area_weights(n: int, side: int) -> np.ndarray:
    """(side, n): which share of each of n pixels falls into each of `side` equal cells, rows summing to one."""
    edges = np.arange(side + 1) * n / side
    lo, hi = np.maximum(edges[:-1, None], np.arange(n)), np.minimum(edges[1:, None], np.arange(1, n + 1))
    return np.maximum(hi - lo, 0) * side / n


def area_means(plane: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """A plane averaged onto rows by cols cells, pixels on a border shared by area."""
    return area_weights(plane.shape[0], rows) @ plane.astype(np.float64) @ area_weights(plane.shape[1], cols).T


def to_byte(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


# Luma and the two colour differences of the JPEG standard.
YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])


def luma_of(rgb: np.ndarray) -> np.ndarray:
    """Luma of an RGB image in whole steps."""
    return to_byte(rgb.astype(np.float64) @ YCC[0])


def signature(rgb: np.ndarray) -> bytes:
    """32 by 32 luma and 8 by 8 of each chroma, area means, one byte a value."""
    cb, cr = (to_byte(128 + rgb.astype(np.float64) @ w) for w in YCC[1:])
    return b"".join(to_byte(area_means(p, n, n)).tobytes() for p, n in ((luma_of(rgb), SIDE), (cb, CHROMA), (cr, CHROMA)))


def lanczos_weights(n: int, size: int, lobes: int = 3) -> np.ndarray:
    """(size, n): weights of a Lanczos reduction, the kernel widened by the reduction and cut at the borders."""
    scale = max(n / size, 1.0)
    centre = (np.arange(size)[:, None] + 0.5) * n / size
    x = (np.arange(n)[None, :] + 0.5 - centre) / scale
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def reduced(h: int, w: int, edge: int) -> tuple[int, int]:
    """The size with a long edge of at most `edge`; small images stay."""
    scale = min(1.0, edge / max(h, w))
    return max(1, round(h * scale)), max(1, round(w * scale))


def sig_distances(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of signatures: mean luma difference, that of the worst 8 by 8 block, and the largest chroma difference."""
    gap = np.abs(a.astype(np.int16) - b.astype(np.int16))
    luma, colour = np.split(gap, [SIDE * SIDE], axis=1)
    # Sums over the rows of pixels of a block, then over its columns.
    sums = np.add.reduceat(np.add.reduceat(luma.reshape(-1, SIDE, SIDE).astype(np.int64), range(0, SIDE, 8), axis=1), range(0, SIDE, 8), axis=2)
    return sums.sum(axis=(1, 2)) / (SIDE * SIDE), sums.max(axis=(1, 2)) / 64, colour.max(axis=1).astype(np.float64)


def _rows(s: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    good = s.map(lambda v: v is not None and len(v) == SIG_BYTES).to_numpy(bool)
    return good, np.frombuffer(b"".join(bytes(v) for v in s[good]), np.uint8).reshape(-1, SIG_BYTES)


@F.pandas_udf(_doubles("mad", "block", "chroma"))
def sig_metrics(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """sig_distances of two signature columns; nulls where one is missing or of another size."""
    both = a.map(lambda v: v is not None and len(v) == SIG_BYTES) & b.map(lambda v: v is not None and len(v) == SIG_BYTES)
    out = np.full((len(a), 3), np.nan)
    if both.any():
        out[both.to_numpy()] = np.stack(sig_distances(_rows(a[both])[1], _rows(b[both])[1]), axis=1)
    frame = pd.DataFrame(out, columns=["mad", "block", "chroma"])
    return frame.astype(object).where(frame.notna(), None)


@F.pandas_udf(T.DoubleType())
def sig_luma_std(s: pd.Series) -> pd.Series:
    """Population deviation of a signature's luma; null without one."""
    good, rows = _rows(s)
    out = pd.Series([None] * len(s), dtype=object)
    out[good] = rows[:, : SIDE * SIDE].astype(np.float64).std(axis=1)
    return out.astype(float)


# The long edges at which sharpness and the statistics are measured.
SHARP_EDGE, STATS_EDGE = 512, 128


def features(rgb: np.ndarray) -> dict[str, float]:
    """Sharpness at a long edge of 512 pixels; brightness, flatness and colour at 128; smaller images as they are."""
    h, w = rgb.shape[:2]
    y = luma_of(rgb)
    rows, cols = reduced(h, w, SHARP_EDGE)
    sharp = y.astype(np.float64) if (rows, cols) == (h, w) else to_byte(lanczos_weights(h, rows) @ y @ lanczos_weights(w, cols).T).astype(np.float64)
    inner = sharp[1:-1, 1:-1]
    lap = sharp[:-2, 1:-1] + sharp[2:, 1:-1] + sharp[1:-1, :-2] + sharp[1:-1, 2:] - 4 * inner if min(sharp.shape) > 2 else np.zeros(0)
    rows, cols = reduced(h, w, STATS_EDGE)
    small = rgb if (rows, cols) == (h, w) else np.stack([to_byte(area_means(rgb[..., i], rows, cols)) for i in range(3)], axis=-1)
    tones = luma_of(small).astype(np.float64)
    share = lambda mask: float(mask.mean())
    red, green, blue = np.moveaxis(small.astype(np.float64), -1, 0)
    opponents = np.stack([red - green, (red + green) / 2 - blue]).reshape(2, -1)
    return {
        "lap_var": float(lap.var()) if lap.size else 0.0,
        "luma_mean": float(tones.mean()),
        "luma_std": float(tones.std()),
        "luma_p02": float(np.quantile(tones, 0.02)),
        "luma_p98": float(np.quantile(tones, 0.98)),
        "frac_dark": share(tones < 20),
        "frac_bright": share(tones > 245),
        "flat_frac": float(np.bincount((tones // 8).astype(int).ravel()).max() / tones.size),
        "colorfulness": float(np.sqrt(opponents.var(axis=1).sum()) + 0.3 * np.sqrt((opponents.mean(axis=1) ** 2).sum())),
    }


@F.pandas_udf(FINGERPRINT)
def fingerprint(rgb: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """Hash, signature and features of raw RGB bytes; what can't be read gives nulls and the kind of error."""
    rows = []
    for data, w, h in zip(rgb, width, height, strict=True):
        try:
            image = np.frombuffer(data, np.uint8).reshape(int(h), int(w), 3)
            sig = signature(image)
            work = to_byte(lanczos_weights(int(h), SIDE) @ luma_of(image) @ lanczos_weights(int(w), SIDE).T)
            rows.append({"phash64": phash(work), "sig": sig, **features(image), "err": None})
        except (TypeError, ValueError) as e:
            rows.append({"err": type(e).__name__})
    frame = pd.DataFrame(rows, columns=FINGERPRINT.names)
    frame["phash64"] = frame["phash64"].astype("Int64") if len(frame) else frame["phash64"]
    return frame
