"""Cutting a shelf image into one strip per book, and preparing strips: numpy over whole images, one image per row.

Choosing cuts is greedy (the strongest first, none too near an accepted one), so it runs per image in a vectorized UDF.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StructField, StructType

# Widths and levels in relative units or grey levels.
LEAST_BAND, MOST_BANDS, BAND_PAD = 0.02, 36, 0.08
EDGE_LEVEL, LEAST_EDGE, GROOVE_DEPTH, LEAST_GROOVE, EDGE_WEIGHT, GROOVE_WEIGHT = 18, 0.45, 10, 0.5, 0.6, 0.4
TARGET_WIDTH, MOST_SCALE, MOST_PIXELS, CLIP, LEAST_SPAN = 160, 3, 2_400_000, 0.02, 8
BANDS = ArrayType(StructType([StructField("start", DoubleType()), StructField("end", DoubleType())]))


def _round(x: float) -> int:
    return int(np.floor(x + 0.5))


def edge_share(image: np.ndarray) -> np.ndarray:
    """Per column, the share of rows with a step of EDGE_LEVEL or more to the right neighbour."""
    steps = np.abs(np.diff(image.astype(int), axis=1)) >= EDGE_LEVEL
    return np.append(steps.mean(axis=0), 0.0)


def groove_share(image: np.ndarray, radius: int, depth: int = GROOVE_DEPTH) -> np.ndarray:
    """Per column, the share of rows darker by `depth` than both columns `radius` away."""
    g, out = image.astype(int), np.zeros(image.shape[1])
    if g.shape[1] > 2 * radius:
        inner = g[:, radius:-radius] + depth
        out[radius:-radius] = ((inner <= g[:, : -2 * radius]) & (inner <= g[:, 2 * radius :])).mean(axis=0)
    return out


def _level(values: np.ndarray) -> np.ndarray:
    """Smoothed over direct neighbours, then between 0 and 1."""
    ones = np.ones(3)
    smooth = np.convolve(values, ones, "same") / np.convolve(np.ones(len(values)), ones, "same")
    span = smooth.max() - smooth.min()
    return (smooth - smooth.min()) / span if span > 1e-9 else np.zeros(len(values))


def bands_of(image: np.ndarray, least: float = LEAST_BAND, most: int = MOST_BANDS) -> list[tuple[float, float]]:
    h, w = image.shape
    if w < 8 or h < 8:
        return []
    apart = max(2, _round(least * w))
    edge, groove = edge_share(image), groove_share(image, max(2, _round(apart / 2)))
    score = EDGE_WEIGHT * _level(edge) + GROOVE_WEIGHT * _level(groove)
    strong = (edge >= LEAST_EDGE) | (groove >= LEAST_GROOVE)
    strong = strong | np.append(strong[1:], False) | np.insert(strong[:-1], 0, False)
    reach, peaks = max(1, apart // 2), []
    for x in np.flatnonzero(strong[: w - apart + 1]):
        if x >= apart:
            left, right = score[max(0, x - reach) : x], score[x + 1 : x + reach + 1]
            if (left < score[x]).all() and (right <= score[x]).all():
                peaks.append(int(x))
    cuts: list[int] = []
    for x in sorted(peaks, key=lambda p: -score[p]):
        if len(cuts) < max(1, most) - 1 and all(abs(c - x) >= apart for c in cuts):
            cuts.append(x)
    ends = [0, *sorted(cuts), w]
    return [(a / w, b / w) for a, b in zip(ends, ends[1:])]


def prepared(image: np.ndarray, clip: float = CLIP) -> np.ndarray:
    """Contrast stretched between the clipped ends, then inverted if most of it is dark."""
    flat = np.sort(image, axis=None)
    cut = int(np.floor(flat.size * clip))
    low, high = (int(flat[min(cut, flat.size - 1)]), int(flat[max(flat.size - 1 - cut, 0)])) if flat.size else (0, 0)
    out = image if high - low < LEAST_SPAN else np.clip(np.rint((image.astype(float) - low) * 255 / (high - low)), 0, 255).astype(np.uint8)
    if out.size and (out <= threshold_of(out)).mean() > 0.5:
        out = 255 - out
    return out


def threshold_of(image: np.ndarray) -> int:
    n = np.bincount(image.reshape(-1), minlength=256).astype(float)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    ok = (below > 0) & (below < below[-1])
    if not ok.any():
        return 128
    between = np.zeros(256)
    between[ok] = below[ok] * (below[-1] - below[ok]) * (mass[ok] / below[ok] - (mass[-1] - mass[ok]) / (below[-1] - below[ok])) ** 2
    return int(between.argmax())


def _image(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(-1, max(1, int(width)))


def segment(data: Column, width: Column) -> Column:
    """array<struct<start, end>> of a grey image given as bytes in rows."""

    @F.pandas_udf(BANDS)
    def cut(images: pd.Series, widths: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else [{"start": a, "end": b} for a, b in bands_of(_image(d, w))] for d, w in zip(images, widths)])

    return cut(data, width)


def prepare_strip(data: Column, width: Column) -> Column:
    @F.pandas_udf(BinaryType())
    def ready(images: pd.Series, widths: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else prepared(_image(d, w)).tobytes() for d, w in zip(images, widths)])

    return ready(data, width)


def pad_band(start: Column, end: Column, ratio: float = BAND_PAD) -> tuple[Column, Column]:
    pad = (end - start) * ratio
    return F.greatest(F.lit(0.0), start - pad), F.least(F.lit(1.0), end + pad)


def strip_scale(width: Column, height: Column) -> Column:
    """The whole-number enlargement that reaches the target width within the pixel budget."""
    want = F.least(F.lit(MOST_SCALE), F.greatest(F.lit(1), F.ceil(TARGET_WIDTH / width))).cast("int")
    fits = lambda k: (want >= k) & (width * k * height * k <= MOST_PIXELS)
    return F.when((width < 1) | (height < 1), 1).when(fits(3), 3).when(fits(2), 2).otherwise(1)


def to_frame_box(x: Column, width: Column, band_start: Column, band_end: Column) -> tuple[Column, Column]:
    """(x, width) in the frame of a box inside a band."""
    return band_start + x * (band_end - band_start), width * (band_end - band_start)
