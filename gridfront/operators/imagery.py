"""Visual richness of image patches: corner response and local entropy, one numpy kernel a patch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfront.functions.scalars import noisy_or
from gridfront.operators.raster import robust_normalize


def box_mean(a: np.ndarray, size: int) -> np.ndarray:
    """Mean over a square window with reflected borders."""
    r = size // 2
    p = np.pad(a, r, mode="symmetric")
    return np.lib.stride_tricks.sliding_window_view(p, (size, size)).mean(axis=(2, 3))


def corner_response(a: np.ndarray, window: int = 7) -> np.ndarray:
    """Least eigenvalue of the averaged gradient tensor (Sobel gradients)."""
    p = np.pad(a.astype(float), 1, mode="symmetric")
    along = lambda q: q[2:] - q[:-2]
    smooth = lambda q: q[2:] + 2 * q[1:-1] + q[:-2]
    iy, ix = along(smooth(p.T).T), along(smooth(p).T).T
    xx, yy, xy = box_mean(ix * ix, window), box_mean(iy * iy, window), box_mean(ix * iy, window)
    trace, det = xx + yy, xx * yy - xy * xy
    return 0.5 * (trace - np.sqrt(np.maximum(trace * trace - 4 * det, 0)))


def disk_entropy(a: np.ndarray, radius: int = 5) -> np.ndarray:
    """Entropy in bits of the grey levels within a disk, clipped at the border.

    The levels under each place of the disk are stacked and sorted by pixel; the length of each level's run comes from
    a pass in either direction over the stack, whole images at a time.
    """
    h, w = a.shape
    yy, xx = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    offsets = np.argwhere(yy * yy + xx * xx <= radius * radius)
    outside = 256
    p = np.pad(a.astype(np.int16), radius, constant_values=outside)
    levels = np.sort(np.stack([p[y : y + h, x : x + w] for y, x in offsets]), axis=0)
    run = np.ones(levels.shape, np.int32)
    for k in range(1, len(levels)):
        run[k] += run[k - 1] * (levels[k] == levels[k - 1])
    for k in range(len(levels) - 2, -1, -1):
        run[k] = np.where(levels[k] == levels[k + 1], run[k + 1], run[k])
    inside = levels != outside
    n = inside.sum(axis=0)
    return (np.log2(n / run) * inside).sum(axis=0) / n


def levels(a: np.ndarray) -> np.ndarray:
    return np.clip(a, 0, 255).astype(np.uint8)


def scored(pixels: DataFrame, keys: list[str], bands: list[str], score) -> DataFrame:
    """``keys, geometry, texture`` of patches by ``score(bands)``; a patch of pixels ``px, py`` is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        geometry, texture = score(*(pdf.pivot(index="py", columns="px", values=b).to_numpy(float) for b in bands))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "geometry": [geometry], "texture": [texture]})

    kinds = dict(pixels.dtypes)
    return pixels.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", geometry double, texture double")


def patch_scores(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Greatest corner response and mean entropy of the grey levels (0 to 255)."""
    return scored(pixels, keys, ["grey"], lambda a: (float(corner_response(a).max()), float(disk_entropy(levels(a)).mean())))


def band_scores(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Greatest sum of the red and the near-infrared corner response, and mean entropy of the NDVI on 0 to 255."""

    def score(red: np.ndarray, nir: np.ndarray) -> tuple[float, float]:
        red, nir = red.astype(np.float32).astype(float), nir.astype(np.float32).astype(float)
        total = red + nir
        ndvi = np.divide(nir - red, total, out=np.zeros_like(total), where=total != 0)
        return float((corner_response(red) + corner_response(nir)).max()), float(disk_entropy(levels((ndvi + 1) * 127.5)).mean())

    return scored(pixels, keys, ["red", "nir"], score)


def localization(scores: DataFrame, grid: list[str]) -> DataFrame:
    """Adds ``richness``: noisy-or of the scores, each normalised over its grid."""
    s = robust_normalize(scores, ["geometry", "texture"], grid)
    return s.withColumn("richness", noisy_or(F.col("geometry"), F.col("texture")))


def visual_richness(pixels: DataFrame, keys: list[str], grid: list[str]) -> DataFrame:
    """``richness`` of grey patches."""
    return localization(patch_scores(pixels, keys), grid)


def band_richness(pixels: DataFrame, keys: list[str], grid: list[str]) -> DataFrame:
    """``richness`` of patches with a red and a near-infrared band."""
    return localization(band_scores(pixels, keys), grid)
