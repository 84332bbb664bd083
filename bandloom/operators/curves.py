"""Continuum of spectra and resampling to other bands."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from bandloom.operators import kernels
from bandloom.operators.linear import LinearTransform


def hull(y: np.ndarray, bands: np.ndarray) -> list[int]:
    """Places of the upper convex hull from the first band to the last; points on a chord are none."""
    keep: list[int] = []
    for i in range(len(y)):
        while len(keep) > 1:
            a, b = keep[-2], keep[-1]
            if (y[b] - y[a]) * (bands[i] - bands[a]) > (y[i] - y[a]) * (bands[b] - bands[a]):
                break
            keep.pop()
        keep.append(i)
    return keep


def _segmented(y: np.ndarray, bands: np.ndarray) -> list[int]:
    """The hull, refined between hull points five or more bands apart.

    There, local maxima are kept that rise from the lower end on, each above the
    one kept before, and every stretch between kept ones gets a hull of its own.
    A stretch of two bands before a kept maximum has none.
    """
    base = hull(y, bands)
    out = set(base)
    for a, b in zip(base, base[1:], strict=False):
        if b - a < 5:
            continue
        peaks = [i for i in range(a + 1, b) if y[i] >= y[i - 1] and y[i] >= y[i + 1]]
        rising = y[b] >= y[a]
        kept, level = [], y[a] if rising else y[b]
        for i in peaks if rising else peaks[::-1]:
            if y[i] > level:
                kept.append(i)
                level = y[i]
        if kept:
            ends = [a, *sorted(kept), b]
            for p, q in zip(ends, ends[1:], strict=False):
                if q - p > 2 or q == b:
                    out.update(p + k for k in hull(y[p : q + 1], bands[p : q + 1]))
                out.add(q)
    return sorted(out)


def points(y: np.ndarray, bands: Sequence[float], mode: str = "convex") -> list[int]:
    x = np.asarray(bands, float)
    return _segmented(np.asarray(y, float), x) if mode == "segmented" else hull(np.asarray(y, float), x)


def _continuum(x: np.ndarray, bands: np.ndarray, mode: str) -> np.ndarray:
    out = np.empty_like(x)
    for i, y in enumerate(x):
        k = points(y, bands, mode)
        out[i] = np.interp(bands, bands[k], y[k])
    return out


def continuum(pixels: DataFrame, bands: Sequence[float], mode: str = "convex", spectrum: str = "spectrum", out: str = "continuum") -> DataFrame:
    """The curve over each spectrum, in doubles; ``mode`` is convex or segmented. Bands must rise."""
    b = _checked(bands, mode)
    return kernels.append(pixels, spectrum, {out: "array<double>"}, lambda x: (_continuum(x, b, mode),))


def remove_continuum(pixels: DataFrame, bands: Sequence[float], mode: str = "convex", spectrum: str = "spectrum", out: str = "removed") -> DataFrame:
    b = _checked(bands, mode)

    def divide(x: np.ndarray) -> tuple[np.ndarray]:
        with np.errstate(divide="ignore", invalid="ignore"):
            return (x / _continuum(x, b, mode),)

    return kernels.append(pixels, spectrum, {out: "array<double>"}, divide)


def _checked(bands: Sequence[float], mode: str) -> np.ndarray:
    b = np.asarray(bands, float)
    if mode not in ("convex", "segmented"):
        raise ValueError("mode must be convex or segmented")
    if np.any(np.diff(b) <= 0):
        raise ValueError("bands must rise")
    return b


def build_fwhm(centers: Sequence[float]) -> np.ndarray:
    """Widths from the spacing of the centers: the mean of both sides, or the one side at the ends."""
    d = np.abs(np.diff(np.asarray(centers, float)))
    return np.concatenate([d[:1], (d[1:] + d[:-1]) / 2, d[-1:]])


def normal(mean: float, std: float, x: np.ndarray | float) -> np.ndarray:
    """The density of a normal distribution."""
    z = (np.asarray(x, float) - mean) / std
    return np.exp(-z * z / 2) / (std * math.sqrt(2 * math.pi))


def _phi(x: float) -> float:
    return (1 + math.erf(x / math.sqrt(2))) / 2


def resampling_matrix(centers1: Sequence[float], centers2: Sequence[float], fwhm1: Sequence[float] | None = None, fwhm2: Sequence[float] | None = None) -> np.ndarray:
    """Weights of the bands 1 in the bands 2: the share of the target's Gaussian where their widths overlap.

    A target that overlaps no band has NaN in its first column.
    """
    c1, c2 = np.asarray(centers1, float), np.asarray(centers2, float)
    w1, w2 = (build_fwhm(c) if w is None else np.asarray(w, float) for c, w in ((c1, fwhm1), (c2, fwhm2)))
    m = np.zeros((len(c2), len(c1)))
    for i, (c, w) in enumerate(zip(c2, w2, strict=True)):
        sigma = w / 2.3548
        lo, hi = np.maximum(c1 - w1 / 2, c - w / 2), np.minimum(c1 + w1 / 2, c + w / 2)
        for j in np.flatnonzero(lo <= hi):
            m[i, j] = _phi((hi[j] - c) / sigma) - _phi((lo[j] - c) / sigma)
        total = m[i].sum()
        if total > 0:
            m[i] /= total
        else:
            m[i, 0] = np.nan
    return m


def band_resampler(centers1: Sequence[float], centers2: Sequence[float], fwhm1: Sequence[float] | None = None, fwhm2: Sequence[float] | None = None) -> LinearTransform:
    return LinearTransform(resampling_matrix(centers1, centers2, fwhm1, fwhm2))
