"""Functions of the window around each pixel, on halo tiles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def window_bounds(n: int, size: int, i: np.ndarray | int, clip: bool = False) -> tuple:
    """[start, stop) of the window of ``size`` around ``i``: from i - size // 2 on, moved or cut to lie in [0, n)."""
    if size > n and not clip:
        raise ValueError("the window is larger than the image")
    start = np.asarray(i) - size // 2
    if clip:
        return np.maximum(start, 0), np.minimum(start + size, n)
    start = np.clip(start, 0, n - size)
    return start, start + size


def _tiled(pixels: DataFrame, shape: tuple[int, int], halo: tuple[int, int], tile: int) -> DataFrame:
    """Each pixel once for every tile of which it may be in a window."""
    def span(name: str, n: int, h: int):  # noqa: ANN202
        last = (n - 1) // tile
        lo = F.greatest(F.floor((F.col(name) - h) / tile), F.lit(0))
        return F.sequence(lo.cast("int"), F.least(F.floor((F.col(name) + h) / tile), F.lit(last)).cast("int"))

    return pixels.withColumn("tile_r", F.explode(span("row", shape[0], halo[0]))).withColumn("tile_c", F.explode(span("col", shape[1], halo[1])))


def _by_tile(pixels: DataFrame, shape: tuple[int, int], reach: tuple[int, int], tile: int, each: Callable, width: int, out: str) -> DataFrame:
    halo = _tiled(pixels.select("row", "col", F.col("spectrum").cast("array<double>").alias("spectrum")), shape, reach, tile)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        tr, tc = (k.as_py() for k in key)
        r, c = t.column("row").to_numpy(), t.column("col").to_numpy()
        x = np.array(t.column("spectrum").combine_chunks().flatten()).reshape(len(r), -1)
        r0, c0 = r.min(), c.min()
        block = np.full((r.max() - r0 + 1, c.max() - c0 + 1, x.shape[1]), np.nan)
        block[r - r0, c - c0] = x
        mine = np.flatnonzero((r // tile == tr) & (c // tile == tc))
        got = np.asarray(each(block, int(r0), int(c0), r[mine].astype(np.int64), c[mine].astype(np.int64)), dtype=float).reshape(len(mine), width)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1, dtype=np.int32) * width), pa.array(got.ravel()))
        return pa.table({"row": pa.array(r[mine]), "col": pa.array(c[mine]), out: flat})

    return halo.groupBy("tile_r", "tile_c").applyInArrow(run, f"row int, col int, {out} array<double>")


def map_window(pixels: DataFrame, fn: Callable[[np.ndarray, tuple[int, int]], float | np.ndarray], window: int | tuple[int, int], shape: tuple[int, int], border: str = "shift", width: int = 1, out: str = "value", tile: int | None = None, rows: slice | None = None, cols: slice | None = None) -> DataFrame:
    """(row, col, out) with ``fn(block, (i, j))`` of each pixel: block is its window, (i, j) the pixel's place in it.

    ``rows`` and ``cols`` choose the pixels that get a value (slices, with steps);
    their windows still reach over the whole image. ``border`` is "shift" or "clip". Tiles of ``tile`` pixels a side are worked on
    apart, with as much around them as their windows reach, so memory is bounded by
    the tile. Missing pixels of the window are NaN.
    """
    h, w = (window, window) if isinstance(window, int) else window
    if border not in ("shift", "clip"):
        raise ValueError("border must be shift or clip")
    if border == "shift" and (h > shape[0] or w > shape[1]):
        raise ValueError("the window is larger than the image")

    chosen = [np.zeros(n, bool) for n in shape]
    for c, s in zip(chosen, (rows, cols), strict=True):
        c[s if s is not None else slice(None)] = True

    def each(block: np.ndarray, r0: int, c0: int, i: np.ndarray, j: np.ndarray) -> list:
        bounds = zip(*window_bounds(shape[0], h, i, border == "clip"), *window_bounds(shape[1], w, j, border == "clip"), i, j, strict=True)
        return [np.atleast_1d(fn(block[a - r0 : b - r0, c - c0 : d - c0], (int(p - a), int(q - c)))) if chosen[0][p] and chosen[1][q] else np.full(width, np.nan) for a, b, c, d, p, q in bounds]

    done = _by_tile(pixels, shape, (h - 1, w - 1), tile or max(32, 4 * max(h, w)), each, width, out)
    for name, s, n in (("row", rows, shape[0]), ("col", cols, shape[1])):
        if s is not None:
            done = done.where(F.col(name).isin([int(v) for v in np.arange(n)[s]]) if s.step not in (None, 1) else (F.col(name) >= s.indices(n)[0]) & (F.col(name) < s.indices(n)[1]))
    return done


def _window_sums(block: np.ndarray) -> Callable:
    """Sums of any rectangle of the block, without missing values, from one running sum."""
    run = np.zeros((block.shape[0] + 1, block.shape[1] + 1, block.shape[2]))
    run[1:, 1:] = np.nan_to_num(block).cumsum(0).cumsum(1)
    return lambda a, b, c, d: run[b, d] - run[a, d] - run[b, c] + run[a, c]


#: Bytes of windows that are gathered at once.
_GATHER_BYTES = 64 << 20


def _outer_moments(block: np.ndarray, starts: np.ndarray, inner_starts: np.ndarray, outer: int, inner: int, with_cov: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """(means, covariances) over windows less their inner windows; ``starts`` are (row, col) of windows in the block."""
    seen = np.lib.stride_tricks.sliding_window_view(block, (outer, outer), (0, 1))[starts[:, 0], starts[:, 1]]
    x = seen.transpose(0, 2, 3, 1)
    at = np.arange(outer)
    hidden = [(at >= (inner_starts[:, k] - starts[:, k])[:, None]) & (at < (inner_starts[:, k] - starts[:, k])[:, None] + inner) for k in (0, 1)]
    w = ~(hidden[0][:, :, None] & hidden[1][:, None, :]) & ~np.isnan(x).any(axis=3)
    n = w.sum(axis=(1, 2))
    x = np.where(w[..., None], x, 0.0).reshape(len(x), outer * outer, -1)
    mean = x.sum(axis=1) / np.maximum(n, 1)[:, None]
    if not with_cov:
        return mean, None
    if (n <= x.shape[2]).any():
        raise ValueError("fewer pixels than bands in the window")
    d = np.where(w.reshape(len(x), -1, 1), x - mean[:, None], 0.0)
    return mean, d.transpose(0, 2, 1) @ d / (n - 1)[:, None, None]


def map_outer_stats(pixels: DataFrame, fn: Callable[[np.ndarray, np.ndarray | None, np.ndarray], float | np.ndarray], inner: int, outer: int, shape: tuple[int, int], cov: np.ndarray | None = None, width: int = 1, out: str = "value", tile: int | None = None) -> DataFrame:
    """(row, col, out) with ``fn(mean, cov, pixel)`` over the outer window less the inner one, each moved into the image.

    With ``cov`` only the mean is local.
    """
    if inner >= outer:
        raise ValueError("the inner window must be smaller than the outer one")
    if outer > min(shape):
        raise ValueError("the window is larger than the image")

    def scored(x: np.ndarray, mean: np.ndarray, local: np.ndarray | None) -> np.ndarray:
        return np.array([fn(m, cov if local is None else local[k], p) for k, (m, p) in enumerate(zip(mean, x, strict=True))], dtype=float).reshape(len(x), width)

    return _outer(pixels, scored, inner, outer, shape, cov is None, width, out, tile)


def _outer(pixels: DataFrame, scored: Callable, inner: int, outer: int, shape: tuple[int, int], with_cov: bool, width: int, out: str, tile: int | None) -> DataFrame:
    """(row, col, out) of ``scored(pixels, means, covariances or None)``, over many windows at once."""
    def each(block: np.ndarray, r0: int, c0: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        starts = np.column_stack([window_bounds(shape[0], outer, i)[0] - r0, window_bounds(shape[1], outer, j)[0] - c0])
        inner_starts = np.column_stack([window_bounds(shape[0], inner, i)[0] - r0, window_bounds(shape[1], inner, j)[0] - c0])
        step = max(1, _GATHER_BYTES // (outer * outer * block.shape[2] * 8))
        got = [np.empty((0, width))]
        # Pixels at the rim of an image with missing rows or columns may have windows beyond the block.
        whole = np.pad(block, ((0, max(0, int(starts[:, 0].max()) + outer - block.shape[0])), (0, max(0, int(starts[:, 1].max()) + outer - block.shape[1])), (0, 0)), constant_values=np.nan) if len(i) else block
        for s in range(0, len(i), step):
            mean, local = _outer_moments(whole, starts[s : s + step], inner_starts[s : s + step], outer, inner, with_cov)
            got.append(np.asarray(scored(block[i[s : s + step] - r0, j[s : s + step] - c0], mean, local), float).reshape(-1, width))
        return np.concatenate(got)

    return _by_tile(pixels, shape, (outer - 1, outer - 1), tile or max(32, 4 * outer), each, width, out)


def windowed(pixels: DataFrame, detector: str, inner: int, outer: int, shape: tuple[int, int], target: np.ndarray | None = None, cov: np.ndarray | None = None, out: str = "score") -> DataFrame:
    """RX ("rx"), matched filter ("mf") or coherence ("ace") against the background around each pixel.

    Without ``cov`` the covariance is that of the window, too; a window needs more pixels than bands.
    """
    if detector not in ("rx", "mf", "ace"):
        raise ValueError("detector must be rx, mf or ace")
    if inner >= outer or outer > min(shape):
        raise ValueError("the inner window must be smaller than the outer one, and that no larger than the image")
    inv = None if cov is None else np.linalg.inv(cov)
    t = None if target is None else np.atleast_2d(np.asarray(target, float))

    def scored(x: np.ndarray, mean: np.ndarray, local: np.ndarray | None) -> np.ndarray:
        m = np.broadcast_to(inv, (len(x), *inv.shape)) if local is None else np.linalg.inv(local)
        d = x - mean
        near = np.einsum("ni,nij,nj->n", d, m, d)
        if detector == "rx":
            return near
        # Each pixel has its own background, so the target is whitened for each.
        u = t[None] - mean[:, None]
        mu = np.einsum("nij,nkj->nki", m, u)
        on = np.einsum("ni,nki->nk", d, mu)
        gram = np.einsum("nki,nli->nkl", mu, u)
        if detector == "mf":
            return on[:, 0] / gram[:, 0, 0]
        with np.errstate(invalid="ignore", divide="ignore"):
            part = np.einsum("nk,nkl,nl->n", on, np.linalg.pinv(gram), on) / near
        return np.clip(np.nan_to_num(part, nan=0.0), 0, 1)

    got = _outer(pixels, scored, inner, outer, shape, cov is None, 1, out, None)
    return got.select("row", "col", F.get(out, F.lit(0)).alias(out))


def window_mean(pixels: DataFrame, window: int, shape: tuple[int, int], border: str = "shift") -> DataFrame:
    """(row, col, spectrum): the mean spectrum of each window, without missing pixels."""
    if border not in ("shift", "clip"):
        raise ValueError("border must be shift or clip")
    if border == "shift" and window > min(shape):
        raise ValueError("the window is larger than the image")

    def each(block: np.ndarray, r0: int, c0: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        bounds = [np.clip(v - o, 0, n) for v, o, n in zip((*window_bounds(shape[0], window, i, border == "clip"), *window_bounds(shape[1], window, j, border == "clip")), (r0, r0, c0, c0), np.repeat(block.shape[:2], 2), strict=True)]
        there = ~np.isnan(block)
        base = np.nan_to_num(np.nanmean(block, axis=(0, 1)))
        with np.errstate(invalid="ignore", divide="ignore"):
            return base + _window_sums(np.where(there, block - base, 0.0))(*bounds) / _window_sums(there.astype(float))(*bounds)

    return _by_tile(pixels, shape, (window - 1, window - 1), max(32, 4 * window), each, _bands(pixels), "spectrum")


def _bands(pixels: DataFrame) -> int:
    first = pixels.where("spectrum is not null").select(F.size("spectrum")).first()
    return first[0] if first else 1
