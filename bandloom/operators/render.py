"""Colours of images, without a window to show them."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bandloom.operators.pixels import cdf_points


#: The colours of classes from 0 on.
CLASS_COLORS = (
    (0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0), (255, 0, 255), (0, 255, 255),
    (200, 100, 0), (0, 200, 100), (100, 0, 200), (200, 0, 100), (100, 200, 0), (0, 100, 200),
    (150, 75, 75), (75, 150, 75), (75, 75, 150), (255, 100, 100), (100, 255, 100), (100, 100, 255),
    (255, 150, 75), (75, 255, 150), (150, 75, 255),
    (50, 50, 50), (100, 100, 100), (150, 150, 150), (200, 200, 200), (250, 250, 250),
    (100, 0, 0), (200, 0, 0), (0, 100, 0), (0, 200, 0), (0, 0, 100), (0, 0, 200),
    (100, 100, 0), (200, 200, 0), (100, 0, 100), (200, 0, 200), (0, 100, 100), (0, 200, 200),
)
#: Levels and colours of the default scale.
SCALE_LEVELS = (0.0, 10.0, 20.0, 30.0, 40.0, 50.0)
SCALE_COLORS = ((0, 0, 0), (0, 0, 255), (0, 255, 0), (255, 0, 0), (255, 255, 0), (255, 255, 255))
#: Pixels of a picture that may go to the driver.
PICTURE_PIXELS = 64_000_000


def default_bands(n: int, meta: dict | None = None) -> list[int]:
    """The header's default bands, else the first, the middle and the last; one band of few."""
    if meta and "default bands" in meta:
        return [int(float(b)) - 1 for b in meta["default bands"]]
    return [0, n // 2, n - 1] if n >= 3 else [0]


def get_rgb(pixels: DataFrame, bands: Sequence[int], stretch: float | tuple = (0.0, 1.0), bounds: Sequence | None = None, mask: DataFrame | None = None, background: tuple[float, float, float] = (0.0, 0.0, 0.0), spectrum: str = "spectrum", stretch_all: bool = True, ignore: float | None = None) -> DataFrame:
    """rgb(row, col, r, g, b) in [0, 1]: each band between its limits, which are the points ``stretch`` of its distribution.

    ``stretch`` is a pair, a pair a band, or the share cut off at both ends;
    ``bounds`` are limits in the unit of the data, one pair or one a band. Without
    ``stretch_all`` the least and the greatest limit hold for all bands. Values
    equal to ``ignore`` don't count for the limits. A single band gives grey.
    Equal limits give 0. Pixels whose mask is 0 have the background colour; they
    still count for the limits.
    """
    value = lambda b: F.get(F.col(spectrum), F.lit(int(b))).cast("double")
    if bounds is not None:
        limits = [tuple(bounds)] * len(bands) if np.ndim(bounds) == 1 else [tuple(b) for b in bounds]
    else:
        if np.ndim(stretch) == 0 and not 0 <= stretch <= 1:
            raise ValueError("stretch must be between 0 and 1")
        ends = (stretch, 1 - stretch) if np.ndim(stretch) == 0 else stretch
        each = [tuple(ends)] * len(bands) if np.ndim(ends) == 1 else [tuple(e) for e in ends]
        if np.ndim(ends) == 2 and not stretch_all:
            raise ValueError("a common stretch can't differ by band")
        limits = [tuple(cdf_points(pixels.select(value(b).alias("v")), "v", e, ignore)) for b, e in zip(bands, each, strict=True)]
        if not stretch_all:
            limits = [(min(a for a, _ in limits), max(b for _, b in limits))] * len(bands)

    def scaled(b: int, lo: float, hi: float) -> Column:
        return F.lit(0.0) if hi == lo else F.least(F.greatest((value(b) - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))

    cols = [scaled(b, *limit) for b, limit in zip(bands, limits, strict=True)]
    cols = cols * 3 if len(cols) == 1 else cols
    out = pixels.select("row", "col", *[c.alias(n) for c, n in zip(cols, "rgb", strict=True)])
    if mask is None:
        return out
    shown = F.coalesce(F.col("class_id"), F.lit(0)) != 0
    return out.join(mask.select("row", "col", "class_id"), ["row", "col"], "left").select("row", "col", *[F.when(shown, F.col(n)).otherwise(v).alias(n) for n, v in zip("rgb", background, strict=True)])


def palette(n: int) -> list[tuple[int, int, int]]:
    """The first ``n`` colours of classes; beyond the fixed ones they start again."""
    return [CLASS_COLORS[i % len(CLASS_COLORS)] for i in range(n)]


def colour_classes(classes: DataFrame, colors: Sequence[Sequence[int]] = CLASS_COLORS) -> DataFrame:
    """rgb(row, col, r, g, b) of a class map, 0 to 255; ids beyond the table are black."""
    table = [F.array(*[F.lit(int(c[i])) for c in colors]) for i in range(3)]
    return classes.select("row", "col", *[F.coalesce(F.get(t, F.col("class_id")), F.lit(0)).alias(n) for t, n in zip(table, "rgb", strict=True)])


class ColorScale:
    """Colours at levels, linear between them (fractions cut off), in ``ticks`` steps, or one a level if it is 0."""

    def __init__(self, levels: Sequence[float], colors: Sequence[Sequence[int]], ticks: int = 0):
        self.low, self.high = float(levels[0]), float(levels[-1])
        if len(levels) != len(colors) or (ticks or len(colors)) < 2:
            raise ValueError("a colour a level and two steps at least")
        at = np.linspace(self.low, self.high, ticks or len(colors))
        self.table = np.floor(np.stack([np.interp(at, levels, [c[i] for c in colors]) for i in range(3)], axis=1) + 1e-9).astype(int)
        self.background = (0, 0, 0)

    def set_range(self, low: float, high: float) -> None:
        self.low, self.high = low, high

    def set_background(self, color: Sequence[int]) -> None:
        self.background = tuple(color)

    def __call__(self, v: float) -> tuple[int, int, int]:
        if v < self.low:
            return self.background
        i = int((v - self.low) / (self.high - self.low) * len(self.table))
        return tuple(int(x) for x in self.table[min(i, len(self.table) - 1)])

    def colour(self, values: DataFrame, column: str) -> DataFrame:
        n = len(self.table)
        i = F.least(F.floor((F.col(column) - self.low) / (self.high - self.low) * n).cast("int"), F.lit(n - 1))
        pick = [F.when(F.col(column) < self.low, int(self.background[k])).otherwise(F.get(F.array(*[F.lit(int(v)) for v in self.table[:, k]]), i)) for k in range(3)]
        return values.select("row", "col", *[c.alias(n) for c, n in zip(pick, "rgb", strict=True)])


def default_scale(ticks: int = 0) -> ColorScale:
    """Black, blue, green, red, yellow, white from 0 to 50; ``ticks`` colours in all, or 0 for no ones in between."""
    if ticks and ticks < len(SCALE_COLORS):
        raise ValueError(f"ticks must be 0 or at least {len(SCALE_COLORS)}")
    return ColorScale(SCALE_LEVELS, SCALE_COLORS, ticks)


def png(picture: np.ndarray) -> bytes:
    """A picture (row, col, 3) of bytes as a PNG file."""
    h, w, _ = picture.shape
    raw = np.zeros((h, 1 + 3 * w), np.uint8)
    raw[:, 1:] = picture.reshape(h, -1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")


def _bytes(rgb: DataFrame, unit: bool) -> DataFrame:
    return rgb.select("row", "col", *[F.floor(F.coalesce(F.least(F.greatest(F.col(c) * (255 if unit else 1), F.lit(0)), F.lit(255)), F.lit(0))).cast("int").alias(c) for c in "rgb"])


def _filled(t: pa.Table, shape: tuple[int, int], r0: int = 0, c0: int = 0) -> np.ndarray:
    out = np.zeros((*shape, 3), np.uint8)
    out[t.column("row").to_numpy() - r0, t.column("col").to_numpy() - c0] = np.column_stack([t.column(c).to_numpy() for c in "rgb"])
    return out


def make_picture(rgb: DataFrame, unit: bool = True) -> np.ndarray:
    """rgb(row, col, r, g, b) as an array (row, col, 3) of bytes; ``unit``: colours are in [0, 1], not up to 255.

    The size is counted first: beyond PICTURE_PIXELS it raises ValueError, and ``save_tiles`` writes the picture in parts. Missing pixels are black.
    """
    size = rgb.agg(F.max("row"), F.max("col")).first()
    if size[0] is None:
        return np.zeros((0, 0, 3), np.uint8)
    shape = (size[0] + 1, size[1] + 1)
    if shape[0] * shape[1] > PICTURE_PIXELS:
        raise ValueError("too large for one picture; use save_tiles")
    return _filled(_bytes(rgb, unit).toArrow(), shape)


def save_rgb(path: str, rgb: DataFrame, unit: bool = True) -> None:
    """rgb(row, col, r, g, b) as a PNG file."""
    with open(path, "wb") as f:
        f.write(png(make_picture(rgb, unit)))


def save_tiles(folder: str, rgb: DataFrame, tile: int = 1024, unit: bool = True) -> DataFrame:
    """A PNG file for each tile of ``tile`` pixels a side in ``folder``, which all executors must share; written by the tasks.

    Gives (tile_row, tile_col, path). A file is written under another name first, so a task that runs again does no harm.
    """
    os.makedirs(folder, exist_ok=True)
    at = _bytes(rgb, unit).withColumn("tile_row", F.floor(F.col("row") / tile).cast("int")).withColumn("tile_col", F.floor(F.col("col") / tile).cast("int"))

    def write(key: tuple, t: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key)
        h, w = (int(t.column(c).to_numpy().max()) - k * tile + 1 for c, k in (("row", i), ("col", j)))
        path = os.path.join(folder, f"tile-{i}-{j}.png")
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(png(_filled(t, (h, w), i * tile, j * tile)))
        os.replace(part, path)
        return pa.table({"tile_row": pa.array([i], pa.int32()), "tile_col": pa.array([j], pa.int32()), "path": [path]})

    return at.groupBy("tile_row", "tile_col").applyInArrow(write, "tile_row int, tile_col int, path string")


def scaled_bands(pixels: DataFrame, spectrum: str = "spectrum") -> DataFrame:
    """Each band stretched to [0, 1] by its least and greatest value; a flat band is 0."""
    from bandloom.operators.stats import min_max

    limits = min_max(pixels, spectrum)
    lo, span = F.array(*[F.lit(a) for a, _ in limits]), F.array(*[F.lit(b - a) for a, b in limits])
    return pixels.withColumn(spectrum, F.transform(F.arrays_zip(F.col(spectrum).alias("v"), lo.alias("lo"), span.alias("span")), lambda x: F.coalesce(F.try_divide(x["v"] - x["lo"], x["span"]), F.lit(0.0))))
