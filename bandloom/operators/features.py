"""Pixels as points of a space of features, for plots of several dimensions drawn elsewhere."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from bandloom.operators.render import CLASS_COLORS, colour_classes, scaled_bands


def mirrored_octants(features: Sequence[int]) -> list[tuple[int, int, int]]:
    """The three features of each octant, of six on the half axes +x, +y, +z, -x, -y, -z: first above, then below, each counterclockwise from +x +y."""
    if len(features) != 6:
        raise ValueError("six features, one a half axis")
    x, y, z = ((features[i], features[i + 3]) for i in range(3))
    return [(x[a], y[b], z[c]) for c in (0, 1) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]


def place(index: Column | int, columns: int) -> tuple:
    """(row, col) of a pixel by its number in row-major order."""
    if isinstance(index, Column):
        return F.floor(index / columns).cast("int"), F.pmod(index, F.lit(columns)).cast("int")
    return divmod(index, columns)


def points(pixels: DataFrame, classes: DataFrame | None = None, features: Sequence[int] = (0, 1, 2), spectrum: str = "spectrum") -> DataFrame:
    """(row, col, point, class_id, r, g, b): the features of each pixel, each between 0 and 1, and the colour of its class.

    A feature that is the same everywhere is 0. Pixels without a class are of class 0, which is white.
    """
    scaled = scaled_bands(pixels.where(F.col(spectrum).isNotNull()).select("row", "col", spectrum), spectrum)
    at = scaled.select("row", "col", F.array(*[F.get(F.col(spectrum), F.lit(int(f))) for f in features]).alias("point"))
    of = at.withColumn("class_id", F.lit(0)) if classes is None else at.join(classes.select("row", "col", "class_id"), ["row", "col"], "left").withColumn("class_id", F.coalesce("class_id", F.lit(0)).cast("int"))
    shown = colour_classes(of, [(255, 255, 255), *CLASS_COLORS[1:]]).select("row", "col", "r", "g", "b")
    return of.join(shown, ["row", "col"])


def reassign(points_of: DataFrame, box: Mapping[int, tuple[float, float]], class_id: int) -> tuple[DataFrame, int]:
    """(row, col, class_id) with the points in ``box`` (bounds by place in ``point``, both included) set to a class, and how many changed."""
    inside = F.lit(True)
    for i, (lo, hi) in box.items():
        v = F.get(F.col("point"), F.lit(i))
        inside = inside & F.coalesce((v >= lo) & (v <= hi), F.lit(False))
    changed = points_of.where(inside & (F.col("class_id") != class_id)).count()
    return points_of.select("row", "col", F.when(inside, class_id).otherwise(F.col("class_id")).alias("class_id")), changed
