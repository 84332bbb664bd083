"""Selection, recoding and reshaping of pixel tables: pixels(row, col, spectrum) and classes(row, col, class_id)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from bandloom.common import maybe_broadcast


def grid(df: DataFrame, key: str, width: int, spectrum: Column, label: Column | None = None) -> DataFrame:
    """Any keyed table of vectors as pixels of an image ``width`` wide."""
    cols = [F.floor(F.col(key) / width).cast("int").alias("row"), F.pmod(F.col(key), F.lit(width)).cast("int").alias("col"), F.transform(spectrum, lambda v: v.cast("double")).alias("spectrum")]
    return df.select(*cols, *([] if label is None else [label.cast("int").alias("class_id")]))


def select_bands(pixels: DataFrame, bands: Sequence[int], spectrum: str = "spectrum") -> DataFrame:
    """The listed bands in that order, repeats kept; negative ones count from the end."""
    n = F.size(spectrum)
    pick = [F.get(F.col(spectrum), F.lit(b) if b >= 0 else n + b) for b in bands]
    return pixels.withColumn(spectrum, F.array(*pick))


def band(pixels: DataFrame, index: int, spectrum: str = "spectrum") -> DataFrame:
    return pixels.select("row", "col", F.get(F.col(spectrum), F.lit(index) if index >= 0 else F.size(spectrum) + index).alias("value"))


def pixel(pixels: DataFrame, row: int, col: int) -> DataFrame:
    return pixels.where((F.col("row") == row) & (F.col("col") == col))


def datum(pixels: DataFrame, row: int, col: int, index: int, spectrum: str = "spectrum") -> float | None:
    """One value; None where there is no such pixel or band."""
    found = pixel(pixels, row, col).select(F.get(F.col(spectrum), F.lit(index) if index >= 0 else F.size(spectrum) + index).cast("double")).first()
    return None if found is None else found[0]


def shape(pixels: DataFrame, spectrum: str = "spectrum") -> tuple[int, int, int]:
    """(rows, columns, bands) that the pixels span."""
    r = pixels.agg(F.max("row"), F.max("col"), F.max(F.size(spectrum))).first()
    return tuple(0 if v is None else v + k for v, k in zip(r, (1, 1, 0), strict=True))


def to_array(pixels: DataFrame, most: int = 1 << 27, spectrum: str = "spectrum") -> np.ndarray:
    """The image as an array (row, col, band) on the driver, NaN where a pixel lacks; its size is counted first, and ValueError raised beyond ``most`` values."""
    size = shape(pixels, spectrum)
    if np.prod(size, dtype=np.int64) > most:
        raise ValueError("too large for one array")
    out = np.full(size, np.nan)
    t = pixels.where(F.col(spectrum).isNotNull()).select("row", "col", F.col(spectrum).cast("array<double>").alias("x")).toArrow()
    if t.num_rows:
        out[t.column("row").to_numpy(), t.column("col").to_numpy()] = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
    return out


def subregion(pixels: DataFrame, rows: tuple[int, int], cols: tuple[int, int], bands: Sequence[int] | None = None, rebase: bool = False) -> DataFrame:
    """Half-open ranges; with ``rebase`` the corner becomes (0, 0)."""
    out = pixels.where((F.col("row") >= rows[0]) & (F.col("row") < rows[1]) & (F.col("col") >= cols[0]) & (F.col("col") < cols[1]))
    out = out if bands is None else select_bands(out, bands)
    return out.withColumn("row", F.col("row") - rows[0]).withColumn("col", F.col("col") - cols[0]) if rebase else out


def subimage(pixels: DataFrame, rows: Sequence[int], cols: Sequence[int], bands: Sequence[int] | None = None) -> DataFrame:
    """The listed rows and columns, numbered by their place in the lists; repeats give repeated pixels."""
    spark = pixels.sparkSession
    r = spark.createDataFrame([(v, i) for i, v in enumerate(rows)], "row int, new_row int")
    c = spark.createDataFrame([(v, i) for i, v in enumerate(cols)], "col int, new_col int")
    out = pixels.join(F.broadcast(r), "row").join(F.broadcast(c), "col").drop("row", "col").withColumnsRenamed({"new_row": "row", "new_col": "col"})
    out = out.select("row", "col", *[x for x in out.columns if x not in ("row", "col")])
    return out if bands is None else select_bands(out, bands)


def strided(pixels: DataFrame, rows: slice, cols: slice, shape: tuple[int, int]) -> DataFrame:
    """Slices with steps, as of an array of ``shape``."""
    out = pixels
    for name, s, n in (("row", rows, shape[0]), ("col", cols, shape[1])):
        start, stop, step = s.indices(n)
        c = F.col(name)
        out = out.where((c >= start) & (c < stop) & ((c - start) % step == 0)) if step > 0 else out.where((c <= start) & (c > stop) & ((start - c) % -step == 0))
    return out


def tiles(pixels: DataFrame, shape: tuple[int, int], nrows: int, ncols: int) -> DataFrame:
    """``pixels`` with tile_row and tile_col of a grid of tiles whose bounds are floor(i * size / tiles)."""
    def of(name: str, n: int, k: int) -> Column:
        bounds = [i * n // k for i in range(1, k)]
        return reduce(lambda a, b: a + (F.col(name) >= b).cast("int"), bounds, F.lit(0))

    return pixels.withColumn("tile_row", of("row", shape[0], nrows)).withColumn("tile_col", of("col", shape[1], ncols))


def masked(pixels: DataFrame, classes: DataFrame, index: int | None = None) -> DataFrame:
    """Pixels whose class isn't 0, or is ``index``."""
    if index == 0:
        raise ValueError("index 0 means unlabelled")
    chosen = classes.where(F.col("class_id") != 0) if index is None else classes.where(F.col("class_id") == index)
    return pixels.join(chosen, ["row", "col"])


def ndvi(pixels: DataFrame, red: int, nir: int, spectrum: str = "spectrum") -> DataFrame:
    """(nir - red) / (nir + red); NaN where the sum is zero."""
    r, n = F.get(F.col(spectrum), F.lit(red)), F.get(F.col(spectrum), F.lit(nir))
    return pixels.select("row", "col", F.coalesce(F.try_divide(n - r, n + r), F.when(n.isNotNull() & r.isNotNull(), F.lit(float("nan")))).alias("ndvi"))


def to_long(pixels: DataFrame, spectrum: str = "spectrum") -> DataFrame:
    """Band-sequential form (band, row, col, value), bands from 0."""
    return pixels.select("row", "col", F.posexplode(spectrum).alias("band", "value")).select("band", "row", "col", "value")


def from_long(long: DataFrame) -> DataFrame:
    """Pixel-interleaved form of a band-sequential table."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("band", "value"))), lambda x: x["value"])
    return long.groupBy("row", "col").agg(ordered.alias("spectrum"))


def has_nan(pixels: DataFrame, spectrum: str = "spectrum") -> bool:
    return not pixels.where(F.exists(spectrum, F.isnan)).limit(1).isEmpty()


def recode(classes: DataFrame, mapping: Mapping[int, int], allow_unmapped: bool = False) -> DataFrame:
    """Class ids by ``mapping``; an id it lacks raises, or stays where that is allowed."""
    m = classes.sparkSession.createDataFrame([(int(a), int(b)) for a, b in mapping.items()], "class_id int, new_id int")
    joined = classes.join(F.broadcast(m), "class_id", "left")
    if not allow_unmapped and not joined.where("new_id is null").limit(1).isEmpty():
        raise ValueError("a class id has no mapping")
    return joined.select("row", "col", F.coalesce("new_id", "class_id").alias("class_id"))


def contingency(source: DataFrame, target: DataFrame) -> DataFrame:
    """(source_id, target_id, n): how often two class maps give each pair of ids."""
    a, b = source.withColumnRenamed("class_id", "source_id"), target.withColumnRenamed("class_id", "target_id")
    return a.join(b, ["row", "col"]).groupBy("source_id", "target_id").agg(F.count("*").alias("n"))


def match_classes(source: DataFrame, target: DataFrame, unlabeled: int | Sequence[int] | None = None) -> dict[int, int]:
    """Ids of ``source`` paired with those of ``target`` by the greatest overlaps first; ties go to the smallest ids.

    Pixels of an id in ``unlabeled`` (one or several) count in neither map, and such an id of ``source`` stays what it is.

    What overlaps nothing is paired in order with the ids left, then with the smallest unused ones.
    """
    rows = contingency(source, target).collect()  # pairs of class ids, not pixels
    bare = set() if unlabeled is None else {unlabeled} if isinstance(unlabeled, int) else set(unlabeled)
    met, targets = {r["source_id"] for r in rows}, {r["target_id"] for r in rows}
    rows = [r for r in rows if not bare & {r["source_id"], r["target_id"]}]
    out: dict[int, int] = {i: i for i in sorted(bare & met)}
    for r in sorted(rows, key=lambda r: (-r["n"], r["source_id"], r["target_id"])):
        if r["source_id"] not in out and r["target_id"] not in out.values():
            out[r["source_id"]] = r["target_id"]
    left = iter(sorted(targets - bare - set(out.values())))
    for s in sorted(met - bare - set(out)):
        t = next(left, None)
        used = set(out.values()) | bare
        out[s] = t if t is not None else next(i for i in range(len(used) + 1) if i not in used)
    return out


def cdf_points(values: DataFrame, column: str, points: Sequence[float], ignore: float | None = None) -> list[float]:
    """The value at place floor(q (N - 1)) of the sorted values, for each q; exact, by counts of distinct values."""
    v = values.select(F.col(column).cast("double").alias("v")).where("v is not null")
    v = v if ignore is None else v.where(F.col("v") != ignore)
    counts = v.groupBy("v").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        raise ValueError("no values")
    # A running count over ranges: each range counts its own values, only one number a range is summed up in one task.
    ranged = counts.repartitionByRange("v").withColumn("p", F.spark_partition_id())
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("p").agg(F.sum("n").alias("t")).withColumn("base", F.coalesce(F.sum("t").over(before), F.lit(0))).select("p", "base")
    running = ranged.join(maybe_broadcast(offsets, 16), "p").withColumn("upto", F.col("base") + F.sum("n").over(Window.partitionBy("p").orderBy("v")))
    want = {int(q * (total - 1)) for q in points}
    at = running.where(reduce(lambda a, b: a | b, [(F.col("upto") > i) & (F.col("upto") - F.col("n") <= i) for i in want])).collect()
    return [next(r["v"] for r in at if r["upto"] - r["n"] <= int(q * (total - 1)) < r["upto"]) for q in points]


def dilate(mask: DataFrame, height: int, width: int, shape: tuple[int, int]) -> DataFrame:
    """Places (row, col) within a window of a marked pixel, the window starting at i - size // 2 and cut off at the border."""
    r0, c0 = F.greatest(F.col("row") - height // 2, F.lit(0)), F.greatest(F.col("col") - width // 2, F.lit(0))
    r1, c1 = F.least(F.col("row") - height // 2 + height - 1, F.lit(shape[0] - 1)), F.least(F.col("col") - width // 2 + width - 1, F.lit(shape[1] - 1))
    on = mask.where("class_id <> 0")
    return on.select(F.explode(F.sequence(r0, r1)).alias("row"), c0.alias("a"), c1.alias("b")).select("row", F.explode(F.sequence("a", "b")).alias("col")).distinct()


def label_region(classes: DataFrame, rows: tuple[int, int], cols: tuple[int, int], class_id: int) -> tuple[DataFrame, int]:
    """``classes`` with a half-open rectangle set to ``class_id``, and how many pixels changed."""
    inside = (F.col("row") >= rows[0]) & (F.col("row") < rows[1]) & (F.col("col") >= cols[0]) & (F.col("col") < cols[1])
    changed = classes.where(inside & (F.col("class_id") != class_id)).count()
    return classes.withColumn("class_id", F.when(inside, class_id).otherwise(F.col("class_id"))), changed


def random_subset(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` distinct rows at random."""
    return df.distinct().orderBy(F.rand(seed)).limit(n)
