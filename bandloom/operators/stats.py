"""Means and covariances of spectra, whole, masked or by class, and what follows from them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from bandloom.operators import kernels

_PARTIAL = "key long, part int, n double, mean array<double>, m2 array<double>"
#: Partials of a class that reach the driver; those of more tasks are merged on the executors first.
FAN_IN = 16


def merge(a: tuple, b: tuple) -> tuple:
    """(n, mean, M2) of two parts together."""
    (na, ma, sa), (nb, mb, sb) = a, b
    n = na + nb
    d = mb - ma
    return n, ma + d * (nb / n), sa + sb + np.outer(d, d) * (na * nb / n)


@dataclass
class GaussianStats:
    """Mean, unbiased covariance and count, with the matrices that follow from them."""

    mean: np.ndarray
    cov: np.ndarray
    nsamples: int
    prior: float = field(default=1.0)

    @cached_property
    def eig(self) -> tuple[np.ndarray, np.ndarray]:
        """Eigenvalues from the greatest down, and eigenvectors as columns."""
        w, v = np.linalg.eigh(self.cov)
        return w[::-1], v[:, ::-1]

    @cached_property
    def inv_cov(self) -> np.ndarray:
        return np.linalg.inv(self.cov)

    @cached_property
    def sqrt_cov(self) -> np.ndarray:
        return matrix_sqrt(self.cov)

    @cached_property
    def sqrt_inv_cov(self) -> np.ndarray:
        return matrix_sqrt(self.cov, inverse=True)

    @cached_property
    def log_det_cov(self) -> float:
        return log_det(self.cov)

    def transform(self, t: LinearTransform) -> GaussianStats:  # noqa: F821
        a = np.atleast_2d(t.matrix) if np.ndim(t.matrix) else np.eye(len(self.mean)) * t.matrix
        return GaussianStats(t(self.mean), a @ self.cov @ a.T, self.nsamples, self.prior)

    def whitening(self) -> LinearTransform:  # noqa: F821
        from bandloom.operators.linear import LinearTransform

        return LinearTransform(self.sqrt_inv_cov, pre=-self.mean)


def log_det(m: np.ndarray) -> float:
    """Sum of the logarithms of the positive eigenvalues."""
    w = np.linalg.eigvalsh(m)
    return float(np.log(w[w > 0]).sum())


def matrix_sqrt(m: np.ndarray | None, inverse: bool = False, symmetric: bool = True, eigs: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The square root of a matrix or of its inverse; ``eigs`` (eigenvalues, eigenvectors as columns) spare the decomposition.

    A matrix that isn't symmetric may have a complex root.
    """
    if eigs is None:
        eigs = np.linalg.eigh(np.asarray(m, float)) if symmetric else np.linalg.eig(np.asarray(m))
    w, v = eigs
    w = w + 0j if not symmetric and (np.iscomplexobj(w) or (w < 0).any()) else w
    root = v * (1 / np.sqrt(w) if inverse else np.sqrt(w))
    return root @ v.T if symmetric else root @ np.linalg.inv(v)


def class_stats(pixels: DataFrame, by: str | None = None, spectrum: str = "spectrum", allow_nan: bool = False) -> dict[int, GaussianStats]:
    """Statistics of each class of the column ``by`` (0 and null are unlabelled and left out), or of all pixels as class 0.

    One pass: each task keeps (n, mean, M2) of its classes, partials are merged on
    executors, and no more than FAN_IN a class reach the driver. Null spectra are
    left out; NaN raises ValueError unless ``allow_nan``; a class of one pixel has
    a covariance of NaN.
    """
    key = F.lit(0).cast("long") if by is None else F.col(f"`{by}`").cast("long")
    rows = pixels.select(key.alias("key"), F.col(f"`{spectrum}`").cast("array<double>").alias("x")).where("x is not null")
    if by is not None:
        rows = rows.where("key is not null and key <> 0")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, tuple] = {}
        for b in batches:
            x, _ = kernels.matrix(b, "x")
            if not len(x):
                continue
            k = b.column("key").to_numpy()
            for c in np.unique(k):
                y = x[k == c]
                m = y.mean(0)
                z = y - m
                # A count of NaN tells the driver of NaN among the spectra.
                new = (len(y) if allow_nan or not np.isnan(m).any() else np.nan, m, z.T @ z)
                acc[int(c)] = merge(acc[int(c)], new) if int(c) in acc else new
        part = TaskContext.get().partitionId() % FAN_IN
        yield _pack([(c, part, *v) for c, v in acc.items()])

    def combine(t: pa.Table) -> pa.Table:
        acc: dict[int, tuple] = {}
        for r in t.to_pylist():
            new = (r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(len(r["mean"]), -1))
            acc[r["key"]] = merge(acc[r["key"]], new) if r["key"] in acc else new
        return pa.Table.from_batches([_pack([(c, 0, *v) for c, v in acc.items()])])

    merged = rows.mapInArrow(partial, _PARTIAL).groupBy("key", "part").applyInArrow(combine, _PARTIAL).toArrow()
    out: dict[int, tuple] = {}
    for r in merged.to_pylist():
        new = (r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(len(r["mean"]), -1))
        out[r["key"]] = merge(out[r["key"]], new) if r["key"] in out else new
    if any(np.isnan(n) for n, _, _ in out.values()):
        raise ValueError("NaN among the spectra; pass allow_nan to go on")
    return {c: GaussianStats(m, s / (n - 1) if n > 1 else np.full_like(s, np.nan), int(n)) for c, (n, m, s) in sorted(out.items())}


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array([float(n) for n in cols[2]], pa.float64()), pa.array([list(m) for m in cols[3]], pa.list_(pa.float64())), pa.array([list(np.ravel(s)) for s in cols[4]], pa.list_(pa.float64()))],
        names=["key", "part", "n", "mean", "m2"],
    )


def calc_stats(pixels: DataFrame, mask: str | None = None, index: int | None = None, spectrum: str = "spectrum", allow_nan: bool = False) -> GaussianStats:
    """Statistics of all pixels, of those whose ``mask`` isn't 0, or of those whose mask is ``index``."""
    if index == 0:
        raise ValueError("index 0 means unlabelled")
    chosen = pixels if mask is None else pixels.where(F.col(mask) != 0 if index is None else F.col(mask) == index)
    stats = class_stats(chosen, None, spectrum, allow_nan)
    if not stats:
        raise ValueError("no pixels")
    return stats[0]


def cov_avg(classes: dict[int, GaussianStats], weighted: bool = True) -> np.ndarray:
    """Class covariances averaged, by n - 1 or alike."""
    if not weighted:
        return np.mean([s.cov for s in classes.values()], axis=0)
    n = sum(s.nsamples for s in classes.values())
    return sum((s.nsamples - 1) / (n - 1) * s.cov for s in classes.values())


def bhattacharyya_terms(a: GaussianStats, b: GaussianStats) -> tuple[float, float]:
    """The linear and the quadratic term of the distance of two classes."""
    mean, c = b.mean - a.mean, (a.cov + b.cov) / 2
    return float(mean @ np.linalg.solve(c, mean) / 8), float((log_det(c) - (log_det(a.cov) + log_det(b.cov)) / 2) / 2)


def bhattacharyya(a: GaussianStats, b: GaussianStats) -> float:
    return sum(bhattacharyya_terms(a, b))


#: The neighbour (rows down, columns right) and the pixel it is taken from, by direction.
_NEIGHBOURS = {"lowerright": ((0, 0), (1, 1)), "lowerleft": ((0, 1), (1, 0)), "right": ((0, 0), (0, 1)), "lower": ((0, 0), (1, 0))}


def neighbour_differences(pixels: DataFrame, direction: str = "lowerright", spectrum: str = "spectrum") -> DataFrame:
    """(row, col, spectrum) of each pixel less its neighbour, by an equi-join on shifted places."""
    (r0, c0), (r1, c1) = _NEIGHBOURS[direction.lower()]
    a = pixels.select((F.col("row") - r0).alias("row"), (F.col("col") - c0).alias("col"), F.col(spectrum).alias("a"))
    b = pixels.select((F.col("row") - r1).alias("row"), (F.col("col") - c1).alias("col"), F.col(spectrum).alias("b"))
    return a.join(b, ["row", "col"]).select("row", "col", F.zip_with("a", "b", lambda x, y: x - y).alias("spectrum"))


def noise_from_diffs(pixels: DataFrame, direction: str = "lowerright", spectrum: str = "spectrum") -> GaussianStats:
    """Noise statistics: half the covariance of neighbour differences."""
    s = calc_stats(neighbour_differences(pixels, direction, spectrum))
    return GaussianStats(s.mean, s.cov / 2, s.nsamples)


def stats_frame(spark: SparkSession, classes: dict[int, GaussianStats]) -> DataFrame:
    """class_stats(class_id, n, mean, cov, prior), for parquet."""
    rows = [(int(c), int(s.nsamples), s.mean.tolist(), s.cov.tolist(), float(s.prior)) for c, s in classes.items()]
    return spark.createDataFrame(rows, "class_id int, n long, mean array<double>, cov array<array<double>>, prior double")


def save_training(classes: dict[int, GaussianStats], spark: SparkSession, path: str) -> None:
    stats_frame(spark, classes).write.mode("overwrite").parquet(path)


def load_training(spark: SparkSession, path: str) -> dict[int, GaussianStats]:
    return {r["class_id"]: GaussianStats(np.array(r["mean"]), np.array(r["cov"]), r["n"], r["prior"]) for r in spark.read.parquet(path).orderBy("class_id").collect()}


def min_max(pixels: DataFrame, spectrum: str = "spectrum") -> list[tuple[float, float]]:
    """The least and the greatest value of each band."""
    long = pixels.select(F.posexplode(spectrum).alias("band", "v")).groupBy("band").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return [(r["lo"], r["hi"]) for r in long.orderBy("band").collect()]


def training_classes(pixels: DataFrame, classes: DataFrame, indices: Sequence[int] | None = None) -> DataFrame:
    """Pixels joined to their class map, without the unlabelled, and only of ``indices`` if given."""
    joined = pixels.join(classes.where("class_id <> 0"), ["row", "col"])
    return joined if indices is None else joined.where(F.col("class_id").isin(list(indices)))


class TrainingSet:
    """Labelled pixels(row, col, spectrum, class_id) with the statistics of their classes, which are computed when first asked for."""

    def __init__(self, samples: DataFrame, stats: dict[int, GaussianStats] | None = None):
        self.samples = samples.where("class_id is not null and class_id <> 0")
        self._stats = stats

    @property
    def stats_valid(self) -> bool:
        return self._stats is not None

    @property
    def stats(self) -> dict[int, GaussianStats]:
        if self._stats is None:
            self._stats = class_stats(self.samples, "class_id")
        return self._stats

    def __len__(self) -> int:
        return len(self.stats)

    def __iter__(self) -> Iterator[int]:
        return iter(self.stats)

    def __getitem__(self, class_id: int) -> GaussianStats:
        return self.stats[class_id]

    def pixels(self, class_id: int) -> DataFrame:
        return self.samples.where(F.col("class_id") == class_id)

    def add(self, class_id: int, pixels: DataFrame) -> TrainingSet:
        """With a further class; an id that is taken raises ValueError. The statistics of the others aren't computed again."""
        if class_id == 0 or class_id in self.stats:
            raise ValueError(f"class {class_id} is taken")
        new = pixels.select("row", "col", "spectrum", F.lit(class_id).alias("class_id"))
        return TrainingSet(self.samples.select("row", "col", "spectrum", "class_id").unionByName(new), {**self.stats, **class_stats(new, "class_id")})

    def transform(self, t: LinearTransform) -> TrainingSet:  # noqa: F821
        """All pixels transformed; statistics that are known follow from the transform without a pass."""
        return TrainingSet(t.apply(self.samples), None if self._stats is None else {c: s.transform(t) for c, s in self._stats.items()})
