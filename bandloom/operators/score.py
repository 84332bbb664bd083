"""Scores of spectra against targets, backgrounds and classes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from bandloom.operators import kernels
from bandloom.operators.stats import GaussianStats


def _cosines(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.clip((x / np.linalg.norm(x, axis=1, keepdims=True)) @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T, -1, 1)


def angles(pixels: DataFrame, members: np.ndarray, spectrum: str = "spectrum", out: str = "angles") -> DataFrame:
    """The angle in radians to each member; a zero spectrum has NaN."""
    m = np.atleast_2d(np.asarray(members, float))
    return kernels.append(pixels, spectrum, {out: "array<double>"}, lambda x: (np.arccos(_cosines(x, m)),))


def msam(pixels: DataFrame, members: np.ndarray, spectrum: str = "spectrum", out: str = "scores") -> DataFrame:
    """One less the angle of mean-centred spectra over a right angle; a flat spectrum has NaN."""
    m = np.atleast_2d(np.asarray(members, float))
    m = m - m.mean(1, keepdims=True)
    return kernels.append(pixels, spectrum, {out: "array<double>"}, lambda x: (1 - np.arccos(_cosines(x - x.mean(1, keepdims=True), m)) / (np.pi / 2),))


def rx_scores(x: np.ndarray, mean: np.ndarray, inv: np.ndarray) -> np.ndarray:
    d = x - mean
    return np.einsum("ij,jk,ik->i", d, inv, d)


def mf_scores(x: np.ndarray, mean: np.ndarray, inv: np.ndarray, target: np.ndarray) -> np.ndarray:
    d = np.asarray(target, float) - mean
    a = inv @ d
    return (x - mean) @ a / (d @ a)


def ace_scores(x: np.ndarray, mean: np.ndarray, root: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``target`` is a spectrum or a subspace of several; NaN counts as 0 and scores stay in [0, 1]."""
    s = root @ (np.atleast_2d(target) - mean).T
    z = (x - mean) @ root.T
    p = s @ np.linalg.pinv(s)
    with np.errstate(invalid="ignore", divide="ignore"):
        score = np.einsum("ij,jk,ik->i", z, p, z) / np.einsum("ij,ij->i", z, z)
    return np.clip(np.nan_to_num(score, nan=0.0), 0, 1)


def rx(pixels: DataFrame, background: GaussianStats, spectrum: str = "spectrum", out: str = "rx") -> DataFrame:
    mean, inv = background.mean, background.inv_cov
    return kernels.append(pixels, spectrum, {out: "double"}, lambda x: (rx_scores(x, mean, inv),))


def matched_filter(pixels: DataFrame, target: np.ndarray, background: GaussianStats, spectrum: str = "spectrum", out: str = "mf") -> DataFrame:
    mean, inv = background.mean, background.inv_cov
    return kernels.append(pixels, spectrum, {out: "double"}, lambda x: (mf_scores(x, mean, inv, target),))


def whiten_to_target(target: np.ndarray, background: GaussianStats):  # noqa: ANN201
    """The transform under which the matched filter is a dot product with the whitened target."""
    from bandloom.operators.linear import LinearTransform

    d = np.asarray(target, float) - background.mean
    return LinearTransform(background.sqrt_inv_cov / np.sqrt(d @ background.inv_cov @ d), pre=-background.mean)


def ace(pixels: DataFrame, target: np.ndarray | list[np.ndarray], background: GaussianStats, spectrum: str = "spectrum", out: str = "ace") -> DataFrame:
    """One score for a target or subspace, an array of scores for a list of them."""
    mean, root = background.mean, background.sqrt_inv_cov
    if isinstance(target, list):
        return kernels.append(pixels, spectrum, {out: "array<double>"}, lambda x: (np.stack([ace_scores(x, mean, root, t) for t in target], axis=1),))
    return kernels.append(pixels, spectrum, {out: "double"}, lambda x: (ace_scores(x, mean, root, target),))


class Detector:
    """Scores of pixels by "rx", "mf" (matched filter) or "ace", with a background and a target that may be set anew.

    Called with pixels it gives them with a column of scores, called with spectra in
    the rows of an array their scores. Without a background it takes that of the
    pixels that it is called with. A target is a spectrum, or for "ace" a subspace
    (rows of an array), or a list of either: then a pixel has a score for each.
    """

    def __init__(self, kind: str, target: np.ndarray | list | None = None, background: GaussianStats | None = None):
        if kind not in ("rx", "mf", "ace"):
            raise ValueError("kind must be rx, mf or ace")
        self.kind = kind
        self.set_target(target)
        self.set_background(background)

    def set_target(self, target: np.ndarray | list | None) -> None:
        self.target = [np.asarray(t, float) for t in target] if isinstance(target, list) and np.ndim(target[0]) else None if target is None else np.asarray(target, float)

    def set_background(self, background: GaussianStats | None) -> None:
        self.background = background

    def scores(self, x: np.ndarray, background: GaussianStats | None = None) -> np.ndarray:
        b = background or self.background
        if b is None or self.kind != "rx" and self.target is None:
            raise ValueError("a background is needed, and a target unless the kind is rx")
        if self.kind == "rx":
            return rx_scores(x, b.mean, b.inv_cov)
        one = (lambda t: mf_scores(x, b.mean, b.inv_cov, t)) if self.kind == "mf" else (lambda t: ace_scores(x, b.mean, b.sqrt_inv_cov, t))
        return np.stack([one(t) for t in self.target], axis=1) if isinstance(self.target, list) else one(self.target)

    def __call__(self, x: DataFrame | np.ndarray, spectrum: str = "spectrum", out: str = "score") -> DataFrame | np.ndarray:
        if not isinstance(x, DataFrame):
            return self.scores(np.atleast_2d(np.asarray(x, float)))
        from bandloom.operators.stats import calc_stats

        background = self.background or calc_stats(x, spectrum=spectrum)
        return kernels.append(x, spectrum, {out: "array<double>" if isinstance(self.target, list) and self.kind != "rx" else "double"}, lambda v: (self.scores(v, background),))


class Classifier:
    """A classifier by scores: a subclass gives ``ids`` and, for a matrix of spectra, a column of ``scores`` for each; the greatest wins, ties go to the first."""

    ids: list[int]

    def scores(self, x: np.ndarray) -> np.ndarray:
        raise TypeError(f"{type(self).__name__} gives no scores")

    def best(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.ids)[self.scores(x).argmax(1)]

    def classify(self, pixels: DataFrame, spectrum: str = "spectrum", out: str = "predicted") -> DataFrame:
        if not self.ids:
            raise ValueError("no class has enough pixels")
        return kernels.append(pixels, spectrum, {out: "int"}, lambda x: (self.best(x),))


class GaussianClassifier(Classifier):
    """Maximum likelihood of classes with their own covariance; classes of fewer pixels than ``min_samples`` (else bands) are dropped."""

    def __init__(self, classes: dict[int, GaussianStats], min_samples: int | None = None):
        self.classes = {c: s for c, s in sorted(classes.items()) if s.nsamples >= (min_samples or len(s.mean))}
        self.ids = list(self.classes)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.log(s.prior) - s.log_det_cov / 2 - rx_scores(x, s.mean, s.inv_cov) / 2 for s in self.classes.values()], axis=1)


class MahalanobisClassifier(GaussianClassifier):
    """Least distance to class means under the covariance pooled by class size."""

    def __init__(self, classes: dict[int, GaussianStats]):
        self.classes = dict(sorted(classes.items()))
        self.ids = list(self.classes)
        n = sum(s.nsamples for s in classes.values())
        self.inv = np.linalg.inv(sum(s.nsamples / n * s.cov for s in classes.values()))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.stack([-rx_scores(x, s.mean, self.inv) for s in self.classes.values()], axis=1)


def distances(x: np.ndarray, centers: np.ndarray, metric: str = "L2") -> np.ndarray:
    """L1, or squared L2, from each row to each center."""
    if metric == "L1":
        return np.abs(x[:, None, :] - centers[None]).sum(2)
    return ((x**2).sum(1)[:, None] - 2 * x @ centers.T) + (centers**2).sum(1)[None]
