"""Linear transforms of spectra and the analyses that yield them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from bandloom.operators import kernels
from bandloom.operators.stats import GaussianStats, cov_avg


@dataclass
class LinearTransform:
    """y = A (x + pre) + post, for a scalar or a matrix A; always in doubles."""

    matrix: np.ndarray | float
    pre: np.ndarray | float | None = None
    post: np.ndarray | float | None = None

    def __post_init__(self) -> None:
        self.matrix = np.asarray(self.matrix, float) if np.ndim(self.matrix) else float(self.matrix)
        if np.ndim(self.matrix) == 1:
            self.matrix = self.matrix[None, :]

    def __call__(self, x: object) -> object:
        """Spectra in the last axis transformed; pixels and whatever has a method ``transform`` of its own are, too."""
        if isinstance(x, DataFrame):
            return self.apply(x)
        if hasattr(x, "transform"):
            return x.transform(self)
        x = np.asarray(x, float)
        if self.pre is not None:
            x = x + self.pre
        y = x @ self.matrix.T if np.ndim(self.matrix) else x * self.matrix
        return y if self.post is None else y + self.post

    def chain(self, after: LinearTransform) -> LinearTransform:
        """This one after ``after``, as one transform: spectra are then read and multiplied once."""
        a, b = self.matrix, after.matrix
        m = a @ b if np.ndim(a) and np.ndim(b) else a * b
        inner = 0.0 if after.post is None else after.post
        inner = inner + (0.0 if self.pre is None else self.pre)
        shift = np.asarray(inner) @ a.T if np.ndim(a) and np.ndim(inner) else (a * inner if not np.ndim(a) else a.sum(1) * inner)
        post = shift + (0.0 if self.post is None else self.post)
        return LinearTransform(m, after.pre, post)

    def bands(self, which: list[int]) -> LinearTransform:
        """Only these output bands, by rows of A: the others are never computed."""
        post = self.post if self.post is None or not np.ndim(self.post) else np.asarray(self.post)[which]
        return LinearTransform(self.matrix[which], self.pre, post)

    def apply(self, pixels: DataFrame, spectrum: str = "spectrum", out: str = "spectrum") -> DataFrame:
        """``pixels`` with transformed spectra. Filter rows first: Catalyst can't move a filter below this map."""
        if out == spectrum:
            done = kernels.append(pixels, spectrum, {"__t": "array<double>"}, lambda x: (self(x),))
            return done.withColumn(spectrum, done["__t"]).drop("__t").select(*pixels.columns)
        return kernels.append(pixels, spectrum, {out: "array<double>"}, lambda x: (self(x),))


@dataclass
class PrincipalComponents:
    eigenvalues: np.ndarray
    eigenvectors: np.ndarray
    stats: GaussianStats

    @property
    def transform(self) -> LinearTransform:
        return LinearTransform(self.eigenvectors.T, pre=-self.stats.mean)

    def reduce(self, num: int | None = None, eigs: list[int] | None = None, fraction: float | None = None) -> PrincipalComponents:
        """The first ``num``, the listed, or the fewest that hold ``fraction`` of the variance."""
        if sum(v is not None for v in (num, eigs, fraction)) != 1:
            raise ValueError("give one of num, eigs and fraction")
        if fraction is not None:
            if not 0 < fraction <= 1:
                raise ValueError("fraction must be in (0, 1]")
            share = np.cumsum(self.eigenvalues) / self.eigenvalues.sum()
            num = min(int(np.searchsorted(share, fraction - 1e-15)) + 1, len(share))
        which = list(range(num)) if eigs is None else eigs
        return PrincipalComponents(self.eigenvalues[which], self.eigenvectors[:, which], self.stats)

    def denoising(self, **keep: object) -> LinearTransform:
        v = self.reduce(**keep).eigenvectors
        return LinearTransform(v @ v.T, pre=-self.stats.mean, post=self.stats.mean)


def principal_components(stats: GaussianStats) -> PrincipalComponents:
    return PrincipalComponents(*stats.eig, stats)


@dataclass
class LinearDiscriminant:
    eigenvalues: np.ndarray
    eigenvectors: np.ndarray
    mean: np.ndarray
    cov_b: np.ndarray
    cov_w: np.ndarray

    @property
    def transform(self) -> LinearTransform:
        return LinearTransform(self.eigenvectors.T, pre=-self.mean)


def linear_discriminant(classes: dict[int, GaussianStats], whiten: bool = True) -> LinearDiscriminant:
    """Fisher's discriminant of the classes; its rank is their number less one."""
    k, n = len(classes), sum(s.nsamples for s in classes.values())
    mean = sum(s.nsamples / n * s.mean for s in classes.values())
    within = cov_avg(classes)
    between = sum(s.nsamples / n / (k - 1) * np.outer(s.mean - mean, s.mean - mean) for s in classes.values())
    w, v = np.linalg.eig(np.linalg.solve(within, between))
    order = np.argsort(-w.real, kind="stable")[: k - 1]
    w, v = w.real[order], v.real[:, order]
    if whiten:
        v = v / np.sqrt(np.abs(np.einsum("ij,ik,kj->j", v, within, v)))
    return LinearDiscriminant(w, v, mean, between, within)


@dataclass
class MinimumNoiseFraction:
    signal: GaussianStats
    noise: GaussianStats

    def __post_init__(self) -> None:
        w, v = np.linalg.eigh(self.noise.sqrt_inv_cov @ self.signal.cov @ self.noise.sqrt_inv_cov)
        self.eigenvalues, self.eigenvectors = w[::-1], v[:, ::-1]

    def num_with_snr(self, snr: float) -> int:
        return int((self.eigenvalues >= snr + 1).sum())

    def _num(self, num: int | None, snr: float | None) -> int:
        if (num is None) == (snr is None):
            raise ValueError("give one of num and snr")
        return num if num is not None else self.num_with_snr(snr)

    def reduction(self, num: int | None = None, snr: float | None = None) -> LinearTransform:
        v = self.eigenvectors[:, : self._num(num, snr)]
        return LinearTransform(v.T @ self.noise.sqrt_inv_cov, pre=-self.signal.mean)

    def denoising(self, num: int | None = None, snr: float | None = None) -> LinearTransform:
        v = self.eigenvectors[:, : self._num(num, snr)]
        return LinearTransform(self.noise.sqrt_cov @ v @ v.T @ self.noise.sqrt_inv_cov, pre=-self.signal.mean, post=self.signal.mean)


def orthogonalize(vectors: np.ndarray, start: int = 0) -> np.ndarray:
    """Orthonormal rows by Gram-Schmidt; those before ``start`` are taken to be orthonormal already."""
    out = np.array(vectors, float)
    for i in range(start, len(out)):
        # Twice, so that rounding doesn't spoil nearly dependent rows.
        for _ in range(2):
            out[i] -= out[:i].T @ (out[:i] @ out[i])
        out[i] /= np.linalg.norm(out[i])
    return out


def unmixing(members: np.ndarray) -> LinearTransform:
    """Least-squares abundances of ``members`` (rows), without constraints."""
    m = np.asarray(members, float)
    return LinearTransform(np.linalg.solve(m @ m.T, m))
