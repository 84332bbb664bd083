"""Iterative algorithms: k-means, pixel purity, convex-cone endmembers, perceptron."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bandloom.operators import kernels
from bandloom.operators.score import distances
from bandloom.operators.stats import min_max
from bandloom.session import cut, discard


def kmeans(pixels: DataFrame, nclusters: int = 10, max_iterations: int = 20, metric: str = "L2", start: np.ndarray | None = None, compare: Callable[[int, int], bool] | None = None, frames: list | None = None, spectrum: str = "spectrum") -> tuple[DataFrame, np.ndarray]:
    """(pixels with ``cluster``, centers): Lloyd's algorithm from centers along the diagonal of the data's box.

    Ties go to the lowest center and empty clusters keep theirs. It ends when the
    centers stay, when ``compare(changed, total)`` says so, or after
    ``max_iterations``. A task sends sums and counts only.
    """
    if start is None:
        if nclusters < 2:
            raise ValueError("at least two clusters")
        lo, hi = np.array(min_max(pixels, spectrum)).T
        start = np.array([lo + (hi - lo) * k / (nclusters - 1) for k in range(nclusters)])
    centers, before = np.asarray(start, float), None
    for _ in range(max_iterations):
        now, old = centers, before

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, s, moved = np.zeros(len(now)), np.zeros_like(now), 0
            for b in batches:
                x, _ = kernels.matrix(b, "x")
                if len(x):
                    k = distances(x, now, metric).argmin(1)
                    moved += int((k != distances(x, old, metric).argmin(1)).sum()) if old is not None and compare is not None else 0
                    n += np.bincount(k, minlength=len(now))
                    s += np.eye(len(now))[k].T @ x
            # One row a cluster: its sums, then its count, then how many pixels moved (with the first cluster).
            rows = np.column_stack([s, n, np.r_[moved, np.zeros(len(now) - 1)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(now), dtype=np.int32)), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["k", "s"])

        part = pixels.select(F.col(spectrum).cast("array<double>").alias("x")).where("x is not null").mapInArrow(sums, "k int, s array<double>")
        width = now.shape[1] + 2
        total = np.zeros((len(now), width))
        for r in part.groupBy("k").agg(F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(width)]).alias("s")).collect():  # a row a cluster
            total[r["k"]] = r["s"]
        n, moved = total[:, -2], int(total[:, -1].sum()) if old is not None else int(total[:, -2].sum())
        new = np.where(n[:, None] > 0, total[:, :-2] / np.maximum(n, 1)[:, None], now)
        if frames is not None:
            frames.append(new.copy())
        before, centers = now, new
        # Centers that stay mean that no pixel would move.
        if np.array_equal(new, now) or (compare is not None and (moved == 0 or compare(moved, int(n.sum())))):
            break
    return kernels.append(pixels, spectrum, {"cluster": "int"}, lambda x: (distances(x, centers, metric).argmin(1),)), centers


def purity(pixels: DataFrame, iterations: int, threshold: float = 0.0, seed: int = 0, start: DataFrame | None = None, spectrum: str = "spectrum", batch: int = 256) -> DataFrame:
    """(row, col, purity): how often a pixel is extreme on random unit directions.

    Threshold 0 counts the first least and the first greatest pixel in row-major
    order; otherwise all within ``threshold`` of either. ``start`` goes on from
    earlier counts. Centring moves every projection alike and is left out.
    """
    rows = pixels.select("row", "col", F.col(spectrum).cast("array<double>").alias("x")).where("x is not null")
    first = rows.select(F.size("x")).first()
    if first is None:
        return pixels.select("row", "col", F.lit(0).cast("long").alias("purity")).limit(0)
    rng = np.random.default_rng(seed)
    d = rng.random((iterations, first[0])) - 0.5
    d /= np.linalg.norm(d, axis=1, keepdims=True)

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, at = kernels.matrix(b, "x")
            if not len(x):
                continue
            r, c = b.column("row").to_numpy()[at], b.column("col").to_numpy()[at]
            order = np.lexsort((c, r))
            x, r, c = x[order], r[order], c[order]
            for s in range(0, len(d), batch):
                p = x @ d[s : s + batch].T
                for sign in (1, -1):
                    k = (sign * p).argmax(0)
                    n = len(k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(s, s + n, dtype=np.int32)), pa.array(np.full(n, sign, np.int32)), pa.array((sign * p)[k, np.arange(n)]), pa.array(r[k]), pa.array(c[k])], names=["i", "sign", "v", "row", "col"])

    ends = rows.mapInArrow(extremes, "i int, sign int, v double, row int, col int").groupBy("i", "sign").agg(F.min(F.struct((-F.col("v")).alias("nv"), "row", "col")).alias("best"))
    if threshold == 0:
        counts = ends.groupBy("best.row", "best.col").agg(F.count("*").alias("purity"))
    else:
        top, low = np.full(iterations, -np.inf), np.full(iterations, np.inf)
        for r in ends.collect():  # two numbers a direction
            if r["sign"] == 1:
                top[r["i"]] = -r["best"]["nv"]
            else:
                low[r["i"]] = r["best"]["nv"]

        def near(x: np.ndarray) -> tuple[np.ndarray]:
            n = np.zeros(len(x), np.int64)
            for s in range(0, len(d), batch):
                p = x @ d[s : s + batch].T
                n += (p >= top[s : s + batch] - threshold).sum(1) + (p <= low[s : s + batch] + threshold).sum(1)
            return (n,)

        counts = kernels.append(rows, "x", {"purity": "long"}, near).select("row", "col", "purity")
    zero = pixels.select("row", "col", F.lit(0).cast("long").alias("purity"))
    every = zero.unionByName(counts.select("row", "col", F.col("purity").cast("long").alias("purity")))
    every = every if start is None else every.unionByName(start.select("row", "col", F.col("purity").cast("long").alias("purity")))
    return every.groupBy("row", "col").agg(F.sum("purity").alias("purity"))


def smacc(spectra: DataFrame, key: str, spectrum: str = "spectrum", min_endmembers: int | None = None, max_residual: float = float("inf"), every: int = 8) -> tuple[list[int], DataFrame]:
    """(keys of the endmembers in order, spectra with ``abundances`` and ``residual``) by sequential convex-cone projection.

    Each step takes the row of the greatest residual (the smallest key among ties)
    and moves every row's weights onto it. Only the new endmember, its weights and
    its key reach the driver; lineage is cut each ``every`` steps.
    """
    state = spectra.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{spectrum}`").cast("array<double>").alias("residual")).where("key is not null and residual is not null").withColumn("abundances", F.array().cast("array<double>"))
    state = kept = cut(state)
    if min_endmembers is None:
        first = state.first()
        if first is None:
            return [], state
        gram = np.zeros((len(first["residual"]),) * 2)

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = np.zeros_like(gram)
            for b in batches:
                x, _ = kernels.matrix(b, "residual")
                g += x.T @ x if len(x) else 0
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(g.size, dtype=np.int32)), pa.array(g.ravel())], names=["i", "v"])

        for r in state.select("residual").mapInArrow(product, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            gram.flat[r["i"]] = r["v"]
        min_endmembers = int(np.linalg.matrix_rank(gram, hermitian=True))
    keys: list[int] = []
    while True:
        norm = F.aggregate("residual", F.lit(0.0), lambda a, v: a + v * v)
        best = state.select(F.min(F.struct((-norm).alias("n"), "key", "residual", "abundances")).alias("b")).first()["b"]
        if best is None or (len(keys) >= min_endmembers and np.sqrt(-best["n"]) <= max_residual) or best["n"] == 0:
            break
        w, old = np.array(best["residual"]), np.array(best["abundances"])
        earlier = list(keys)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                r, _ = kernels.matrix(b, "residual")
                if not len(r):
                    continue
                ids = b.column("key").to_numpy()
                f = np.array(b.column("abundances").flatten(), float).reshape(len(ids), -1)
                on = r @ w / (w @ w)
                alpha = np.ones(len(ids))
                for k, q in enumerate(old):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        bound = np.where(on * q > 0, f[:, k] / (on * q), np.inf)
                    alpha = np.minimum(alpha, bound)
                alpha[on <= 0] = 0
                alpha[ids == best["key"]] = 1
                new = np.maximum(alpha * on, 0)
                f = np.maximum(f - np.outer(new, old), 0) if len(old) else f
                f = np.column_stack([f, new])
                own = ids == best["key"]
                f[own, :-1] = 0
                for k, e in enumerate(earlier):
                    f[ids == e, k] = 1
                r = r - np.outer(new, w)
                size = np.arange(len(ids) + 1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.ListArray.from_arrays(pa.array(size * r.shape[1]), pa.array(r.ravel())), pa.ListArray.from_arrays(pa.array(size * f.shape[1]), pa.array(f.ravel()))], names=["key", "residual", "abundances"])

        keys.append(best["key"])
        state = state.mapInArrow(step, "key long, residual array<double>, abundances array<double>")
        if len(keys) % every == 0:
            before, kept = kept, cut(state)
            state = kept
            discard(before)
    return keys, state


class Perceptron:
    """A network of sigmoid layers, trained by back-propagation on a bounded sample of pixels."""

    def __init__(self, layers: list[int], gain: float = 1.0, seed: int = 0):
        if len(layers) < 2:
            raise ValueError("an input and an output layer at least")
        rng = np.random.default_rng(seed)
        self.gain = gain
        self.weights = [rng.uniform(-1, 1, (b, a + 1)) for a, b in zip(layers, layers[1:], strict=False)]
        self.low, self.span = np.zeros(layers[0]), np.ones(layers[0])

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [(np.atleast_2d(x) - self.low) / self.span]
        for w in self.weights:
            out.append(1 / (1 + np.exp(-self.gain * (out[-1] @ w[:, 1:].T + w[:, 0]))))
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[-1]

    def classify(self, x: np.ndarray) -> np.ndarray:
        return np.round(self.predict(x)).astype(int)

    def train(self, x: np.ndarray, y: np.ndarray, max_iterations: int = 10000, accuracy: float = 100.0, rate: float = 0.3, momentum: float = 0.0, batch: int = 1, clip: float = 0.0, on_iteration: Callable[[Perceptron], bool] | None = None) -> float:
        """The percentage right at the end; stops at ``accuracy``, after ``max_iterations``, or when the hook says so."""
        x, y = np.asarray(x, float), np.asarray(y, float).reshape(len(x), -1)
        self.low = x.min(0)
        self.span = np.where(np.ptp(x, axis=0) > 0, np.ptp(x, axis=0), 1)
        last = [np.zeros_like(w) for w in self.weights]
        right = 0.0
        for _ in range(max_iterations):
            for s in range(0, len(x), batch):
                out = self.forward(x[s : s + batch])
                delta = (y[s : s + batch] - out[-1]) * self.gain * np.maximum(out[-1] * (1 - out[-1]), clip)
                for i in range(len(self.weights) - 1, -1, -1):
                    change = rate * np.column_stack([delta.sum(0), delta.T @ out[i]]) / len(delta) + momentum * last[i]
                    if i:
                        delta = delta @ self.weights[i][:, 1:] * self.gain * np.maximum(out[i] * (1 - out[i]), clip)
                    self.weights[i] += change
                    last[i] = change
            right = 100.0 * float((self.classify(x) == y).all(1).mean())
            if right >= accuracy or (on_iteration is not None and on_iteration(self)):
                break
        return right


class PerceptronClassifier:
    """Classes of pixels by a perceptron with an output a class."""

    def __init__(self, hidden: list[int], seed: int = 0):
        self.hidden, self.seed = hidden, seed

    def train(self, labelled: DataFrame, per_class: int = 0, **options: object) -> float:
        """Trains on the first ``per_class`` pixels of each class, or on all labelled ones if it is 0: they must fit in the driver's memory."""
        from pyspark.sql import Window

        chosen = labelled.where("class_id <> 0").select("class_id", "row", "col", "spectrum")
        if per_class:
            rank = F.row_number().over(Window.partitionBy("class_id").orderBy("row", "col"))
            chosen = chosen.withColumn("rank", rank).where(F.col("rank") <= per_class)
        sample = chosen.orderBy("class_id", "row", "col").collect()
        self.ids = sorted({r["class_id"] for r in sample})
        x = np.array([r["spectrum"] for r in sample])
        y = np.array([[float(r["class_id"] == c) for c in self.ids] for r in sample])
        self.net = Perceptron([x.shape[1], *self.hidden, len(self.ids)], seed=self.seed)
        return self.net.train(x, y, **options)

    def classify(self, pixels: DataFrame, spectrum: str = "spectrum", out: str = "predicted") -> DataFrame:
        ids, net = np.array(self.ids), self.net
        return kernels.append(pixels, spectrum, {out: "int"}, lambda x: (ids[net.predict(x).argmax(1)],))
