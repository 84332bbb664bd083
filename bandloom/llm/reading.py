"""Reading level of documents, spread from graded ones over the graph of documents and the words they use.

Words and pairs of words are nodes beside the documents. A node's difficulty is
the mean of its documents', a document's the mean of its nodes', each node
weighing the more the less its documents differ. Graded documents are clamped to
the mean of their grades, and both means are taken in turn: harmonic iterations,
each one pass over the edges, until the levels stay. Nodes are
hashed to a fixed number, so what is sent around doesn't grow with the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from bandloom.common import maybe_broadcast
from bandloom.session import cut, discard

#: Nodes of words and word pairs; two arrays of so many floats are broadcast in each iteration. Words that share a node share a difficulty.
NODES = 1 << 20
#: Turns in which the weights of nodes are estimated anew; afterwards they stay.
WEIGHING = 2
#: Graded documents that calibrate the scores; the others above this bound still spread their grades.
CALIBRATION_ROWS = 100_000

_WORD = re.compile(r"[^\W\d_]+")
_END = re.compile(r"(?<=[.!?…])[\"”’)\]]*\s+")
_NOTICE = re.compile(r"cookie|stores small files|last (?:change|update)|print this page|send to a friend|all rights reserved|accept all|copyright|powered by", re.I)
#: Frequent words of the languages told apart.
_COMMON = {
    "en": set("the of and to a in that it is was for on with as by at from this which were but be not had has have they their you he she we my i what who how if there can did put look where now so".split()),
    "de": set("der die das und ist nicht ein eine einen mit von zu den dem im auf für als auch wird sich des sie er es war wenn aber noch nach bei aus".split()),
    "fr": set("le la les des et est une un dans pour que qui sur pas par avec au aux du ce cette il elle sont plus son sa ses ne se en d l".split()),
    "es": set("el la los las una un y es en que con por del para al se su sus no más como pero este esta fue son lo de".split()),
}
_FUNCTION = _COMMON["en"] | set("than then into whose where whereas hence thus ergo notwithstanding insofar inasmuch although because since while whether nor neither each every before after under without only more most".split())


def running_text(text: str) -> list[str]:
    """The paragraphs of a page without menus, notices and the title (a first line that ends like none)."""
    lines = [x.strip() for x in text.splitlines()]
    kept = []
    for line in lines:
        n = len(_WORD.findall(line))
        if n < 4 or _NOTICE.search(line) and n < 25 or len(re.findall(r"[|›»•·]", line)) >= 2 and n < 30:
            continue
        words = line.split()
        if n < 12 and sum(w[:1].isupper() for w in words) > 0.8 * len(words) and line[-1] not in ".!?":
            continue
        if sum(w[:1].isupper() for w in words) == len(words):
            continue
        kept.append(line)
    if kept and kept[0].rstrip("\"”’)")[-1:] not in ".!?…":
        kept = kept[1:]
    return kept


def language(words: list[str]) -> str:
    """The language whose frequent words are most; "en" where none has any."""
    n = {k: sum(w in v for w in words) for k, v in _COMMON.items()}
    return max(n, key=lambda k: (n[k], k == "en"))


class _Nodes(dict):
    def __missing__(self, name: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[name] = xxhash.xxh32_intdigest(name) % NODES
        return h


def features(text: str | None, memo: dict) -> np.ndarray:
    """Node ids of a page's English running text, each once; empty if there is none."""
    paragraphs = running_text(text) if text else []
    words_of = [[w.lower() for w in _WORD.findall(s)] for p in paragraphs for s in _END.split(p)]
    words = [w for s in words_of for w in s]
    if len(words) < 8 or language(words) != "en":
        return np.empty(0, np.int32)
    names = set(words)
    for s in words_of:
        if s:
            names.update(f"{a} {b}" for a, b in zip(s, s[1:], strict=False) if a in _FUNCTION or b in _FUNCTION)
    return np.unique(np.fromiter((memo[x] for x in names), np.int32, len(names)))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = _Nodes()
    for b in batches:
        lists = [features(t, memo) for t in b.column("text").to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        flat = np.concatenate([np.empty(0, np.int32), *lists])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "nodes"])


def _score(offsets: np.ndarray, flat: np.ndarray, level: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = weight[flat]
    top, bottom = np.add.reduceat(w * level[flat], offsets[:-1]), np.add.reduceat(w, offsets[:-1])
    return np.where(bottom > 0, top / np.maximum(bottom, 1e-12), np.nan)


def _parts(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    col = b.column("nodes")
    offsets = col.offsets.to_numpy()
    return offsets - offsets[0], col.values.to_numpy()[offsets[0] : offsets[-1]]


def _sums(graph: DataFrame, state: tuple | None, spread: float) -> dict[str, np.ndarray]:
    """Per node the weight, sum and sum of squares of its documents' levels; in the last places, the moments of score against grade."""
    sc = graph.sparkSession.sparkContext
    known = sc.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = NODES + 5
        n, s, q = np.zeros(size), np.zeros(size), np.zeros(size)
        for b in batches:
            if not b.num_rows:
                continue
            offsets, flat = _parts(b)
            grade = b.column("grade").to_numpy(zero_copy_only=False).astype(float)
            y, w = grade.copy(), np.where(np.isnan(grade), 0.0, 1.0)
            if known.value is not None:
                level, weight, slope, shift = known.value
                score = _score(offsets, flat, level, weight)
                ok = ~np.isnan(score) & ~np.isnan(grade)
                x, g = score[ok], grade[ok]
                n[NODES:] += [len(x), x.sum(), g.sum(), (x * x).sum(), (x * g).sum()]
                guess = np.clip(slope * score + shift, 1, 5)
                free = np.isnan(grade) & ~np.isnan(score)
                y, w = np.where(free, guess, y), np.where(free, spread, w)
            y = np.nan_to_num(y)
            each = np.repeat(np.arange(len(y)), np.diff(offsets))
            n[:NODES] += np.bincount(flat, w[each], NODES)
            s[:NODES] += np.bincount(flat, (w * y)[each], NODES)
            q[:NODES] += np.bincount(flat, (w * y * y)[each], NODES)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(s[at]), pa.array(q[at])], names=["node", "n", "s", "q"])

    # Each task sums up its documents first, so at most NODES rows a task are shuffled, and at most NODES reach the driver.
    sums = graph.mapInArrow(run, "node int, n double, s double, q double").groupBy("node").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).toArrow()
    # Of each turn the driver and all executors would else keep a file with the whole state.
    known.destroy()
    out = {}
    for c in ("n", "s", "q"):
        a = np.zeros(NODES + 5)
        a[sums.column("node").to_numpy()] = sums.column(c).to_numpy()
        out[c] = a
    return out


def _state(sums: dict[str, np.ndarray], slope: float, shift: float) -> tuple:
    n, s, q = (sums[c][:NODES] for c in ("n", "s", "q"))
    total, mean = n.sum(), s.sum() / max(n.sum(), 1e-12)
    prior = 3.0
    level = (s + prior * mean) / (n + prior)
    spread = max((q.sum() / max(total, 1e-12)) - mean**2, 1e-6)
    variance = (q + prior * (spread + mean**2)) / (n + prior) - level**2
    weight = np.where(n >= 2, (spread / np.maximum(variance, 0.02 * spread)) ** 2 - 0.9, 0.0)
    return level.astype(np.float32), np.maximum(weight, 0).astype(np.float32), slope, shift


def reading_levels(docs: DataFrame, grades: DataFrame, doc_key: str = "doc_id", text: str = "text", grade: str = "level", iterations: int = 30, tolerance: float = 0.005, spread: float = 0.2) -> DataFrame:
    """(doc_id, level, step, graded) for each document with English running text, once.

    ``level`` is continuous from 1 to 5; ``step`` is the whole level, whose
    boundaries part graded documents with the fewest errors.

    The iterations end when the levels of nodes change by no more than ``tolerance``
    on average over edges, or after ``iterations`` at the latest. ``grades`` may hold several rows a document; their mean is clamped while
    spreading, and the reported level is the graph's estimate, calibrated on
    graded documents. An ungraded document spreads its estimate with the weight
    ``spread``. Null keys and texts, empty texts, pages without running text and
    pages in other languages give no row; of repeated keys the texts are judged
    together as one row (the highest). Without any grade the result is empty.
    """
    g = grades.where(f"`{doc_key}` is not null and `{grade}` is not null").groupBy(F.col(f"`{doc_key}`").cast("long").alias("doc_id")).agg(F.avg(f"`{grade}`").alias("grade"))
    d = docs.select(F.col(f"`{doc_key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id is not null and text is not null")
    edges = d.mapInArrow(_edges, "doc_id long, nodes array<int>").where(F.size("nodes") > 0)
    graph = cut(edges.join(maybe_broadcast(g, 32), "doc_id", "left"))
    state = _state(_sums(graph, None, spread), 1.0, 0.0)
    for turn in range(iterations):
        sums = _sums(graph, state, spread)
        k, x, y, xx, xy = sums["n"][NODES:]
        if not k:
            break
        level, weight, slope, shift = state
        if turn < WEIGHING:
            # A mean of means is narrower than the grades; the line through the graded documents widens it again.
            varied = xx - x * x / k
            slope = (xy - x * y / k) / varied if varied > 1e-9 else 1.0
            new = _state(sums, slope, (y - slope * x) / k)
        else:
            # Weights and line stay, so what is left is linear, and its harmonic solution is approached.
            new = (_state(sums, 1.0, 0.0)[0], weight, 1.0, 0.0)
        n = sums["n"][:NODES]
        moved = float((np.abs(new[0] - level) * n).sum() / max(n.sum(), 1e-12))
        state = new
        if turn >= WEIGHING and moved <= tolerance:
            break
    fixed = graph.sparkSession.sparkContext.broadcast(state)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, weight, *_ = fixed.value
        for b in batches:
            if b.num_rows:
                score = _score(*_parts(b), level, weight)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score.astype(float)), b.column("grade")], names=["doc_id", "score", "grade"])

    scored = cut(graph.mapInArrow(final, "doc_id long, score double, grade double").where("not isnan(score)"))
    discard(graph)
    fixed.destroy()
    bounded = scored.where("grade is not null").orderBy(F.xxhash64("doc_id")).limit(CALIBRATION_ROWS).select("score", "grade").toArrow()
    bends, heights = _monotone(bounded.column("score").to_numpy(), bounded.column("grade").to_numpy())
    if not len(bends):
        return scored.where("false").select("doc_id", F.col("score").alias("level"), F.lit(1).alias("step"), F.lit(False).alias("graded"))
    level = F.lit(float(heights[-1]))
    for i in range(len(bends) - 1, 0, -1):
        a, b, p, q = float(bends[i - 1]), float(bends[i]), float(heights[i - 1]), float(heights[i])
        level = F.when(F.col("score") < b, F.lit(p) + (F.col("score") - a) * ((q - p) / max(b - a, 1e-12))).otherwise(level)
    level = F.when(F.col("score") < float(bends[0]), float(heights[0])).otherwise(level)
    x, y = bounded.column("score").to_numpy(), bounded.column("grade").to_numpy()
    step = F.lit(1)
    for lower in (1, 2, 3, 4):
        cut_at = _boundary(x, y, lower + 0.5)
        step = step + (F.col("score") >= cut_at).cast("int")
    return scored.groupBy("doc_id").agg(F.max(level).alias("level"), F.max(step).alias("step"), F.max(F.col("grade").isNotNull()).alias("graded"))


def _boundary(x: np.ndarray, y: np.ndarray, grade: float) -> float:
    """The score that parts graded documents below ``grade`` from the others with the fewest errors; amid the widest gap of those."""
    order = np.argsort(x, kind="stable")
    xs, above = x[order], y[order] >= grade
    # errors[i]: the first i documents are taken to be below.
    errors = np.concatenate([[0], np.cumsum(above)]) + np.concatenate([np.cumsum(~above[::-1])[::-1], [0]])
    edges = np.concatenate([[xs[0] - 1], (xs[1:] + xs[:-1]) / 2, [xs[-1] + 1]])
    gaps = np.concatenate([[0], np.diff(xs), [0]])
    best = np.flatnonzero(errors == errors.min())
    return float(edges[best[np.argmax(gaps[best])]])


def _monotone(x: np.ndarray, y: np.ndarray, bins: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Bends of a rising line through the means of equal parts of (x, y)."""
    order = np.lexsort((y, x))
    groups = [p for p in np.array_split(order, min(bins, max(1, len(x) // 10))) if len(p)]
    blocks: list[list[float]] = []
    for p in groups:
        blocks.append([float(x[p].mean()), float(y[p].mean()), float(len(p))])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            b, a = blocks.pop(), blocks.pop()
            n = a[2] + b[2]
            blocks.append([(a[0] * a[2] + b[0] * b[2]) / n, (a[1] * a[2] + b[1] * b[2]) / n, n])
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])
