"""Records of two catalogues that mean the same thing, matched without a common key.

Records, their attributes and the tokens in them form a graph. Random walks over
it give pairs of tokens that keep each other company, from which skip-gram
vectors of tokens and their pieces are trained. A record has a vector for each
attribute, the sum of its tokens' vectors, rare tokens weighing most. Records of
the two catalogues meet in the buckets of several tables of random hyperplanes,
laid through the number, the wording, or all of it. The nearest in each bucket
are compared again by the exact cosines of their attributes, and these cosines
are calibrated: a mixture of matches and others is fitted to them without any
labels, under the condition that a record matches one record of the other
catalogue at most. The share of a pair in that mixture is its confidence.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from bandloom.common import one_per_key
from bandloom.session import cut, discard, parallelism

#: Rows of the table of token pieces; a token is the mean of its pieces, so the table is as large whatever the vocabulary.
SLOTS = 1 << 15
DIM = 32
#: Parts into which training pairs are hashed; the vectors depend on this number, never on partitions.
SHARDS = 12
#: Tokens in more than this share of the records weigh less the commoner they are; there are at most as many of them as tokens in FREQUENT ** -1 records.
FREQUENT = 1 / 2000
#: The mixture is fitted to all records, those whose pairs fall into the same cells counted together. Up to so many cells (measured) the driver holds what is counted, beyond that the tasks go through it each round; the result is the same.
FIT_CELLS = 1_000_000
#: What stands for nothing.
PLACEHOLDERS = ("", "-", "none", "null", "unknown", "n/a", "na")
#: Steps of the cosines of number, origin and name (a value equal to a step is above it).
_STEPS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97)
_NONE = len(_STEPS) + 1
#: A pair's steps of (number, piece, origin, name) are its cell.
_SHAPE = (_NONE + 1, 3, _NONE + 1, _NONE + 1)
_RECORD = "rec long, side int, letters string, digits string, piece string, place array<string>, words array<string>"


def plain(text: str | None) -> str:
    decomposed = unicodedata.normalize("NFKD", (text or "").lower())
    return "".join(c for c in decomposed if not unicodedata.combining(c))


def number_parts(text: str | None) -> tuple[str, str, str]:
    """(letters, digits, piece) of a sample number in any layout; empty strings for what it lacks.

    Letters are the longest run of two or more, the piece a letter that stands alone, zeros in front don't count.
    """
    t = re.sub(r"^no(?:\.\s*|\s+)", "", plain(text).strip())
    digits = "".join(re.findall(r"[0-9]+", t)).lstrip("0")
    if t in PLACEHOLDERS or not digits:
        return "", "", ""
    runs = re.findall(r"[a-z]+", t)
    letters = max((r for r in runs if len(r) > 1), key=len, default="")
    single = [r for r in runs if len(r) == 1]
    return letters, digits, single[-1] if single else ""


def words(text: str | None) -> list[str]:
    """The words of a text, each once, without accents and in order; none of a text that stands for nothing."""
    t = plain(text).strip()
    return [] if t in PLACEHOLDERS else sorted(set(re.findall(r"[^\W_]+", t)))


def _tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        number = [number_parts(s) for s in b["number"]]
        yield pd.DataFrame({"rec": b["rec"], "side": b["side"], **{c: [n[i] for n in number] for i, c in enumerate(("letters", "digits", "piece"))}, "place": [words(o) for o in b["origin"]], "words": [words(n) for n in b["name"]]})


def pieces(token: str) -> list[str]:
    """A token (kind, colon, text) and its pieces: runs of three letters of a word, a number less each of its figures."""
    kind, text = token[:2], token[2:]
    if kind == "0:":
        digits = text.lstrip("abcdefghijklmnopqrstuvwxyz")
        return [token, "d:" + digits, *sorted({"v:" + digits[:i] + digits[i + 1 :] for i in range(len(digits))})]
    edged = f"^{text}$"
    return [token, *sorted({kind[0] + ";" + edged[i : i + 3] for i in range(len(edged) - 2)})]


class _Slots(dict):
    def __missing__(self, token: str) -> np.ndarray:
        if len(self) > 500_000:
            self.clear()
        got = self[token] = np.array([xxhash.xxh64_intdigest(p) % SLOTS for p in pieces(token)])
        return got


def _walks(classes: DataFrame, hot: DataFrame, walks: int, seed: int) -> DataFrame:
    """Pairs (a, b) of tokens: two of one record, and two a step apart: record - attribute - token - record - attribute - token."""
    drawn = lambda arr, *salt: F.get(arr, F.pmod(F.xxhash64(*salt, F.lit(seed)), F.nullif(F.size(arr), F.lit(0))).cast("int"))
    attrs = F.filter(F.array(_number_tokens(), _kind("place", "2:"), _kind("words", "3:")), lambda x: F.size(x) > 0)
    graph = classes.select("rec", attrs.alias("attrs")).where(F.size("attrs") > 0)
    # A hot token's records are hashed to buckets of about 64, so that no bucket and no list is large, and a walk may go to any record.
    bucketed = lambda df, *salt: df.join(F.broadcast(hot), "a", "left").withColumn("bucket", F.pmod(F.xxhash64(*salt), F.coalesce(F.ceil(F.col("n") / 64), F.lit(1)))).drop("n")
    held = bucketed(graph.select("rec", F.explode(F.flatten("attrs")).alias("a")), "rec").groupBy("a", "bucket").agg(F.sort_array(F.collect_list("rec")).alias("recs"))
    start = graph.select("rec", "attrs", F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("w"))
    start = start.withColumn("mine", drawn(F.col("attrs"), F.lit("m"), "rec", "w")).withColumn("a", drawn(F.col("mine"), F.lit("a"), "rec", "w"))
    near = start.select("a", drawn(drawn(F.col("attrs"), F.lit("o"), "rec", "w"), F.lit("n"), "rec", "w").alias("b"))
    hop = bucketed(start.select("rec", "w", "a"), F.lit("h"), "rec", "w").join(held, ["a", "bucket"])
    # The record where the walk started is left out of the draw.
    hop = hop.select("w", "a", drawn(F.filter("recs", lambda r: r != F.col("rec")), F.lit("r"), "rec", "w").alias("rec"))
    far = hop.where("rec is not null").join(graph, "rec").select("a", drawn(drawn(F.col("attrs"), F.lit("t"), "rec", "w", "a"), F.lit("f"), "rec", "w", "a").alias("b"))
    return near.unionByName(far).where("a <> b")


def _kind(column: str, kind: str) -> Column:
    return F.transform(column, lambda w: F.concat(F.lit(kind), w))


def _number_tokens() -> Column:
    return F.when(F.col("digits") != "", F.array(F.concat(F.lit("0:"), "letters", "digits"))).otherwise(F.array().cast("array<string>"))


def _learn_step(v: np.ndarray, c: np.ndarray, at: list[np.ndarray], to: list[np.ndarray], rate: float, r: np.random.Generator) -> None:
    """One step of skip-gram with negative sampling over pairs of tokens, each a list of slots."""
    def means(table: np.ndarray, slots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([len(s) for s in slots])
        flat = np.concatenate(slots)
        return np.add.reduceat(table[flat], np.cumsum(n) - n, axis=0) / n[:, None], flat, n

    def spread(table: np.ndarray, flat: np.ndarray, n: np.ndarray, change: np.ndarray) -> None:
        order = np.argsort(flat, kind="stable")
        rows = flat[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        total = np.add.reduceat(np.repeat(change, n, axis=0)[order], first, axis=0)
        # Bounded, so that a token met all the time can't run away.
        table[rows[first]] = np.clip(table[rows[first]] + np.clip(total, -0.5, 0.5), -2, 2)

    x, xf, xn = means(v, at)
    y, yf, yn = means(c, to)
    g = 1 - 1 / (1 + np.exp(-np.clip((x * y).sum(1), -20, 20)))
    dx, dy = g[:, None] * y, g[:, None] * x
    for _ in range(4):
        k = r.permutation(len(at))
        z = y[k]
        h = -1 / (1 + np.exp(-np.clip((x * z).sum(1), -20, 20)))
        dx = dx + h[:, None] * z
        np.add.at(dy, k, h[:, None] * x)
    spread(v, xf, xn, rate * dx)
    spread(c, yf, yn, rate * dy)


def _train(pairs: DataFrame, epochs: int, seed: int, rate: float = 0.5) -> np.ndarray:
    """Vectors of token pieces. Every shard trains on its pairs in a fixed order; after an epoch the changes are averaged over shards."""
    sc = pairs.sparkSession.sparkContext
    rng = np.random.default_rng(seed)
    vec, ctx = (rng.standard_normal((SLOTS, DIM)) / np.sqrt(DIM)).astype(np.float32), np.zeros((SLOTS, DIM), np.float32)
    sharded = cut(pairs.withColumn("h", F.xxhash64("a", "b")).withColumn("shard", F.pmod("h", F.lit(SHARDS)).cast("int")).repartition(SHARDS, "shard").sortWithinPartitions("shard", "h"))
    for epoch in range(epochs):
        shared = sc.broadcast((vec, ctx))

        def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            memo, now, a, b = _Slots(), None, [], []
            v = c = r = None

            def changes() -> Iterator[pd.DataFrame]:
                if a:
                    _learn_step(v, c, [memo[t] for t in a], [memo[t] for t in b], rate / (1 + epoch), r)
                for kind, new, old in ((0, v, shared.value[0]), (1, c, shared.value[1])):
                    at = np.flatnonzero((new != old).any(axis=1))
                    for s in range(0, len(at), 4096):
                        yield pd.DataFrame({"kind": kind, "slot": at[s : s + 4096], "change": list(new[at[s : s + 4096]] - old[at[s : s + 4096]])})

            for batch in batches:
                for shard, x, y in zip(batch["shard"], batch["a"], batch["b"], strict=True):
                    if shard != now:
                        if now is not None:
                            yield from changes()
                        now, a, b = shard, [], []
                        v, c = (m.copy() for m in shared.value)
                        r = np.random.default_rng([seed, epoch, int(shard)])
                    a.append(x)
                    b.append(y)
                    if len(a) == 512:
                        _learn_step(v, c, [memo[t] for t in a], [memo[t] for t in b], rate / (1 + epoch), r)
                        a, b = [], []
            if now is not None:
                yield from changes()

        # A shard sends at most SLOTS rows of each kind, and at most as many reach the driver. The order of sums is fixed by shard.
        in_order = sharded.repartition(SHARDS, "shard").sortWithinPartitions("shard", "h").select("shard", "a", "b")
        sums = in_order.mapInPandas(learn, "kind int, slot long, change array<float>").groupBy("kind", "slot").agg(*[F.round(F.avg(F.get("change", F.lit(d))), 6).cast("float").alias(f"c{d}") for d in range(DIM)])
        got = sums.toArrow()
        change = np.stack([got.column(f"c{d}").to_numpy() for d in range(DIM)], axis=1).astype(np.float32) if got.num_rows else np.empty((0, DIM), np.float32)
        kind, slot = got.column("kind").to_numpy(), got.column("slot").to_numpy()
        vec, ctx = vec.copy(), ctx.copy()
        vec[slot[kind == 0]] += change[kind == 0]
        ctx[slot[kind == 1]] += change[kind == 1]
        shared.unpersist()
    discard(sharded)
    return vec


class Weigher:
    """Weights of tokens by their rarity; those not told are rarer than FREQUENT."""

    def __init__(self, counts: dict[str, int], records: int):
        self.rare = float(np.log(1 + 1 / FREQUENT))
        self.of = {t: float(np.log(1 + records / max(n, records * FREQUENT))) for t, n in counts.items()}

    def __call__(self, token: str) -> float:
        return self.of.get(token, self.rare)


def _attributes(letters: str, digits: str, place: Sequence[str], said: Sequence[str]) -> list[list[str]]:
    return [[f"0:{letters}{digits}"] if digits else [], [f"2:{w}" for w in place], [f"3:{w}" for w in said]]


def _sparse(tokens: list[str], weigh: Weigher) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, weights of length one) of tokens and their pieces: the pieces of a token weigh together as much as it does."""
    got: dict[int, float] = {}
    for t in tokens:
        own = pieces(t)
        whole = 2 if t[0] == "0" else 1
        w = weigh(t)
        for i, p in enumerate(own):
            h = xxhash.xxh32_intdigest(p)
            got[h] = got.get(h, 0.0) + (w if i < whole else w / np.sqrt(len(own) - whole))
    h = np.fromiter(sorted(got), np.uint32, len(got))
    v = np.array([got[int(k)] for k in h], np.float32)
    return h, v / max(np.linalg.norm(v), 1e-9) if len(v) else v


def _embed(vec: np.ndarray, weigh: Weigher) -> object:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Slots()
        table, w = vec.value, weigh.value
        for b in batches:
            codes, hashes, weights, sizes, known = [], [], [], [], []
            for row in zip(b["letters"], b["digits"], b["place"], b["words"], strict=True):
                attrs = _attributes(*row)
                dense, hs, vs = [], [], []
                for tokens in attrs:
                    d = np.zeros(DIM, np.float32)
                    for t in tokens:
                        x = table[memo[t]].mean(axis=0)
                        d += w(t) * x / max(np.linalg.norm(x), 1e-9)
                    dense.append(d / max(np.linalg.norm(d), 1e-9))
                    h, v = _sparse(tokens, w)
                    hs.append(h)
                    vs.append(v)
                codes.append(np.round(np.concatenate(dense) * 127).astype(np.int8).tobytes())
                sizes.append([len(h) for h in hs])
                hashes.append(np.concatenate(hs).astype(np.uint32).tobytes())
                weights.append(np.round(np.concatenate(vs) * 32767).astype(np.int16).tobytes())
                known.append(sum(1 << i for i, t in enumerate(attrs) if t))
            yield pd.DataFrame({"rec": b["rec"], "side": b["side"], "piece": b["piece"], "known": np.array(known, np.int32), "code": codes, "sizes": sizes, "hashes": hashes, "weights": weights})

    return run


#: The attributes (number, origin, name) that each view of the hyperplanes looks at, and its share of the tables. Equal numbers are in one bucket of any table; wordings are only alike.
_VIEWS = ((0,), (1, 2), (0, 1, 2))
_SHARES = (1 / 6, 1, 1 / 3)


def _planes(view: int, tab: int) -> np.ndarray:
    mask = np.repeat([i in _VIEWS[view] for i in range(3)], DIM)
    return (np.random.default_rng([311, view, tab]).standard_normal((32, 3 * DIM)) * mask).astype(np.float32)


def _centred(b: pa.RecordBatch | pa.Table, mean: np.ndarray) -> np.ndarray:
    """Vectors less the mean of all; zero for attributes that a record lacks. The common part says little about likeness."""
    x = np.frombuffer(b"".join(b.column("code").to_pylist()), np.int8).reshape(b.num_rows, 3, DIM).astype(np.float32)
    there = (b.column("known").to_numpy()[:, None] >> np.arange(3) & 1).astype(bool)
    return np.where(there[..., None], x - mean, 0).reshape(b.num_rows, -1)


def _mean(vectors: DataFrame) -> np.ndarray:
    """The mean vector of each attribute over all records that have it; a row a task is added up."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 * DIM + 3, np.int64)
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column("code").to_pylist()), np.int8).reshape(b.num_rows, -1)
                total[:-3] += x.sum(axis=0, dtype=np.int64)
                total[-3:] += (b.column("known").to_numpy()[:, None] >> np.arange(3) & 1).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

    total = np.zeros(3 * DIM + 3)
    for r in vectors.select("code", "known").mapInArrow(sums, "i int, v long").groupBy("i").agg(F.sum("v").alias("v")).collect():
        total[r["i"]] = r["v"]
    return (total[:-3].reshape(3, DIM) / np.maximum(total[-3:, None], 1)).astype(np.float32)


def _signatures(tables: int, bits: int, mean: np.ndarray) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep = _planes(2, 1000)
        for b in batches:
            if not b.num_rows:
                continue
            x, known = _centred(b, mean), b.column("known").to_numpy()
            finer = ((x @ deep.T > 0) * (1 << np.arange(32, dtype=np.int64))).sum(axis=1)
            for view, attrs in enumerate(_VIEWS):
                at = np.flatnonzero((known & sum(1 << i for i in attrs)) > 0)
                for t in range(int(np.ceil(tables * _SHARES[view])) if len(at) else 0):
                    key = ((x[at] @ _planes(view, t)[:bits].T > 0) * (1 << np.arange(bits, dtype=np.int64))).sum(axis=1)
                    own = b.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), view * tables + t, np.int32)), pa.array(key), pa.array(finer[at]), own.column("rec"), own.column("side"), own.column("known"), own.column("code")], names=["tab", "key", "finer", "rec", "side", "known", "code"])

    return run


def candidates(vectors: DataFrame, n_first: int, neighbours: int, tables: int, block: int) -> DataFrame:
    """(rec_a, rec_b): for each record of the second catalogue its nearest of the first, by every view of the hyperplanes.

    Buckets hold ``block`` records of the first catalogue on average. One that
    holds more than 16 times as many is split by further hyperplanes through
    all attributes, so a number or a place that a third of all records share
    costs no more than others: there the nearest by everything else are taken.
    """
    bits = max(0, int(np.ceil(np.log2(max(n_first, 1) / block))))
    mean = _mean(vectors)
    coded = vectors.select("rec", "side", "known", "code").mapInArrow(_signatures(tables, bits, mean), "tab int, key long, finer long, rec long, side int, known int, code binary")
    hot = coded.groupBy("tab", "key").agg(F.count("*").alias("n")).where(F.col("n") > 16 * block)
    # Buckets that large are at most one in 16 * block rows; what is broadcast is a thousandth of the rows or less, and checked.
    sizes = hot.select("tab", "key", F.least(F.lit(32), F.ceil(F.log2(F.col("n") / (4 * block)))).cast("int").alias("more"))
    sizes = cut(sizes)
    split = coded.join(F.broadcast(sizes) if sizes.count() <= 500_000 else sizes, ["tab", "key"], "left")
    split = split.withColumn("finer", F.when(F.col("more").isNotNull(), F.expr("finer & (shiftleft(1L, more) - 1)")).otherwise(F.lit(0)).cast("long")).withColumn("bucket", F.xxhash64("tab", "key", "finer"))
    masks = [np.repeat([i in attrs for i in range(3)], DIM) for attrs in _VIEWS]

    def kernel(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        rec, side = t.column("rec").to_numpy(), t.column("side").to_numpy()
        view = int(t.column("tab")[0].as_py()) // tables
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(one) or not len(two):
            return pa.table({"rec_b": pa.array([], pa.int64()), "rec_a": pa.array([], pa.int64()), "view": pa.array([], pa.int32()), "near": pa.array([], pa.float32())})
        one = one[np.argsort(rec[one], kind="stable")]
        x = _centred(t, mean)[:, masks[view]]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        out: list[list[np.ndarray]] = [[], [], []]
        k = min(neighbours, len(one))
        for s in range(0, len(two), 1024):
            rows = two[s : s + 1024]
            near = np.round(x[rows] @ x[one].T, 4)
            best = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < len(one) else np.broadcast_to(np.arange(len(one)), near.shape)
            out[0].append(np.repeat(rec[rows], k))
            out[1].append(rec[one][best].ravel())
            out[2].append(np.take_along_axis(near, best, axis=1).ravel())
        return pa.table({"rec_b": np.concatenate(out[0]), "rec_a": np.concatenate(out[1]), "view": pa.array(np.full(sum(map(len, out[0])), view, np.int32)), "near": pa.array(np.concatenate(out[2]).astype(np.float32))})

    near = split.select("bucket", "tab", "rec", "side", "known", "code").groupBy("bucket").applyInArrow(kernel, "rec_b long, rec_a long, view int, near float")
    # The same pair from several tables counts once; the nearest of each view go on.
    heap = F.slice(F.sort_array(F.collect_set(F.struct((-F.col("near")).alias("far"), "rec_a"))), 1, neighbours)
    return near.groupBy("rec_b", "view").agg(heap.alias("best")).select("rec_b", F.explode("best.rec_a").alias("rec_a")).distinct()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact cosines of number, origin and name of pairs of records; null where one of them lacks it."""
    for r in batches:
        if not r.num_rows:
            continue
        n = r.num_rows
        size = [np.array(r.column(f"sizes_{s}").to_pylist(), np.int64).reshape(n, 3) for s in "ab"]
        keys, vals = [], []
        for s in (0, 1):
            h = np.frombuffer(b"".join(r.column(f"hashes_{'ab'[s]}").to_pylist()), np.uint32).astype(np.int64)
            w = np.frombuffer(b"".join(r.column(f"weights_{'ab'[s]}").to_pylist()), np.int16).astype(np.float64) / 32767
            cell = np.repeat(np.arange(n * 3), size[s].ravel())
            keys.append((cell << 32) | h)
            vals.append(w)
        # Hashes are sorted within an attribute, so keys are sorted; equal ones are shared pieces.
        at = np.searchsorted(keys[0], keys[1])
        at = np.minimum(at, max(len(keys[0]) - 1, 0))
        hit = keys[0][at] == keys[1] if len(keys[0]) else np.zeros(len(keys[1]), bool)
        shared = np.bincount(keys[1][hit] >> 32, vals[1][hit] * vals[0][at[hit]], n * 3).reshape(n, 3)
        code = [np.frombuffer(b"".join(r.column(f"code_{s}").to_pylist()), np.int8).astype(np.float64).reshape(n, 3, DIM) for s in "ab"]
        norm = np.linalg.norm(code[0], axis=2) * np.linalg.norm(code[1], axis=2)
        dense = (code[0] * code[1]).sum(axis=2) / np.maximum(norm, 1e-9)
        both = (size[0] > 0) & (size[1] > 0)
        # Words that keep the same company are alike in their trained vectors; a number is itself or isn't.
        cosine = np.where([True, False, False], shared, (shared + np.maximum(dense, 0)) / 2)
        cols = [pa.array(np.where(both[:, i], np.clip(cosine[:, i], 0, 1), np.nan), from_pandas=True) for i in range(3)]
        yield pa.RecordBatch.from_arrays([r.column("rec_a"), r.column("rec_b"), *cols, r.column("piece_a"), r.column("piece_b")], names=["rec_a", "rec_b", "number", "origin", "name", "piece_a", "piece_b"])


def _stepped(pairs: DataFrame) -> DataFrame:
    """The cosines as steps; ``piece``: 0 where just one or both name different ones, 1 the same, 2 where there is no number to have pieces."""
    step = lambda c: F.when(F.col(c).isNull(), _NONE).otherwise(sum((F.col(c) >= s).cast("int") for s in _STEPS)).cast("int")
    piece = F.when(F.col("number").isNull(), 2).when(F.col("piece_a") == F.col("piece_b"), 1).otherwise(0)
    return pairs.select("rec_a", "rec_b", "cosine", step("number").alias("s_number"), piece.cast("int").alias("s_piece"), step("origin").alias("s_origin"), step("name").alias("s_name"))


def _stratum(number: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Pairs that aren't matches resemble each other in ways that depend on their numbers: absent, other, alike with another piece, alike."""
    return np.where(number == _NONE, 0, np.where(number == 0, 1, np.where(piece == 0, 2, 3)))


def expected(batches: Iterable[pa.RecordBatch], odds: np.ndarray) -> np.ndarray:
    """For each cell how many matches are expected, in units of 2 ** -30: whole numbers, so their sum is the same in any order.

    A row of the batches is ``n`` records of the second catalogue whose pairs
    fall into the same sorted ``cells``; at most one pair of a record is a match.
    """
    total = np.zeros(len(odds), np.int64)
    for r in batches:
        if not r.num_rows:
            continue
        at, size, n = r.column("cells").flatten().to_numpy(), r.column("cells").value_lengths().to_numpy(), r.column("n").to_numpy()
        e = np.exp(np.minimum(odds[at], 50))
        post = e / np.repeat(1 + np.add.reduceat(e, np.cumsum(size) - size), size)
        np.add.at(total, at, np.rint(post * 2**30).astype(np.int64) * np.repeat(n, size))
    return total


def fit_mixture(pairs: np.ndarray, first: np.ndarray, high: np.ndarray, matches: Callable[[np.ndarray], np.ndarray], rounds: int = 60) -> np.ndarray:
    """Log odds of a match for each (number, piece, origin, name) step, by expectation maximisation.

    All arrays have a number for each cell: how many ``pairs`` are in it, how
    many of them are the most alike of their record of the second catalogue
    (``first``), and how many of these have a ``high`` cosine over all
    attributes; at first those are taken for matches. ``matches`` gives the
    expected matches of all records under given odds. Numbers that share nothing
    (step 0) are no match: that is assumed, all else is estimated.
    The result is a number for each cell, too.
    """
    n, p, o, w = (x.ravel() for x in np.indices(_SHAPE))
    z = _stratum(n, p)
    can = n > 0
    post = np.where(can, 0.9 * high + 0.5 * (first - high), 0.0)

    def shares(x: np.ndarray, weight: np.ndarray, size: int, prior: float) -> np.ndarray:
        c = np.bincount(x, weight, size) + prior
        return (c / c.sum())[x]

    def by_stratum(x: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
        whole = np.bincount(x, weight, size) + 0.5
        c = np.bincount(z * size + x, weight, 4 * size).reshape(4, size) + 5 * whole / whole.sum()
        return (c / c.sum(axis=1, keepdims=True))[z, x]

    # What surely isn't a match tells how origin and name resemble each other without one.
    sure = np.where(can, pairs - first, pairs).astype(float)
    by_o, by_w = by_stratum(o, sure, _SHAPE[2]), by_stratum(w, sure, _SHAPE[3])
    odds = np.full(len(n), -50.0)
    for _ in range(rounds if pairs.any() else 0):
        rest = pairs - post
        yes = shares(n * 3 + p, post, _SHAPE[0] * 3, 0.05) * shares(o, post, _SHAPE[2], 0.05) * shares(w, post, _SHAPE[3], 0.05) * max(post.sum(), 1e-6)
        no = shares(n * 3 + p, rest, _SHAPE[0] * 3, 0.05) * by_o * by_w * max(rest.sum(), 1e-6)
        odds = np.where(can, np.log(yes) - np.log(no), -50.0)
        post = matches(odds) / 2**30
    return odds


def match(a: DataFrame, b: DataFrame, key: str, name: str, number: str, origin: str, neighbours: int = 6, tables: int = 12, block: int = 1024, walks: int = 3, epochs: int = 2, least: float = 0.5) -> DataFrame:
    """(key_a, key_b, cosine, confidence): the matches of ``b`` in ``a``, with a confidence above ``least``.

    The first catalogue lists a thing once, so a record of ``b`` matches one of
    ``a`` at most; several of ``b`` may match the same. Records of ``a`` that
    can't be told apart by their attributes share the confidence. Keys of the two
    tables must differ. Rows that repeat a key count once, rows with a null key
    not at all; null and empty attributes and placeholders say nothing, and a
    record without any attribute matches none. An empty table gives an empty
    result; other columns are ignored.
    """
    pairs, classes, records, spent = compared(a, b, key, name, number, origin, neighbours, tables, block, walks, epochs)
    stepped = cut(_stepped(pairs))
    discard(*spent)
    odds = _fitted(stepped)
    table = stepped.sparkSession.sparkContext.broadcast(odds.astype(np.float32))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            at = np.ravel_multi_index([r.column(c).to_numpy() for c in ("s_number", "s_piece", "s_origin", "s_name")], _SHAPE)
            yield pa.RecordBatch.from_arrays([r.column("rec_a"), r.column("rec_b"), r.column("cosine"), pa.array(np.exp(np.minimum(table.value[at].astype(float), 50)))], names=["rec_a", "rec_b", "cosine", "odds"])

    weighed = stepped.mapInArrow(weigh, "rec_a long, rec_b long, cosine double, odds double")
    sizes = classes.where("side = 0").select(F.col("rec").alias("rec_a"), "copies")
    best = weighed.join(sizes, "rec_a").groupBy("rec_b").agg(F.sum(F.col("odds") * F.col("copies")).alias("all"), F.max(F.struct("odds", (-F.col("rec_a")).alias("minus"), "cosine")).alias("top"))
    best = best.select("rec_b", (-F.col("top.minus")).alias("key_a"), F.col("top.cosine").alias("cosine"), (F.col("top.odds") / (1 + F.col("all"))).alias("confidence")).where(F.col("confidence") > least)
    # Records that read alike share their match.
    alike = classes.where("side = 1").select(F.col("rec").alias("rec_b"), "sign").join(records.where("side = 1").select("sign", F.col("rec").alias("key_b")), "sign")
    return best.join(alike, "rec_b").select("key_a", "key_b", "cosine", "confidence")


def compared(a: DataFrame, b: DataFrame, key: str, name: str, number: str, origin: str, neighbours: int, tables: int, block: int, walks: int, epochs: int, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame, tuple[DataFrame, ...]]:
    """(pairs with the cosines of their attributes, classes of records that read alike, records, cuts that only the pairs read)."""
    def lean(df: DataFrame, side: int) -> DataFrame:
        one = one_per_key(df.select(key, name, number, origin, *[c for c in ("loadedat",) if c in df.columns and c not in (key, name, number, origin)]), key)
        return one.select(F.col(f"`{key}`").cast("long").alias("rec"), F.lit(side).alias("side"), *[F.col(f"`{c}`").cast("string").alias(n) for c, n in ((name, "name"), (number, "number"), (origin, "origin"))])

    sign = F.md5(F.to_json(F.struct("letters", "digits", "piece", "place", "words")))
    records = cut(lean(a, 0).unionByName(lean(b, 1)).mapInPandas(_tokenise, _RECORD).where("digits <> '' or size(place) > 0 or size(words) > 0").withColumn("sign", sign))
    first = F.min_by(F.struct("letters", "digits", "piece", "place", "words"), "rec")
    classes = cut(records.groupBy("side", "sign").agg(F.min("rec").alias("rec"), F.count("*").alias("copies"), first.alias("x")).select("rec", "side", "sign", "copies", "x.*"))
    tokens = classes.select(F.explode(F.concat(_number_tokens(), _kind("place", "2:"), _kind("words", "3:"))).alias("a"))
    counts = tokens.groupBy("a").agg(F.count("*").alias("n"))
    n_records, n_first = classes.count(), classes.where("side = 0").count()
    hot = counts.where(F.col("n") >= max(2.0, n_records * FREQUENT))
    # Tokens in FREQUENT of the records or more: a record's mean number of tokens times 1 / FREQUENT at most.
    common = cut(hot)
    told = {r["a"]: r["n"] for r in common.collect()}
    pairs = _walks(classes, common, walks, seed)
    sc = classes.sparkSession.sparkContext
    vec = sc.broadcast(_train(pairs, epochs, seed))
    shape = "rec long, side int, piece string, known int, code binary, sizes array<int>, hashes binary, weights binary"
    vectors = cut(classes.repartition(parallelism(classes.sparkSession)).mapInPandas(_embed(vec, sc.broadcast(Weigher(told, n_records))), shape))
    found = cut(candidates(vectors, n_first, neighbours, tables, block))
    part = lambda s: vectors.where(F.col("side") == "ab".index(s)).select(F.col("rec").alias(f"rec_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("piece", "code", "sizes", "hashes", "weights")])
    both = found.join(part("a"), "rec_a").join(part("b"), "rec_b")
    full = both.mapInArrow(_compare, "rec_a long, rec_b long, number double, origin double, name double, piece_a string, piece_b string")
    known = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    told_by = sum(F.col(c).isNotNull().cast("int") for c in ("number", "origin", "name"))
    piece = F.when(F.col("number").isNotNull() & (F.col("piece_a") != F.col("piece_b")), 0.7).otherwise(1.0)
    return full.withColumn("cosine", (known("number") * piece + known("origin") + known("name")) / F.greatest(told_by, F.lit(2))), classes, records, (vectors, found)


def _fitted(stepped: DataFrame, bound: int = FIT_CELLS) -> np.ndarray:
    """The mixture fitted to the candidates of all records."""
    step = F.expr(f"((s_number * 3 + s_piece) * {_NONE + 1} + s_origin) * {_NONE + 1} + s_name").cast("int")
    celled = stepped.select("rec_b", "rec_a", F.col("cosine").cast("float").alias("cosine"), "s_number", step.alias("cell"))
    # A record has a few candidates by each view, so its list is short; pairs that can't be matches stay out of it.
    top = F.min(F.struct((-F.col("cosine")).alias("far"), "rec_a", "cell")).alias("top")
    grouped = celled.groupBy("rec_b").agg(top, F.sort_array(F.collect_list(F.when(F.col("s_number") > 0, F.col("cell")))).alias("cells"))
    profiles = cut(grouped.groupBy("cells", F.col("top.cell").alias("first"), (F.col("top.far") <= F.lit(-0.8).cast("float")).alias("high")).agg(F.count("*").alias("n")))

    def by_cell(counts: DataFrame) -> np.ndarray:
        got, out = counts.toArrow(), np.zeros(int(np.prod(_SHAPE)), np.int64)
        out[got.column(0).to_numpy()] = got.column(1).to_numpy()
        return out

    # At most as many rows as there are cells reach the driver.
    pairs = by_cell(celled.groupBy("cell").agg(F.count("*")))
    first, high = (by_cell(profiles.where(c).groupBy("first").agg(F.sum("n"))) for c in ("true", "high"))
    likely = profiles.where(F.size("cells") > 0).select("cells", "n")
    if (likely.agg(F.sum(F.size("cells"))).first()[0] or 0) <= bound:
        held = likely.groupBy("cells").agg(F.sum("n").alias("n")).toArrow().to_batches()
        odds = fit_mixture(pairs, first, high, lambda odds: expected(held, odds))
    else:

        def matches(odds: np.ndarray) -> np.ndarray:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = expected(batches, odds)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "v"])

            return by_cell(likely.mapInArrow(run, "cell int, v long").groupBy("cell").agg(F.sum("v")))

        odds = fit_mixture(pairs, first, high, matches)
    discard(profiles)
    return odds
