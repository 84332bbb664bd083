"""The most similar vectors of every vector, by a block join of quantised vectors.

Blocks are the buckets of several tables of random hyperplanes, so near vectors
meet in a block without all pairs being formed. In a block, int8 codes are
multiplied as matrices; with the length of what rounding took off, the products
bound each cosine from both sides. Pairs whose upper bound can't reach the k best
lower bounds are dropped, the rest are recomputed from 16-bit codes, the best k
of each row leave the block, and their cosines are recomputed in float from the
vectors themselves before the heaps of all blocks are merged.

Where no similarity is too low, near and far vectors alike have neighbours, which
hyperplanes would often part: there all pairs are compared, in double.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from bandloom.common import fits, maybe_broadcast
from bandloom.session import cut, parallelism

#: Rows that a bucket has on average; the number of hyperplanes follows from it.
BLOCK = 512
#: A bucket with more rows is split into parts of about so many, and all pairs of parts become blocks.
PART = 2048
#: Codes that a task compares, about.
TASK_BYTES = 128 << 20
_CODED = "grp long, tab int, key long, id long, code binary"


def _planes(dim: int, tab: int, bits: int) -> np.ndarray:
    return np.random.default_rng([977, dim, tab]).standard_normal((32, dim))[:bits].astype(np.float32)


def _rows(b: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, starts, lengths) of a list column without nulls."""
    col = b.column(column)
    off = col.offsets.to_numpy()
    return col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].astype(np.float32), off[:-1] - off[0], np.diff(off)


def quantise(x: np.ndarray) -> np.ndarray:
    """16-bit codes of unit rows, each row by its own largest part."""
    top = np.abs(x).max(axis=1, keepdims=True)
    return np.round(x / top * 32512).astype(np.int16)


def _code(tables: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, start, length = _rows(b, "vec")
            ids, grp, bits = (b.column(c).to_numpy() for c in ("id", "grp", "bits"))
            for dim in np.unique(length):
                if dim == 0:
                    continue
                at = np.flatnonzero(length == dim)
                x = values[start[at][:, None] + np.arange(dim)]
                norm = np.linalg.norm(x.astype(np.float64), axis=1)
                sound = np.isfinite(norm) & (norm > 0)
                x, rows = (x[sound] / norm[sound, None]).astype(np.float32), at[sound]
                if not len(rows):
                    continue
                codes = quantise(x)
                # The common level says little about likeness, so hyperplanes see what is left without it.
                z = x - x.mean(axis=1, keepdims=True) if dim > 2 else x
                data = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1, dtype=np.int32) * (2 * dim)).astype(np.int32)), pa.py_buffer(codes.tobytes())])
                for t in range(tables):
                    sign = (z @ _planes(int(dim), t, 32).T) > 0
                    used = np.arange(32) < bits[rows][:, None]
                    key = ((sign & used) * (1 << np.arange(32, dtype=np.int64))).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(grp[rows]), pa.array(np.full(len(rows), t, np.int32)), pa.array(key), pa.array(ids[rows]), data], names=["grp", "tab", "key", "id", "code"])

    return run


def best_in_block(ids_a: np.ndarray, a: np.ndarray, ids_b: np.ndarray, b: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, their neighbours): for each row of ``a`` the rows of ``b`` with the greatest cosine of the codes, ``least`` or more.

    Codes tell cosines to about 1e-6, so twice ``k`` are given; the cosines of the vectors themselves decide which k are nearest.
    """
    k = 2 * k
    fa, fb = (c.astype(np.float32) / np.linalg.norm(c.astype(np.float32), axis=1, keepdims=True) for c in (a, b))

    def int8(c: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hi = np.round(c / 256.0).astype(np.int8).astype(np.float32)
        scale = 256.0 / np.linalg.norm(c.astype(np.float32), axis=1, keepdims=True)
        return hi, scale, np.linalg.norm(full - hi * scale, axis=1)

    ha, sa, ea = int8(a, fa)
    hb, sb, eb = int8(b, fb)
    dots = (ha @ hb.T) * sa * sb.T  # exact: products of int8 sum up to less than 2^24
    slack = ea[:, None] + (1 + ea)[:, None] * eb[None, :] + 1e-5
    upper = dots + slack
    upper[ids_a[:, None] == ids_b[None, :]] = -2
    floor = np.full(len(a), least, np.float32)
    if len(b) > k and np.count_nonzero(upper >= least) > 8 * k * len(a):
        lower = np.where(upper > -2, dots - slack, -2)
        floor = np.maximum(floor, np.partition(lower, len(b) - k, axis=1)[:, len(b) - k])
    i, j = np.nonzero(upper >= floor[:, None])
    exact = np.empty(len(i), np.float32)
    for s in range(0, len(i), 1 << 16):
        exact[s : s + (1 << 16)] = np.einsum("ij,ij->i", fa[i[s : s + (1 << 16)]], fb[j[s : s + (1 << 16)]])
    keep = exact >= least - 1e-4
    i, j, exact = i[keep], j[keep], np.round(exact[keep], 7)
    order = np.lexsort((ids_b[j], -exact, i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i, "left")
    return ids_a[i[rank < k]], ids_b[j[rank < k]]


def nearest(
    df: DataFrame,
    id_col: str,
    vector: str,
    group: str | None = None,
    k: int = 5,
    min_similarity: float | None = None,
    tables: int = 3,
    block: int = BLOCK,
) -> DataFrame:
    """(id, neighbour, similarity, rank): for each vector its ``k`` nearest by cosine, within equal ``group`` and length.

    Left out are null ids, null groups, and vectors that are null, empty, zero or
    hold a null, NaN or infinity. Rows that repeat an id count once; if their vectors
    differ, the most similar counts. Equal similarities go to the smaller id. With
    ``min_similarity`` less similar neighbours are left out, and found faster.
    An empty table gives an empty result; other columns are ignored.

    Without ``min_similarity`` the result is exact: all pairs of a group are
    compared, so work grows with the square of the rows, and ``tables`` and
    ``block`` count for nothing. With it, neighbours meet in at least one of
    ``tables`` buckets with a probability that falls with their angle; tests hold
    the recall against brute force. Buckets grow in number with the table, so work
    and shuffle grow in proportion to it.
    """
    g = F.lit(0).cast("long") if group is None else F.col(f"`{group}`").cast("long")
    v = F.col(f"`{vector}`")
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), g.alias("grp"), v.cast("array<float>").alias("vec")).where("id is not null and grp is not null and size(vec) > 0")
    src = src.where(~F.exists("vec", lambda e: e.isNull() | F.isnan(e)))
    copies = _copies(src, k)
    # Of vectors that are alike in all entries one is compared, however many there are.
    single = src if copies is None else src.join(maybe_broadcast(copies[0].where("id <> rep").select("id"), 16), "id", "left_anti")
    found = _ranked(_of_all_pairs(single, k) if min_similarity is None else _in_buckets(single, k, min_similarity, tables, block), k)
    return found if copies is None else _ranked(_with_copies(found.drop("rank"), *copies), k)


def _copies(src: DataFrame, k: int) -> tuple[DataFrame, DataFrame] | None:
    """((id, rep) of ids that share all entries of their vectors, (rep, the k + 1 least ids of each)), or None if there are none.

    An id with several vectors is left as it is. No group is collected: of each
    only the least ids are ever among the k nearest of others, as ties go to them.
    """
    key = ["grp", "h1", "h2"]
    keyed = src.select("id", "grp", F.xxhash64("vec").alias("h1"), F.xxhash64(F.reverse("vec"), F.size("vec")).alias("h2"))
    shared = cut(keyed.groupBy(*key).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select(*key))
    if shared.isEmpty():
        return None
    members = cut(keyed.join(maybe_broadcast(shared, 64), key).distinct())
    several = keyed.join(maybe_broadcast(members.select("id").distinct(), 16), "id", "left_semi").distinct().groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    members = members.join(maybe_broadcast(several, 16), "id", "left_anti")
    reps = members.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = cut(members.join(maybe_broadcast(reps, 64), key).select("id", "rep"))
    least = members.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("place") <= k + 1)
    return members, cut(least.groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids")))


def _with_copies(found: DataFrame, members: DataFrame, least: DataFrame) -> DataFrame:
    """(id, neighbour, similarity): what was found for one of several copies holds for all, and each is near to the others."""
    near = least.withColumnRenamed("rep", "neighbour")
    wide = found.join(maybe_broadcast(near, 64), "neighbour", "left").select("id", F.explode(F.coalesce("ids", F.array("neighbour"))).alias("neighbour"), "similarity")
    others = wide.join(maybe_broadcast(members.select(F.col("rep").alias("id")).distinct(), 16), "id", "left_anti")
    held = wide.join(maybe_broadcast(least.select(F.col("rep").alias("id")), 16), "id", "left_semi").withColumnRenamed("id", "rep")
    for_all = members.join(maybe_broadcast(held, 64), "rep").select("id", "neighbour", "similarity")
    mates = members.join(maybe_broadcast(least, 64), "rep").select("id", F.explode("ids").alias("neighbour"), F.lit(1.0).alias("similarity"))
    return others.unionByName(for_all).unionByName(mates).where("id <> neighbour").distinct()


def _in_buckets(src: DataFrame, k: int, min_similarity: float, tables: int, block: int) -> DataFrame:
    """(id, neighbour, similarity) of pairs that meet in a bucket of hyperplanes, measured in float."""
    sizes = src.groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.size("vec")).alias("entries")).withColumn("bits", F.greatest(F.lit(0), F.least(F.lit(32), F.ceil(F.log2(F.col("n") / block)))).cast("int")).select("grp", "bits", "entries")
    sizes = cut(sizes)
    entries = sizes.agg(F.sum("entries")).first()[0] or 0
    sizes = sizes.select("grp", "bits")
    coded = src.join(F.broadcast(sizes) if fits(sizes, 16) else sizes, "grp").select("id", "grp", "bits", "vec").mapInArrow(_code(tables), _CODED)
    # Hash of the bucket, so that one column of eight bytes is the key of the shuffle.
    coded = coded.withColumn("bucket", F.xxhash64("grp", "tab", "key", F.length("code")))
    # As many tasks as their codes, of two bytes an entry, need to stay small.
    tasks = max(parallelism(src.sparkSession), -(-2 * entries * tables // TASK_BYTES))
    blocks = _blocks(coded).repartition(int(tasks), "bucket", "lo", "hi")

    def kernel(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, side = t.column("id").to_numpy(), t.column("side").to_numpy()
        raw = np.frombuffer(b"".join(t.column("code").to_pylist()), np.int16).reshape(len(ids), -1)
        order = np.lexsort((ids, side))
        ids, side, raw = ids[order], side[order], raw[order]
        if (side == 2).any():
            whole = best_in_block(ids, raw, ids, raw, k, min_similarity)
            pairs = [whole]
        else:
            one, two = side == 0, side == 1
            pairs = [best_in_block(ids[one], raw[one], ids[two], raw[two], k, min_similarity), best_in_block(ids[two], raw[two], ids[one], raw[one], k, min_similarity)] if one.any() and two.any() else []
        a = np.concatenate([np.empty(0, np.int64), *[p[0] for p in pairs]])
        b = np.concatenate([np.empty(0, np.int64), *[p[1] for p in pairs]])
        return pa.table({"id": pa.array(a), "neighbour": pa.array(b)})

    near = cut(blocks.groupBy("bucket", "lo", "hi").applyInArrow(kernel, "id long, neighbour long").distinct())
    return in_float(src.drop("grp"), near).where(F.col("similarity") >= min_similarity)


def _ranked(measured: DataFrame, k: int) -> DataFrame:
    heap = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return measured.withColumn("rank", F.row_number().over(heap)).where(F.col("rank") <= k)


def best_of_all(ids_a: np.ndarray, a: np.ndarray, ids_b: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, their neighbours, cosines): for each id of ``a`` the k ids of ``b`` with the greatest cosine of unit rows sorted by id; ties go to the smaller id."""
    (own, at_a), (others, at_b) = (np.unique(i, return_index=True) for i in (ids_a, ids_b))
    out: list[list[np.ndarray]] = [[], [], []]
    step = 512
    for s in range(0, len(own), step):
        rows = slice(at_a[s], at_a[s + step] if s + step < len(own) else len(ids_a))
        cos = a[rows] @ b.T
        # Of rows that repeat an id, the most similar counts.
        if len(others) < len(ids_b):
            cos = np.maximum.reduceat(cos, at_b, axis=1)
        if len(cos) > len(own[s : s + step]):
            cos = np.maximum.reduceat(cos, at_a[s : s + step] - at_a[s], axis=0)
        # Equal vectors may differ in the last bits of a matrix product.
        cos = np.round(np.clip(cos, -1, 1), 12)
        cos[own[s : s + step, None] == others[None, :]] = -2
        if len(others) > k:
            i, j = np.nonzero(cos >= np.maximum(np.partition(cos, len(others) - k, axis=1)[:, len(others) - k, None], -1))
        else:
            i, j = np.nonzero(cos >= -1)
        order = np.lexsort((j, -cos[i, j], i))
        i, j = i[order], j[order]
        best = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
        for o, x in zip(out, (own[s : s + step][i[best]], others[j[best]], cos[i[best], j[best]]), strict=True):
            o.append(x)
    return tuple(np.concatenate(o) if o else np.empty(0, t) for o, t in zip(out, (np.int64, np.int64, np.float64), strict=True))


def _of_all_pairs(src: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, similarity): all pairs of each group and length compared in double, the k best of each row and block kept."""
    blocks = _blocks(src.select(F.xxhash64("grp", F.size("vec")).alias("bucket"), "id", F.col("vec").alias("code")).distinct())

    def kernel(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, side = t.column("id").to_numpy(), t.column("side").to_numpy()
        x = t.column("code").chunk(0).flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
        norm = np.linalg.norm(x, axis=1)
        at = np.flatnonzero(np.isfinite(norm) & (norm > 0))
        at = at[np.argsort(ids[at], kind="stable")]
        ids, side, x = ids[at], side[at], x[at] / norm[at, None]
        one, two = side != 1, side != 0
        got = [best_of_all(ids[p], x[p], ids[q], x[q], k) for p, q in ([(one, two)] if (side == 2).any() else [(one, two), (two, one)])]
        return pa.table({c: np.concatenate(v) for c, v in zip(("id", "neighbour", "similarity"), zip(*got, strict=True), strict=True)})

    return cut(blocks.groupBy("bucket", "lo", "hi").applyInArrow(kernel, "id long, neighbour long, similarity double"))


def _blocks(coded: DataFrame) -> DataFrame:
    """Each bucket as one block (lo = hi, side 2), a large one as all pairs of its parts (sides 0 and 1)."""
    coded = coded.select("bucket", "id", "code")
    large = cut(coded.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 2 * PART).select("bucket", F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    if large.isEmpty():
        return coded.select("bucket", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(2).alias("side"), "id", "code")
    split = coded.join(F.broadcast(large) if fits(large, 16) else large, "bucket", "left")
    split = split.withColumn("own", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return split.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), side.alias("side"), "id", "code")


def in_float(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, neighbour, similarity) of ``pairs``, in double from the vectors as stored."""
    # Each pair is measured once, whichever of the two named it.
    once = pairs.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()
    hint = F.broadcast if fits(once, 48) else (lambda d: d)
    # Only vectors in pairs are joined; with few pairs they go to the vectors, not the vectors through a shuffle.
    one = vectors.select(F.col("id").alias("a"), F.col("vec").alias("va")).join(hint(once), "a").distinct()
    if fits(once, 2048):
        two = vectors.select(F.col("id").alias("b"), F.col("vec").alias("vb")).join(F.broadcast(once.select("b").distinct()), "b").distinct()
    else:
        two = vectors.select(F.col("id").alias("b"), F.col("vec").alias("vb"))
    both = one.join(two, "b")

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            (x, sx, n), (y, sy, _) = _rows(r, "va"), _rows(r, "vb")
            sim = np.empty(len(n))
            for dim in np.unique(n):
                at = np.flatnonzero(n == dim)
                for s in range(0, len(at), 1 << 14):
                    p = at[s : s + (1 << 14)]
                    u, w = (m[o[p][:, None] + np.arange(dim)].astype(np.float64) for m, o in ((x, sx), (y, sy)))
                    # Equal cosines may differ in their last bits.
                    sim[p] = np.round(np.einsum("ij,ij->i", u, w) / (np.linalg.norm(u, axis=1) * np.linalg.norm(w, axis=1)), 12)
            yield pa.RecordBatch.from_arrays([r.column("a"), r.column("b"), pa.array(sim)], names=["a", "b", "similarity"])

    sims = both.where(F.size("va") == F.size("vb")).select("a", "b", "va", "vb").mapInArrow(cosine, "a long, b long, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    return pairs.join(sims, (F.col("a") == F.least("id", "neighbour")) & (F.col("b") == F.greatest("id", "neighbour"))).select("id", "neighbour", "similarity")
