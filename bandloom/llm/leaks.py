"""Passages of held-out items inside training documents, found by winnowing.

Of every window of k-grams of words the smallest hash is kept as a fingerprint,
on both sides. Two texts that share ``span`` words in a row share a whole window
and therefore a fingerprint, so joining fingerprints finds every such span; each
hit is then extended word by word to the full run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from bandloom.session import cut

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Fingerprints of the held-out side that a worker may hold; beyond, both sides' fingerprints are joined by a shuffle.
HELD_FINGERPRINTS = 2_000_000
_RESULT = "doc_id long, item_id long, part string, n_words int"


class _Hashes(dict):
    """Hash of each word met so far; forgets all once it is large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(text: str | None, memo: dict) -> np.ndarray:
    words = _WORD.findall(text.lower()) if text else []
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def winnow(h: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, positions of their k-grams) of the word hashes ``h``; none if they don't fill a window."""
    n = len(h) - k + 1
    if n < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        grams = np.zeros(n, np.uint64)
        for j in range(k):
            grams = grams * _BASE + h[j : j + n]
        grams ^= grams >> np.uint64(29)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
    least = np.lib.stride_tricks.sliding_window_view(grams, window)
    at = np.unique(np.arange(n - window + 1) + least.argmin(axis=1))
    return grams[at], at


def _runs(doc: np.ndarray, item: np.ndarray, at: int, of: int) -> int:
    """Words in the common run through doc[at] and item[of]."""
    back = min(at, of)
    same = doc[at - back : at][::-1] == item[of - back : of][::-1]
    left = back if same.all() else int(same.argmin())
    ahead = min(len(doc) - at, len(item) - of)
    same = doc[at : at + ahead] == item[of : of + ahead]
    return left + (ahead if same.all() else int(same.argmin()))


def _items_long(items: DataFrame, key: str, parts: tuple[str, ...]) -> DataFrame:
    either = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"`{p}`").alias("text")) for p in parts]))
    return items.select(F.col(f"`{key}`").cast("long").alias("item_id"), either.alias("x")).select("item_id", "x.part", "x.text").where("item_id is not null and text is not null").distinct()


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", parts: tuple[str, ...] = ("passage", "question"), span: int = 12, k: int = 6, held: int = HELD_FINGERPRINTS) -> DataFrame:
    """(doc_id, item_id, part, n_words): documents that hold ``span`` or more consecutive words of a part, with the longest run.

    A word is a run of letters and digits in any case. Whole texts are searched.
    Repeated rows give one result; null keys and null texts, and texts under
    ``span`` words, give none; empty tables give an empty result. The held-out
    side is broadcast only if its fingerprints are counted to be at most ``held``.
    """
    window = span - k + 1
    if window < 1:
        raise ValueError("span must be at least k")
    long = cut(_items_long(items, item_key, parts))
    sides = docs.select(F.col(f"`{doc_key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id is not null and text is not null")

    def print_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Hashes()
        for b in batches:
            rows = [(f, i, p, a) for i, p, t in zip(b["item_id"], b["part"], b["text"], strict=True) for f, a in zip(*winnow(word_hashes(t, memo), k, window), strict=True)]
            frame = pd.DataFrame(rows, columns=["fp", "item_id", "part", "pos"])
            yield frame.assign(fp=frame["fp"].astype("uint64").astype("int64"))

    prints = cut(long.mapInPandas(print_items, "fp long, item_id long, part string, pos int"))
    # Parts under ``span`` words have no fingerprint and can't leak, so they go no further.
    long = long.join(prints.select("item_id", "part").distinct(), ["item_id", "part"], "left_semi")
    # One in ``window`` places is a fingerprint at least, so the words that are held are bounded, too.
    if prints.limit(held + 1).count() <= held:
        found = _against_held(sides, long, k, window, span)
    else:
        found = _by_shuffle(sides, long, prints, k, window, span)
    return found.groupBy("doc_id", "item_id", "part").agg(F.max("n_words").alias("n_words"))


def _against_held(sides: DataFrame, long: DataFrame, k: int, window: int, span: int) -> DataFrame:
    memo = _Hashes()
    rows = long.orderBy("item_id", "part").collect()  # their fingerprints, at least one in `window` words, were counted
    hashes = [word_hashes(r["text"], memo) for r in rows]
    fps, owner, pos = [], [], []
    for i, h in enumerate(hashes):
        f, a = winnow(h, k, window)
        fps.append(f)
        owner.append(np.full(len(f), i))
        pos.append(a)
    empty = np.empty(0, np.int64)
    all_fps = np.concatenate([np.empty(0, np.uint64), *fps])
    order = np.argsort(all_fps, kind="stable")
    shared = sides.sparkSession.sparkContext.broadcast((all_fps[order], np.concatenate([empty, *owner])[order], np.concatenate([empty, *pos])[order], hashes, [(r["item_id"], r["part"]) for r in rows]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, who, where, texts, names = shared.value
        memo = _Hashes()
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                h = word_hashes(text, memo)
                f, at = winnow(h, k, window)
                if not len(f) or not len(fp):
                    continue
                lo = np.searchsorted(fp, f)
                hit = np.flatnonzero(fp[np.minimum(lo, len(fp) - 1)] == f)
                best: dict[int, int] = {}
                for j in hit:
                    for x in range(lo[j], np.searchsorted(fp, f[j], "right")):
                        n = _runs(h, texts[who[x]], int(at[j]), int(where[x]))
                        if n >= span:
                            best[who[x]] = max(n, best.get(who[x], 0))
                out += [(doc, *names[w], n) for w, n in best.items()]
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32())], names=["doc_id", "item_id", "part", "n_words"])

    return sides.mapInArrow(search, _RESULT)


def _by_shuffle(sides: DataFrame, long: DataFrame, prints: DataFrame, k: int, window: int, span: int) -> DataFrame:
    def print_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for b in batches:
            fps, ids = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                f = np.unique(winnow(word_hashes(text, memo), k, window)[0])
                fps.append(f)
                ids.append(np.full(len(f), doc))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(fps).view(np.int64)), pa.array(np.concatenate(ids))], names=["fp", "doc_id"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Hashes()
        for b in batches:
            n = []
            for d, t in zip(b["text"], b["item_text"], strict=True):
                doc, item = word_hashes(d, memo), word_hashes(t, memo)
                df, da = winnow(doc, k, window)
                tf, ta = winnow(item, k, window)
                at = {}
                for f, a in zip(tf.tolist(), ta.tolist(), strict=True):
                    at.setdefault(f, []).append(a)
                n.append(max((_runs(doc, item, a, q) for f, a in zip(df.tolist(), da.tolist(), strict=True) for q in at.get(f, ())), default=0))
            yield b[["doc_id", "item_id", "part"]].assign(n_words=np.array(n, dtype="int32"))[np.array(n, dtype="int32") >= span]

    train = sides.mapInArrow(print_docs, "fp long, doc_id long")
    pairs = cut(train.join(prints.select("fp", "item_id", "part").distinct(), "fp").select("doc_id", "item_id", "part").distinct())
    texts = sides.join(pairs, "doc_id").join(long.withColumnRenamed("text", "item_text"), ["item_id", "part"])
    return texts.select("doc_id", "item_id", "part", "text", "item_text").mapInPandas(verify, _RESULT)
