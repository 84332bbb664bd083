"""Sources mixed to target shares of all tokens, with a cap on how often a document is used.

A document belongs to its source; where that isn't told, a classifier learnt from
the labelled documents gives a probability for each. Rates of use are found by
projected-gradient least squares: they stay between nothing and the cap, and the
expected tokens of every source come as near their target as they can.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from bandloom.session import cut

#: Hashed words of the classifier; its counts are SLOTS numbers a source, whatever the vocabulary.
SLOTS = 1 << 15
#: Documents that are rounded to whole copies one after the other; each such slice is off by less than a document.
SLICE_ROWS = 20_000
_WORD = re.compile(r"[^\W_]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def encoder(path: str) -> object:
    """A counter of tokens from a file of byte-pair ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Slots(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh32_intdigest(word) % SLOTS
        return h


def _bag(text: str, memo: dict) -> np.ndarray:
    words = set(_WORD.findall(text.lower()))
    return np.fromiter((memo[w] for w in words), np.int64, len(words))


#: How much of the evidence of a text's words may count; the best of these is chosen on held-out documents.
SCALES = (0.0, 0.01, 0.03, 0.1, 0.2, 0.4, 0.7, 1.0, 1.5)


def _posterior(bag: np.ndarray, odds: np.ndarray, prior: np.ndarray, scale: float) -> np.ndarray:
    # Words of a text aren't independent; their evidence is spread over the square root of their number.
    z = prior + scale * odds[:, bag].sum(axis=1) / max(1.0, np.sqrt(len(bag)))
    e = np.exp(z - z.max())
    return e / e.sum()


def _odds(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log odds of hashed words by source, log prior) from documents by source and word, and by source alone in the last column."""
    n = counts[:, SLOTS]
    share = (counts[:, :SLOTS] + 0.5) / (n[:, None] + 1)
    return np.log(share) - np.log(share.mean(axis=0)), np.log((n + 1) / (n.sum() + len(n)))


def _learn(docs: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, float]:
    """(log odds of hashed words by source, log prior, scale of the evidence) from all labelled documents (source, text, held).

    The scale is the one of SCALES under which those four fifths of the documents
    that aren't ``held`` predict the others with the least log loss: where texts
    tell nothing about their source, the prior is left.
    """
    index = {s: i for i, s in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, counts = _Slots(), np.zeros((2, len(names), SLOTS + 1), np.int64)
        for b in batches:
            for s, t, h in zip(*(b.column(c).to_pylist() for c in ("source", "text", "held")), strict=True):
                counts[int(h), index[s], _bag(t, memo)] += 1
                counts[int(h), index[s], SLOTS] += 1
        held, at, slot = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(counts[held, at, slot])], names=["held", "at", "slot", "n"])

    # Summed up in each task before the shuffle; at most twice SLOTS numbers a source reach the driver.
    got = docs.mapInArrow(count, "held int, at int, slot int, n long").groupBy("held", "at", "slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, len(names), SLOTS + 1))
    counts[tuple(got.column(c).to_numpy() for c in ("held", "at", "slot"))] = got.column("n").to_numpy()
    known = docs.sparkSession.sparkContext.broadcast(tuple(x.astype(np.float32) for x in _odds(counts[0])))

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, total = _Slots(), np.zeros(len(SCALES))
        for b in batches:
            for s, t in zip(b.column("source").to_pylist(), b.column("text").to_pylist(), strict=True):
                bag = _bag(t, memo)
                total += [-np.log(max(_posterior(bag, *known.value, x)[index[s]], 1e-12)) for x in SCALES]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(SCALES), dtype=np.int32)), pa.array(total)], names=["i", "loss"])

    rows = docs.where("held").select("source", "text").mapInArrow(losses, "i int, loss double").groupBy("i").agg(F.sum("loss").alias("loss")).collect()
    best = min(rows, key=lambda r: (round(r["loss"], 6), r["i"]))["i"] if rows else 0
    return *_odds(counts.sum(axis=0)), SCALES[best]


def members(docs: DataFrame, names: list[str], doc_key: str, text: str, source: str, tokenizer: str) -> DataFrame:
    """(doc_id, source, tokens, member): the shares in the sources ``names`` of each document that has tokens."""
    d = docs.select(F.col(f"`{doc_key}`").cast("long").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text")).where("doc_id is not null and text is not null and text <> ''")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    odds, prior, scale = _learn(d.where(F.col("source").isin(names)).select("source", "text", held.alias("held")), names)
    shared = d.sparkSession.sparkContext.broadcast((odds.astype(np.float32), prior, scale))
    index = {s: i for i, s in enumerate(names)}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, memo = encoder(tokenizer), _Slots()
        table, base, weight = shared.value
        for b in batches:
            texts, sources = b.column("text").to_pylist(), b.column("source").to_pylist()
            n = np.array([len(enc.encode_ordinary(t)) for t in texts], np.int64)
            share = np.zeros((len(texts), len(names)), np.float32)
            for i, (s, t) in enumerate(zip(sources, texts, strict=True)):
                if s in index:
                    share[i, index[s]] = 1
                elif s is None:
                    share[i] = _posterior(_bag(t, memo), table, base, weight)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(names)), pa.array(share.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n), flat], names=["doc_id", "source", "tokens", "member"])

    rows = d.mapInArrow(measure, "doc_id long, source string, tokens long, member array<float>").where("tokens > 0")
    # A repeated key is one document: the version with the fewest tokens.
    return rows.groupBy("doc_id").agg(F.min(F.struct("tokens", "source", "member")).alias("m")).select("doc_id", "m.source", "m.tokens", "m.member")


def _tops(member: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """How often a document may be used: the least cap of the sources that it may belong to."""
    return np.where(member > 0, caps, np.inf).min(axis=1, initial=np.inf)


def _rounded(rate: np.ndarray, weight: np.ndarray, top: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Rates as whole copies, one by one: up or down, whichever keeps the tokens used so far nearer to those wanted in all sources.

    ``weight`` are the tokens of a document by source; ``state`` (used less wanted) goes on from call to call.
    """
    out = np.empty(len(rate), np.int32)
    for i, (r, w, t) in enumerate(zip(rate, weight, top, strict=True)):
        low = min(np.floor(r), t)
        down, up = state + (low - r) * w, state + (low + 1 - r) * w
        more = low + 1 <= t and r > low and (up * up).sum() < (down * down).sum()
        state[:] = up if more else down
        out[i] = low + more
    return out


def _rates(member: np.ndarray, caps: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the gradient steps so far, each cut off to lie between nothing and the document's cap."""
    top = _tops(member, caps)
    r = np.zeros(len(member))
    for s in steps:
        r = np.clip(r + member @ s, 0, top)
    return r


def mix(docs: DataFrame, targets: DataFrame, doc_key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str | None = None, iterations: int = 40, tolerance: float = 1e-3, total_tokens: int | None = None) -> DataFrame:
    """(doc_id, source, tokens, member, rate, copies): how often to use each document.

    ``targets`` has source, targetshare and maxrepeats, a row a source. Without
    ``total_tokens`` the mixture is the largest whose shares can all be reached.
    ``copies`` is the rate rounded up or down so that the tokens used keep to those
    wanted document by document, in the order of a hash within slices of about
    SLICE_ROWS documents; it never exceeds maxrepeats of a document's source (or
    the smallest of those it may belong to). Documents of sources without a target,
    null keys, null and empty texts get no row. Shares that can't be reached come as
    near as the caps allow. Empty tables, or no targets, give an empty result.
    """
    # One row a source: a list of sources, not of records.
    rows = sorted((r for r in targets.where("source is not null").groupBy("source").agg(F.max("targetshare").alias("share"), F.max("maxrepeats").alias("cap")).collect()), key=lambda r: r["source"])
    names = [r["source"] for r in rows]
    shape = "doc_id long, source string, tokens long, member array<float>, rate double, copies int"
    if not names:
        return docs.sparkSession.createDataFrame([], shape)
    goal, caps = np.array([float(r["share"]) for r in rows]), np.array([float(r["cap"]) for r in rows])
    goal = goal / goal.sum()
    m = cut(members(docs, names, doc_key, text, source, tokenizer or default_tokenizer()).where(F.exists("member", lambda x: x > 0)))
    sc = m.sparkSession.sparkContext

    def parts(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        col = b.column("member")
        o = col.offsets.to_numpy()
        return col.values.to_numpy()[o[0] : o[-1]].reshape(-1, len(names)).astype(float), b.column("tokens").to_numpy().astype(float)

    def totals(steps: list[np.ndarray] | None) -> np.ndarray:
        """Tokens of each source at the present rates; at the caps where ``steps`` is None."""
        known = sc.broadcast(steps)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = np.zeros(len(names))
            for b in batches:
                if b.num_rows:
                    share, n = parts(b)
                    r = _tops(share, caps) if known.value is None else _rates(share, caps, known.value)
                    t += (share * (r * n)[:, None]).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names), dtype=np.int32)), pa.array(t)], names=["at", "t"])

        out = np.zeros(len(names))
        for r in m.select("tokens", "member").mapInArrow(run, "at int, t double").groupBy("at").agg(F.sum("t").alias("t")).collect():
            out[r["at"]] = r["t"]
        return out

    most = totals(None)
    wanted = np.where(goal > 0, goal, 0)
    possible = np.min(np.where(goal > 0, most / np.maximum(goal, 1e-12), np.inf))
    aim = wanted * (total_tokens if total_tokens is not None else possible)
    steps: list[np.ndarray] = []
    for _ in range(iterations):
        left = aim - (totals(steps) if steps else np.zeros(len(names)))
        if np.abs(left).max() <= tolerance * max(aim.sum(), 1):
            break
        # The gradient of the squared relative error; the step is the inverse of a source's size, its curvature.
        steps.append(np.where(most > 0, caps * left / np.maximum(most, 1e-12), 0))
    done = sc.broadcast(steps)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, np.zeros(len(names))
        for b in batches:
            if not b.num_rows:
                continue
            share, tokens = parts(b)
            rate, top = _rates(share, caps, done.value), _tops(share, caps)
            slices, copies = b.column("slice").to_numpy(), np.empty(b.num_rows, np.int32)
            for s in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(slices)) + 1):
                if slices[s[0]] != now:
                    now, state = slices[s[0]], np.zeros(len(names))
                copies[s] = _rounded(rate[s], share[s] * tokens[s, None], top[s], state)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("tokens"), b.column("member"), pa.array(rate), pa.array(copies)], names=["doc_id", "source", "tokens", "member", "rate", "copies"])

    n_slices = max(1, int(np.ceil(m.count() / SLICE_ROWS)))
    h = F.xxhash64("doc_id")
    sliced = m.select("doc_id", "source", "tokens", "member", F.pmod(h, F.lit(n_slices)).cast("int").alias("slice"), h.alias("h"))
    ordered = sliced.repartition(n_slices, "slice").sortWithinPartitions("slice", "h", "doc_id").drop("h")
    return ordered.mapInArrow(decide, shape)


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, share, tokens, documents, most_copies) that a mixture reached, a row a target."""
    names = sorted(r["source"] for r in targets.where("source is not null").select("source").distinct().collect())
    each = mixture.select(F.posexplode("member").alias("at", "part"), "tokens", "copies").where("part > 0")
    source = F.get(F.array(*[F.lit(n) for n in names]), F.col("at"))
    got = each.groupBy(source.alias("source")).agg(F.sum(F.col("tokens") * F.col("copies") * F.col("part")).alias("used"), F.sum((F.col("copies") > 0).cast("int")).alias("documents"), F.max("copies").alias("most_copies"))
    whole = got.agg(F.sum("used").alias("whole"))
    goal = targets.where("source is not null").groupBy("source").agg(F.max("targetshare").alias("target_share"))
    return goal.join(got, "source", "left").join(F.broadcast(whole)).select("source", "target_share", F.round(F.coalesce(F.try_divide("used", "whole"), F.lit(0.0)), 4).alias("share"), F.round(F.coalesce("used", F.lit(0.0)), 0).cast("long").alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
