"""Freely typed values mapped to the entries of a reference list by a prefix-filtered set-similarity join.

Values and the spellings of the entries become sets of letter pairs, letters
and numbers. Tokens are ordered by how rare they are over both sides; two sets of
Jaccard similarity ``threshold`` or more share one of the first few, so only
those prefixes are joined. Length and position filters thin out the pairs,
Jaccard is verified exactly and the best entry is kept.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from bandloom.common import maybe_broadcast
from bandloom.session import cut

#: Characters that optical readers and typists confuse, brought together.
_FOLD = str.maketrans({"i": "1", "l": "1", "o": "0"})
#: Words around an instrument's name that are no part of it.
_NOISE = re.compile(r"^\s*(?:inst\s*=|spectrometer\s*:|the\s)|\bs/n\s*\w+|\(lab\s*\d+\)|,\s*refurbished|-\s*second unit|\bspectrometer\s*$|\bno\.\s*(?=\d)|\bby\b")
_STOP = {"in", "as", "of", "the", "a", "and", "by", "factor", "scale", "scaled", "int", "to", "bis"}


def plain(text: str) -> str:
    """Lower case without accents."""
    decomposed = unicodedata.normalize("NFKD", text.lower().replace("‰", " permil ").replace("%", " percent "))
    return "".join(c for c in decomposed if not unicodedata.combining(c))


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z]+|\d+", text)


def _pairs(word: str) -> set[str]:
    """Letter pairs, and single letters, which outlive swapped neighbours."""
    w = f"^{word.translate(_FOLD)}$"
    return {w[i : i + 2] for i in range(len(w) - 1)} | {"." + c for c in w[1:-1]}


def tokens(field: str, value: str) -> list[str]:
    """The token set of a typed value: letter pairs of its words, and ``#n`` for its numbers."""
    t = plain(value)
    if field == "instrument":
        t = _NOISE.sub(" ", t)
        # A figure amid letters stands for a letter; at the end of a word it's the model's number.
        t = re.sub(r"(?<=[a-z])[01](?=[01]*[a-z])|\b[01](?=[a-z])", lambda m: "l" if m[0] == "1" else "o", t)
    elif field == "spectrometer":
        t = re.sub(r"[\s\-_.]*\bstd\b", "", re.sub(r"[\[\]<>*()]", " ", t)).strip()
        t = re.sub(r"(?<=[a-z])[\s\-_.]+(?=\d+\s*$)", "", t)
        t = re.sub(r"(?<=\d)(?:aa|ab|bcd|a|b|c)$", "", t)
        t = re.sub(r"(?<=[a-z])[01](?=[01]*[a-z])|\b[01](?=[a-z])|(?<=[a-z])10(?=[68]$)", lambda m: "io" if m[0] == "10" else "i" if m[0] == "1" else "o", t)
    else:
        t = re.sub(r"10\s*(?:\^|\*\*)\s*4|1e\s*-?4\b", " 10000 ", t)
        t = re.sub(r"\b0\s*(?:-|\.\.|[a-z]{1,4})\s*1\b", " zeroone ", t)
        t = re.sub(r"1/(?=1000)|=\s*1(?:\.0)?\b|\bx\b|(?<=[a-z_ ])x(?=_?1000)|\b1\b", " ", t.replace("_", " "))
    out: set[str] = set()
    for w in _words(t):
        if w.isdigit():
            out.add("#" + w.lstrip("0"))
        elif w not in _STOP:
            out |= {"=" + w} if len(w) == 1 and field == "yunit" else _pairs(w)
    return sorted(out)


#: Words for the quantities and scales of a share of light.
_QUANTITIES = {
    "reflectance": ("reflectance", "reflectivity", "refl", "rfl", "r", "reflexionsgrad", "reflexion", "reflectance panel", "refl panel"),
    "transmittance": ("transmittance", "transmission", "trans", "t", "transmissivity", "transmissionsgrad"),
    "emissivity": ("emissivity", "emiss", "e", "emittance", "emissionsgrad"),
}
_SCALES = {
    "percent": ("percent", "pct", "prozent", "percentage", "pourcent"),
    "fraction": ("fraction", "fractional", "frac", "ratio", "unitless ratio", "zeroone", "unitless"),
    "x 10000": ("10000",),
    "per mille": ("permil", "promille", "per mille", "1000", "parts per thousand", "parts thousand"),
}
_PURITIES = ("a", "aa", "ab", "b", "bcd", "c")


def spellings(field: str, term: str, detail: str | None) -> Iterator[tuple[str, tuple[str, str]]]:
    """Ways to write a reference entry, each with the two parts of it that a value must show."""
    words = term.split()
    if field == "instrument" and len(words) == 3:
        vendor, model, number = words
        skeleton = vendor[0] + re.sub("[aeiou]", "", vendor[1:])
        for v, m in itertools.product(("", vendor, vendor[:3], vendor[:4], skeleton), (model, model[:4])):
            if m == model or v == vendor:
                yield f"{v} {m} {number}".strip(), (m, number)
    elif field == "instrument" and len(words) == 2:
        vendor, model = words
        skeleton = vendor[0] + re.sub("[aeiou]", "", vendor[1:])
        kind = "".join(re.findall(r"[A-Za-z]+", model))
        number = "".join(re.findall(r"\d+", model))
        for v in ("", vendor, vendor[:3], vendor[:4], skeleton):
            yield f"{v} {kind} {number}".strip(), (kind, number)
    elif field == "spectrometer":
        yield term, (term, "")
        if not term[-1].isdigit():
            for p in _PURITIES:
                yield term + p, (term, "")
        if detail:
            head = re.sub(r",.*", "", detail)
            number = "".join(re.findall(r"\d+$", term))
            yield f"{head} {number}", (head, number)
    elif field == "yunit" and (m := re.fullmatch(r"(\w+) \((.+)\)", term)):
        for q, s in itertools.product(_QUANTITIES.get(m[1], (m[1],)), _SCALES.get(m[2], (m[2],))):
            yield f"{q} {s}", (q, s)
    else:
        yield term, (term, "")


def _tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["tokens"] = [tokens(f, v) for f, v in zip(b["field"], b["value"], strict=True)]
        yield b


def _expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for termid, field, term, detail in zip(b["termid"], b["field"], b["term"], b["detail"], strict=True):
            for text, (one, two) in dict(spellings(field, term, detail)).items():
                rows.append((termid, field, text, tokens(field, text), tokens(field, one), tokens(field, two) if two else []))
        yield pd.DataFrame(rows, columns=["termid", "field", "spelling", "tokens", "part_a", "part_b"])


def _ranked(sets: DataFrame, rarity: DataFrame, keys: list[str]) -> DataFrame:
    """``sets`` with ``ordered``: the tokens from the rarest on."""
    ex = sets.select(*keys, F.explode("tokens").alias("token")).join(rarity, ["field", "token"])
    return ex.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias("ordered"))


def _least(n: Column, share: Fraction) -> Column:
    """The least whole number that is ``share`` of ``n`` or more, by whole numbers: rounding can't lose a pair at the threshold."""
    return F.floor((n * share.numerator + (share.denominator - 1)) / share.denominator).cast("int")


def _prefix(side: DataFrame, keys: list[str], threshold: float, size: str, pos: str) -> DataFrame:
    n = F.size("ordered")
    share = Fraction(threshold).limit_denominator(10_000)
    keep = n - _least(n, share) + 1
    return side.select(*keys, n.alias(size), F.posexplode(F.slice("ordered", F.lit(1), keep)).alias(pos, "token"))


def map_to_terms(values: DataFrame, terms: DataFrame, threshold: float = 0.45, part: float = 0.5) -> DataFrame:
    """(field, value, termid, similarity) for every distinct row of ``values`` (field, value); termid 0 if none is meant.

    ``terms`` has termid, field, term and detail (or null). An entry counts if
    Jaccard is at least ``threshold``, the share ``part`` of the letter pairs of
    both its parts is there (so "percent" alone names no quantity), and its
    numbers stand in the value. Two entries that fit equally well leave the
    value unmatched. Null values and null fields are left out; an empty value, a
    value without letters or figures, and a field without entries get 0; long
    texts are compared whole. Extra columns of ``terms`` are ignored.
    """
    values = values.where("field is not null and value is not null").select("field", "value").distinct()
    spelled = terms.where("termid is not null and field is not null and term is not null").select("termid", "field", "term", "detail").distinct()
    spelled = spelled.mapInPandas(_expand, "termid long, field string, spelling string, tokens array<string>, part_a array<string>, part_b array<string>")
    sets = values.mapInPandas(_tokenise, "field string, value string, tokens array<string>")
    sets = cut(sets)
    both = sets.select("field", F.explode("tokens").alias("token")).unionByName(spelled.select("field", F.explode("tokens").alias("token")))
    rarity = both.groupBy("field", "token").agg(F.count("*").alias("n"))
    xs = _ranked(sets, rarity, ["field", "value"])
    skeys = ["termid", "field", "spelling"]
    ys = _ranked(spelled, rarity, skeys)
    px = _prefix(xs, ["field", "value"], threshold, "nx", "ix")
    py = _prefix(ys, skeys, threshold, "ny", "iy")
    share = Fraction(threshold).limit_denominator(10_000)
    both_least = _least(F.col("nx") + F.col("ny"), share / (1 + share))
    near = px.join(py, ["field", "token"]).where(
        (F.col("nx") >= _least(F.col("ny"), share)) & (F.col("ny") >= _least(F.col("nx"), share)) & (F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy")) >= both_least - F.least("ix", "iy"))
    )
    pairs = near.select("field", "value", "termid", "spelling").distinct()
    shared = lambda a, b: F.size(F.array_intersect(a, b))
    full = pairs.join(sets.withColumnRenamed("tokens", "x"), ["field", "value"]).join(maybe_broadcast(spelled.withColumnRenamed("tokens", "y"), 4096), skeys)
    both_n = shared(F.col("x"), F.col("y"))
    similarity = both_n / (F.size("x") + F.size("y") - both_n)
    numbers = lambda c: F.filter(c, lambda t: t.startswith("#"))
    full = full.withColumn("similarity", similarity).where(
        (F.col("similarity") >= threshold - 1e-12)
        & (shared(F.col("x"), F.col("part_a")) >= F.size("part_a") * part)
        & (shared(F.col("x"), F.col("part_b")) >= F.size("part_b") * part)
        & (F.size(F.array_except(numbers(F.col("y")), F.col("x"))) == 0)
        & ((F.col("field") != "yunit") | (F.size(F.array_except(numbers(F.col("x")), F.col("y"))) == 0))
    )
    per_term = full.groupBy("field", "value", "termid").agg(F.max("similarity").alias("similarity"))
    best = per_term.groupBy("field", "value").agg(F.max(F.struct("similarity", "termid")).alias("top"), F.max("similarity").alias("m"), F.collect_set(F.struct("similarity", "termid")).alias("all"))
    tied = F.size(F.filter("all", lambda s: s["similarity"] >= F.col("m") - 1e-9)) > 1
    best = best.select("field", "value", F.when(~tied, F.col("top.termid")).alias("termid"), F.col("top.similarity").alias("similarity"))
    return sets.select("field", "value").join(best, ["field", "value"], "left").select("field", "value", F.coalesce("termid", F.lit(0)).alias("termid"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def map_columns(sources: dict[tuple[str, str, str], DataFrame], terms: DataFrame, **options: float) -> DataFrame:
    """Rows (tab, recordid, field, value, termid, similarity) of several columns.

    ``sources`` maps (tab, key column, value column) to a table; the value
    column's name is the field. Each distinct value is mapped once, however many
    rows hold it. Values that are an entry letter for letter keep that entry.
    """
    rows: DataFrame | None = None
    for (tab, key, column), df in sources.items():
        part = df.where(f"`{key}` is not null and `{column}` is not null").select(F.lit(tab).alias("tab"), F.col(f"`{key}`").cast("long").alias("recordid"), F.lit(column).alias("field"), F.col(f"`{column}`").alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("no sources")
    exact = terms.select("field", F.col("term").alias("value"), F.col("termid").alias("exact")).where("value is not null").groupBy("field", "value").agg(F.min("exact").alias("exact"))
    mapped = cut(map_to_terms(rows.select("field", "value").distinct(), terms, **options))
    mapped = mapped.join(maybe_broadcast(exact, 256), ["field", "value"], "left").select("field", "value", F.coalesce("exact", "termid").alias("termid"), F.when(F.col("exact").isNotNull(), 1.0).otherwise(F.col("similarity")).alias("similarity"), F.col("exact").isNotNull().alias("letter_for_letter"))
    # A value that a third of all rows hold meets one row of the mapping: broadcast if that is small, else AQE splits it.
    return rows.join(maybe_broadcast(mapped, 256), ["field", "value"])


