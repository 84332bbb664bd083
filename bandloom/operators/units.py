"""Quantities recorded in different units, brought to common ones.

A row's unit is the one among a few candidates that leaves the smallest sum of
log residuals. The residuals come from

* physical identities: wavelength (um) times wavenumber (1/cm) is 10^4, the
  channels of one axis are equally spaced in wavelength, a channel's bandwidth is
  the spacing of its axis, a reflected share of light is at most one;
* what the texts beside the values say, where they say it.

A second candidate that fits as well is reported as ``unique = false``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from bandloom.common import evaluated_once, fresh


@dataclass(frozen=True)
class Unit:
    """``common = factor * value``, or ``factor / value`` if reciprocal. ``pattern`` finds the unit in lower-case text."""

    name: str
    factor: float
    pattern: str
    reciprocal: bool = False
    words: tuple[str, ...] = ()

    def convert(self, v: Column) -> Column:
        return F.try_divide(F.lit(self.factor), v) if self.reciprocal else v * F.lit(self.factor)


#: Units of length axes in micrometers. A text means the first unit whose pattern it holds.
WAVELENGTH = (
    Unit("angstrom", 1e-4, r"[aå]ngstr|å(?![a-z])|\btenths? of (?:a |one )?(?:nm|nano)|(?<![0-9.])0\.1 ?nm|\b1e-10"),
    Unit("nanometer", 1e-3, r"nano ?m|(?<![a-z])nm(?![a-z])|milli ?micr|\b1e-9|\bnanom"),
    Unit("wavenumber", 1e4, r"cm ?(?:\^|\*\*)? ?\(?[-−⁻] ?[1¹]|1 ?/ ?cm|inverse c|reciprocal c|per c(?:m|ent)|kayser|wave ?number|wellenzahl|nombre d.onde", True),
    Unit("micrometer", 1.0, r"micro ?m|mikro ?m|micron|(?<![a-z])[uµμ] ?m(?![a-z])|\b1e-6"),
)
#: Scales of a share of light, as fractions of one.
FRACTION = (
    Unit("permille", 1e-3, r"‰|per ?mil(?!l?i)|promille|parts per thou|[x*] ?1000(?!0)|1/1000(?!0)|(?<![0-9.])1e-?3\b|\bthousand\b(?<!ten thousand)", words=("promille", "permil")),
    Unit("per_10000", 1e-4, r"10 ?000\b|1e-?4\b|10\^-?4|ten thou|10\*\*4"),
    Unit("fraction", 1.0, r"frac|ratio\b|unit ?less|0 ?(?:-|\.\.|–|[a-z]{2,4}) ?1\b|between (?:zero|0) and (?:one|1)|\bof (?:one|1)\b", words=("fraction", "fractional", "frac", "ratio", "unitless")),
    Unit("percent", 1e-2, r"%|per ?cent|\bpct\b|prozent|pour ?cent", words=("percent", "percentage", "prozent", "pct")),
)

#: Residuals of a candidate that a text denies; large against rounding, small against a factor of a thousand.
DENIED = 3.0
#: Two candidates closer than this are both possible.
TOLERANCE = 0.35
#: The wavelengths, in micrometers, in which optical instruments work.
WINDOW = (0.15, 200.0)


def stated(text: Column, units: Sequence[Unit]) -> Column:
    """The name of the first unit that ``text`` mentions, else of the first of which it has a word misspelt, else null."""
    t = F.lower(text)
    exact = [F.when(F.regexp_like(t, F.lit(u.pattern)), F.lit(u.name)) for u in units]
    words = F.split(t, r"[^\p{L}]+")
    near = [F.when(F.exists(words, _any_misspelt(u.words)), F.lit(u.name)) for u in units if u.words]
    return F.coalesce(*exact, *near)


def _any_misspelt(keys: Sequence[str]) -> Callable[[Column], Column]:
    return lambda word: reduce(lambda a, b: a | b, [_misspelt(word, k) for k in keys])


def _misspelt(word: Column, key: str) -> Column:
    """One letter wrong, lost, doubled or swapped with its neighbour (the same letters, two edits)."""
    edits = F.levenshtein(word, F.lit(key), 2)
    letters = lambda c: F.array_sort(F.split(c, ""))
    return ((edits >= 0) & (edits <= 1) & (F.length(word) >= len(key) - 1)) | ((edits == 2) & (letters(word) == letters(F.lit(key))))


def phrase(text: Column, subject: str) -> Column:
    """What ``text`` says right after ``subject`` (a pattern), up to the next break; null if it isn't mentioned.

    Figures in a remark ("slit 2 nm") belong to other things and are left out.
    """
    found = F.regexp_extract(F.lower(text), rf"(?:^|[;,.:]\s*|\s)(?:{subject})\s*(.+?)(?=\s*[;,]|\.(?:\s|$)|$)", 1)
    return F.when(found != "", found)


def _spread(values: Column, u: Unit) -> Column:
    """How far the channels are from equal steps in wavelength: the log of one plus their mean distance, in steps, from where they would be."""
    n = F.size(values)
    at = lambda v: u.convert(v.cast("double"))
    # Evaluated for each channel, so these must be cheap.
    first, last = at(F.get(values, F.lit(0))), at(F.get(values, n - 1))
    step = (last - first) / (n - 1)
    off = F.transform(values, lambda v, i: F.abs(at(v) - first - i * step))
    mean = F.try_divide(F.aggregate(off, F.lit(0.0), lambda t, v: t + v), F.abs(step) * n)
    return F.when(n < 3, 0.0).otherwise(F.coalesce(F.least(F.ln(1 + mean), F.lit(9.0)), F.lit(9.0)))


def axis_facts(values: Column, units: Sequence[Unit] = WAVELENGTH) -> Column:
    """struct(least, most, plain, reciprocal) of an axis: its bounds and how far its steps are from equal, in wavelength.

    A factor doesn't change the steps' ratios, so they are looked at once for all units that aren't reciprocal.
    """
    steps = [_spread(values, next((u for u in units if u.reciprocal == r), units[0])).alias(n) for r, n in ((False, "plain"), (True, "reciprocal"))]
    return F.struct(F.array_min(values).cast("double").alias("least"), F.array_max(values).cast("double").alias("most"), *steps)


def axis_residuals(facts: Column, said: Column, units: Sequence[Unit] = WAVELENGTH) -> dict[str, Column]:
    """For each unit, the residual of an axis (its ``axis_facts``) of which a text said the unit ``said`` (or null).

    All entries count: their least and greatest must lie where instruments work, and their steps must be equal in wavelength.
    """
    least, most = facts["least"], facts["most"]
    out = {}
    for u in units:
        lo, hi = F.least(u.convert(least), u.convert(most)), F.greatest(u.convert(least), u.convert(most))
        outside = F.coalesce(F.greatest(F.lit(0.0), F.ln(F.try_divide(F.lit(WINDOW[0]), lo))), F.lit(9.0)) + F.coalesce(F.greatest(F.lit(0.0), F.ln(hi / WINDOW[1])), F.lit(9.0))
        out[u.name] = outside + facts["reciprocal" if u.reciprocal else "plain"] + _denied(said, u)
    return out


def largest(values: Column) -> Column:
    """The greatest value that is neither null nor NaN."""
    return F.array_max(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))).cast("double")


def share_residuals(top: Column, said: Column, units: Sequence[Unit] = FRACTION) -> dict[str, Column]:
    """As axis_residuals, for shares of light by their largest value: none exceeds one by more than noise, and few are tiny."""
    log = F.ln(F.when(top > 0, top))
    return {u.name: F.coalesce(F.greatest(F.lit(0.0), log + math.log(u.factor / 1.2)) + 0.2 * F.abs(log + math.log(u.factor / 0.6)), F.lit(0.0)) + _denied(said, u) for u in units}


def _denied(said: Column, u: Unit) -> Column:
    return F.when(said.isNull() | (said == u.name), 0.0).otherwise(DENIED)


def ranked(residuals: dict[str, Column]) -> Column:
    """The candidates as array of struct(residual, unit), best first; ties go to the first by name."""
    return F.array_sort(F.array(*[F.struct(F.round(r, 6).alias("residual"), F.lit(n).alias("unit")) for n, r in residuals.items()]))


def choose(order: Column) -> Column:
    """struct(unit, residual, unique) of the first of ``ranked`` candidates; null stays null."""
    best, second = F.get(order, F.lit(0)), F.get(order, F.lit(1))
    return F.when(order.isNotNull(), F.struct(best["unit"].alias("unit"), best["residual"].alias("residual"), (second["residual"] - best["residual"] > TOLERANCE).alias("unique")))


def converted(values: Column, unit: Column, units: Sequence[Unit]) -> Column:
    """The array in common units, NaN kept; null where the unit is."""
    branches = [F.when(unit == u.name, F.transform(values, _converter(u))) for u in units]
    return F.coalesce(*branches)


def converted_bounds(least: Column, most: Column, unit: Column, units: Sequence[Unit] = WAVELENGTH) -> tuple[Column, Column]:
    """The bounds of an axis in common units: the reciprocal of the greatest is the least."""
    pick = lambda f: F.coalesce(*[F.when(unit == u.name, f(u.convert(least), u.convert(most))) for u in units])
    return pick(F.least), pick(F.greatest)


def _converter(u: Unit) -> Callable[[Column], Column]:
    return lambda v: u.convert(v.cast("double"))


def combined(x: Column, y: Column) -> Column:
    """All combinations of a unit of each axis (arrays of struct(residual, unit)), as array of struct(residual, x, y, x_residual, y_residual)."""
    pair = lambda a, b: F.struct(F.round(a["residual"] + b["residual"], 6).alias("residual"), a["unit"].alias("x"), b["unit"].alias("y"), a["residual"].alias("x_residual"), b["residual"].alias("y_residual"))
    return F.flatten(F.transform(x, lambda a: F.transform(y, lambda b: pair(a, b))))


def _of_combination(all_of_them: Column, best: Column, axis: str) -> Column:
    """struct(unit, residual, unique) of one axis in the best combination; unique: no combination with another unit there comes near."""
    near = F.exists(all_of_them, lambda c: (c[axis] != best[axis]) & (c["residual"] - best["residual"] <= TOLERANCE))
    return F.struct(best[axis].alias("unit"), best[f"{axis}_residual"].alias("residual"), (~near).alias("unique"))


def resolve_spectra(df: DataFrame, x: str = "xdata", y: str = "ydata", xunit: str = "xunit", yunit: str = "yunit", remark: str = "measurement") -> DataFrame:
    """``df`` with ``x_unit``, ``y_unit`` (struct unit, residual, unique) from the values, the unit columns and the remark.

    The combination of an x unit and a y unit with the least sum of log residuals
    is chosen; ``unique`` is false where another unit of the axis fits about as
    well. A null or empty array has a null unit. No row is dropped or merged, no
    shuffle is made; columns called x_unit or y_unit are replaced. An unreadable
    or null unit text counts as silence, and then the identities decide.
    """
    on_axis = r"(?:x|abscissa|(?:[a-z]+ )?ax[ie]s|channel cent(?:re|er)s|wavelengths?|bands?)\s+(?:values?\s+)?(?:is|are|in|given in|given|per|as|stored in)"
    # "channel axis per cm": the unit starts with the preposition.
    per = r"(?:x|abscissa|(?:[a-z]+ )?ax[ie]s|channel cent(?:re|er)s)(?=\s+per\s)"
    x_said = F.coalesce(stated(F.col(xunit), WAVELENGTH), stated(phrase(F.col(remark), per), WAVELENGTH), stated(phrase(F.col(remark), on_axis), WAVELENGTH))
    of_values = r"(?:values:|stored as|data:|data in|y:|y is|ordinate(?: in)?)|(?=(?:reflect|transm|emis|absorp)[a-zé]* (?:in |given |multiplied|as |between|on a |scaled|times))"
    y_said = F.coalesce(stated(F.col(yunit), FRACTION), stated(phrase(F.col(remark), of_values), FRACTION))
    tmp = {n: fresh(df, f"__{n}") for n in ("x_said", "y_said", "top", "facts", "x_own", "y_own", "all", "best")}
    at = {k: F.col(f"`{v}`") for k, v in tmp.items()}
    has_x, has_y = F.size(F.col(x)) > 0, F.size(F.col(y)) > 0
    work = evaluated_once(df, {tmp["x_said"]: x_said, tmp["y_said"]: y_said, tmp["top"]: largest(F.col(y)), tmp["facts"]: F.when(has_x, axis_facts(F.col(x)))})
    candidates = lambda residuals, there: F.array(*[F.struct(F.coalesce(F.when(there, F.round(r, 6)), F.lit(0.0)).alias("residual"), F.lit(n).alias("unit")) for n, r in residuals.items()])
    work = evaluated_once(work, {tmp["x_own"]: candidates(axis_residuals(at["facts"], at["x_said"]), has_x)})
    work = evaluated_once(work, {tmp["y_own"]: candidates(share_residuals(at["top"], at["y_said"]), has_y)})
    work = evaluated_once(work, {tmp["all"]: combined(at["x_own"], at["y_own"])})
    work = evaluated_once(work, {tmp["best"]: F.array_min(at["all"])})
    return evaluated_once(work, {"x_unit": F.when(has_x, _of_combination(at["all"], at["best"], "x")), "y_unit": F.when(has_y, _of_combination(at["all"], at["best"], "y"))}).drop(*tmp.values())


def resolve_instruments(
    df: DataFrame,
    group: Sequence[str] = ("libname", "name", "numvalues"),
    values: str = "valuesarray",
    kind: str = "measurementtype",
    unit: str = "unit",
    remark: str = "description",
) -> DataFrame:
    """``df`` with ``x_unit`` of the arrays of instruments: wavelengths, wavenumbers, bandwidths and resolutions.

    Rows of one ``group`` describe the same channels, so their axes must agree
    (wavelength times wavenumber is 10^4) and bandwidths must be near the spacing
    of the axis. The reference of a group is its most certain axis and its most
    certain width, kept by an aggregate of fixed size: a group of any size is
    reduced before the shuffle. Rows with a null group key are judged alone.
    Arrays of responses have no unit and get null, as do empty ones.
    """
    k = F.lower(F.col(kind))
    is_axis, is_width = F.regexp_like(k, F.lit("wavel|waven")), F.regexp_like(k, F.lit("bandp|resol|fwhm|width"))
    said = F.coalesce(stated(F.col(unit), WAVELENGTH), stated(F.col(remark).substr(F.lit(1), F.length(remark)), WAVELENGTH_REMARK), F.when(F.regexp_like(k, F.lit("waven")), F.lit("wavenumber")))
    v = F.col(values)
    own = axis_residuals(axis_facts(v), said)
    lengths = {u.name: u for u in WAVELENGTH}
    mean = F.aggregate(v, F.lit(0.0), lambda a, e: a + F.coalesce(e.cast("double"), F.lit(0.0))) / F.size(v)
    width = {n: F.when(~F.lit(u.reciprocal), F.abs(F.ln(F.when(mean > 0, mean) * u.factor / 0.2)) * 0.3).otherwise(F.lit(9.0)) + _denied(said, u) for n, u in lengths.items()}
    names = {n: fresh(df, f"__{n}") for n in ("own", "id")}
    work = evaluated_once(
        df,
        {names["own"]: F.when((F.size(v) > 0) & (is_axis | is_width), F.array(*[F.struct(F.coalesce(F.when(is_axis, own[n]).otherwise(width[n]), F.lit(9.0)).alias("residual"), F.lit(n).alias("unit")) for n in lengths]))},
    )
    cand = F.col(names["own"])
    best = F.array_min(cand)
    first, last, n = F.get(v, F.lit(0)).cast("double"), F.get(v, F.size(v) - 1).cast("double"), F.size(v)
    lo = reduce(lambda acc, u: acc.when(best["unit"] == u.name, F.least(u.convert(first), u.convert(last))), WAVELENGTH, F.when(F.lit(False), F.lit(0.0)))
    hi = reduce(lambda acc, u: acc.when(best["unit"] == u.name, F.greatest(u.convert(first), u.convert(last))), WAVELENGTH, F.when(F.lit(False), F.lit(0.0)))
    scale = reduce(lambda acc, u: acc.when(best["unit"] == u.name, mean * u.factor), WAVELENGTH, F.when(F.lit(False), F.lit(0.0)))
    refs = (
        work.where(cand.isNotNull())
        .groupBy(*group)
        .agg(
            F.min(F.when(is_axis, F.struct(best["residual"].alias("r"), lo.alias("lo"), hi.alias("hi"), n.alias("n")))).alias("__axis"),
            F.min(F.when(is_width, F.struct(best["residual"].alias("r"), scale.alias("w")))).alias("__width"),
        )
    )
    work = work.join(refs, list(group), "left")
    axis, ref_w = F.col("__axis"), F.col("__width")
    step = (axis["hi"] - axis["lo"]) / (axis["n"] - 1)

    def agree(c: Column) -> Column:
        u_lo = reduce(lambda acc, u: acc.when(c["unit"] == u.name, F.least(u.convert(first), u.convert(last))), WAVELENGTH, F.when(F.lit(False), F.lit(0.0)))
        u_hi = reduce(lambda acc, u: acc.when(c["unit"] == u.name, F.greatest(u.convert(first), u.convert(last))), WAVELENGTH, F.when(F.lit(False), F.lit(0.0)))
        u_w = reduce(lambda acc, u: acc.when(c["unit"] == u.name, mean * u.factor), WAVELENGTH, F.when(F.lit(False), F.lit(0.0)))
        log = lambda p, q: F.least(F.abs(F.ln(F.when((p > 0) & (q > 0), F.try_divide(p, q)))), F.lit(9.0))
        with_axis = F.coalesce(log(u_lo, axis["lo"]) + log(u_hi, axis["hi"]), F.lit(0.0)) + F.coalesce(log((u_hi - u_lo) / (n - 1), ref_w["w"]), F.lit(0.0)) * 0.5
        with_width = F.coalesce(log(u_w, step), F.lit(0.0)) + F.coalesce(log(u_w, ref_w["w"]), F.lit(0.0)) * 0.5
        return F.struct(F.round(c["residual"] + F.when(is_axis, with_axis).otherwise(with_width), 6).alias("residual"), c["unit"].alias("unit"))

    order = F.array_sort(F.transform(cand, agree))
    return work.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != "x_unit"], choose(order).alias("x_unit"))


#: In a description the kind of array ("Wavenumber VLTR4 ...") comes first and is no unit, so only what follows counts.
WAVELENGTH_REMARK = tuple(Unit(u.name, u.factor, rf"(?<=\s|\()(?:{u.pattern})" if u.name != "wavenumber" else r"\bin wave ?numbers|" + u.pattern.replace("wave ?number|", ""), u.reciprocal) for u in WAVELENGTH)
