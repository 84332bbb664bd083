"""Delimited records that fail to parse, set apart with the reason, beside the typed rows that load.

Each record is read permissively under an explicit schema that keeps the raw
text of what did not fit. Whatever the permissive reader called corrupt, or
read although it holds a quote, is then judged again by quoting, by the number
of cells and by casts: so a record is rejected for a stated reason only, and a
column that is not judged may fail to cast without losing its row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from bandloom.common import evaluated_once, fresh

#: The reasons, in the order in which they are looked for.
REASONS = ("missing", "quoting", "column_count", "not_a_count", "not_numbers", "length_mismatch")

_NUMBER = r"[+-]?+(?:[0-9]++\.?+[0-9]*+|\.[0-9]++)(?:[eE][+-]?+[0-9]++)?+"
_NUMBERS = rf"^[ \t]*+{_NUMBER}(?:[ \t]++{_NUMBER})*+[ \t]*+$"
#: More separators than this are not given to the reader, whose buffers are sized by it; the cell count rejects them.
_READER_COLUMNS = 4096


def _cell(sep: str, quote: str) -> str:
    s, q = rf"\x{ord(sep):02x}", rf"\x{ord(quote):02x}"
    return rf"(?:{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}(?={s}|\z)|(?!{q})[^{s}{q}]*+(?={s}|\z))"


def parse_records(
    df: DataFrame,
    line: str,
    schema: T.StructType,
    *,
    counts: Sequence[str] = (),
    lists: Mapping[str, str] | None = None,
    reason: str = "reject_reason",
    sep: str = ",",
    quote: str = '"',
) -> DataFrame:
    """``df`` with the cells of ``line`` as typed columns and the column ``reason`` (null where the record loads).

    ``schema`` names the cells in order. A field in ``counts`` must be ASCII
    digits and at least 1. ``lists`` maps a field of numbers separated by blanks
    or tabs (an array type in ``schema``) to the field that tells how many they
    are. No other field is judged: where its text doesn't cast, it is null.

    A null line is rejected as ``missing``; an empty one has one cell. Rejected
    rows keep their other columns and the raw text, with null cells. Columns of
    ``df`` named like a field of ``schema`` are replaced. Rows that repeat stay
    repeated, and an empty table gives an empty table.

    No shuffle, no Python: one scan with one projection.
    """
    lists = dict(lists or {})
    counts = list(dict.fromkeys([*counts, *lists.values()]))
    names = [f.name for f in schema]
    raw = F.col(f"`{line}`")
    commas = F.length(raw) - F.length(F.replace(raw, F.lit(sep)))
    corrupt = "__corrupt"
    text = ", ".join(f"`{n}` string" for n in names) + f", `{corrupt}` string"
    read = F.from_csv(
        F.when(commas < _READER_COLUMNS, raw),
        text,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt, "sep": sep, "quote": quote, "escape": quote, "maxCharsPerColumn": "-1", "nullValue": "\x00", "emptyValue": "", "maxColumns": str(_READER_COLUMNS + 1)},
    )
    cell = _cell(sep, quote)
    s = rf"\x{ord(sep):02x}"
    sound = ~F.contains(raw, F.lit(quote)) | F.regexp_like(raw, F.lit(rf"(?s)\A{cell}(?:{s}{cell})*+\z"))
    t = {k: fresh(df, f"__{k}") for k in ("read", "sound", "cells", "why", *[f"count_{n}" for n in counts], *[f"items_{n}" for n in lists])}
    at = {k: F.col(f"`{v}`") for k, v in t.items()}
    work = evaluated_once(df, {t["read"]: read, t["sound"]: sound})
    # What the reader read without complaint from a record that has no quote needs no second look at its cells.
    clear = at["read"][corrupt].isNull() & at["read"].isNotNull() & (commas == len(names) - 1) & ~F.contains(raw, F.lit(quote)) & ~F.regexp_like(raw, F.lit(r"[\r\n]"))
    again = F.regexp_extract_all(raw, F.lit(rf"(?s)(?:\A|(?<={s})){cell}"), F.lit(0))
    unquoted = F.transform(
        again,
        lambda c: F.when(c.startswith(quote), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit(quote * 2), F.lit(quote))).otherwise(c),
    )
    work = evaluated_once(work, {t["cells"]: F.when(clear, F.array(*[at["read"][n] for n in names])).when(at["sound"], unquoted)})
    got = {n: F.get(at["cells"], F.lit(i)) for i, n in enumerate(names)}
    work = evaluated_once(
        work,
        {t[f"count_{n}"]: F.when(F.regexp_like(got[n], F.lit(r"\A[0-9]++\z")), F.coalesce(got[n].try_cast("bigint"), F.lit((1 << 63) - 1))) for n in counts}
        | {t[f"items_{n}"]: F.when(F.regexp_like(got[n], F.lit(_NUMBERS)), F.split(F.btrim(got[n], F.lit(" \t")), r"[ \t]+")) for n in lists},
    )
    why: Column = F.when(raw.isNull(), REASONS[0]).when(~at["sound"], REASONS[1]).when(F.size(at["cells"]) != len(names), REASONS[2])
    for n in counts:
        why = why.when(F.coalesce(at[f"count_{n}"], F.lit(0)) < 1, f"{REASONS[3]}: {n}")
    for n in lists:
        why = why.when(at[f"items_{n}"].isNull(), f"{REASONS[4]}: {n}")
    for n, of in lists.items():
        why = why.when(F.size(at[f"items_{n}"]) != at[f"count_{of}"], f"{REASONS[5]}: {n}")
    work = evaluated_once(work, {t["why"]: why})
    typed = []
    for f in schema:
        if f.name in lists:
            value = at[f"items_{f.name}"].cast(f.dataType)
        elif isinstance(f.dataType, T.StringType):
            value = got[f.name]
        else:
            value = F.trim(got[f.name]).try_cast(f.dataType)
        typed.append(F.when(at["why"].isNull(), value).alias(f.name))
    own = {n.lower() for n in names} | {reason.lower()}
    return work.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in own or c == line], *typed, at["why"].alias(reason))


def split_rejects(parsed: DataFrame, line: str, schema: T.StructType, reason: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """(rows that load, without line and reason; rejects with the raw line and the reason, without the cells)."""
    names = {f.name for f in schema}
    good = parsed.where(f"`{reason}` is null").drop(line, reason)
    return good, parsed.where(f"`{reason}` is not null").select(*[F.col(f"`{c}`") for c in parsed.columns if c not in names])
