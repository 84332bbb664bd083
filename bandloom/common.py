"""Small helpers that every operator uses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: A side is broadcast only when its measured size is at most this many bytes.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_per_key(df: DataFrame, keys: Sequence[str] | str, order: Sequence[str] = ("loadedat",)) -> DataFrame:
    """One row per key: the one smallest by ``order`` and then by all its columns; rows with a null key are left out.

    A partial aggregate, so a key that holds a third of all rows is reduced
    before the shuffle.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    first = [c for c in order if c in df.columns and c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in first]
    kept = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    if not first and not rest:
        return kept.distinct()
    least = F.min(F.struct(*[F.col(f"`{c}`") for c in first + rest])).alias("__row")
    return kept.groupBy(*keys).agg(least).select(*[F.col(f"`{k}`") if c == k else F.col(f"__row.`{c}`") for c in df.columns for k in [next((k for k in keys if k == c), None)]])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _row_bytes(kind: T.DataType, c: Column) -> Column:
    """The bytes of a value in memory: texts, binaries and arrays by their real lengths."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        own = F.octet_length(c) + 16
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
        own = F.aggregate(c, F.lit(24).cast("long"), lambda a, v: a + _row_bytes(kind.elementType, v))
    elif isinstance(kind, T.ArrayType):
        own = F.size(c) * 8 + 24
    elif isinstance(kind, T.MapType):
        own = _row_bytes(T.ArrayType(kind.keyType), F.map_keys(c)) + _row_bytes(T.ArrayType(kind.valueType), F.map_values(c))
    elif isinstance(kind, T.StructType):
        own = sum((_row_bytes(f.dataType, c[f.name]) for f in kind.fields), F.lit(16))
    else:
        return F.lit(8).cast("long")
    return F.coalesce(own.cast("long"), F.lit(8).cast("long"))


def fits(df: DataFrame, bytes_per_row: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` may be broadcast: it has at most limit / bytes_per_row rows, and its values, measured by their real lengths, at most ``limit`` bytes.

    Counts no further than the limit. ``bytes_per_row`` is what a row takes besides its values.
    """
    most = max(1, limit // bytes_per_row)
    size = sum((_row_bytes(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(0).cast("long"))
    n, total = df.limit(most + 1).agg(F.count("*"), F.sum(size)).first()
    return n <= most and (total or 0) <= limit


def maybe_broadcast(df: DataFrame, bytes_per_row: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is measured to fit, else as it is (Spark then shuffles)."""
    return F.broadcast(df) if fits(df, bytes_per_row, limit) else df


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def evaluated_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns``, which the optimizer can't copy into the filters and projections above.

    Predicate pushdown substitutes a projection's expressions wherever they
    are used, so a costly one that several columns use would run many times.
    A generator of one row stands in its way, and costs next to nothing.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
