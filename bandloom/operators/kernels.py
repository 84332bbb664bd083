"""Numpy kernels over Arrow batches of spectra."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

_TYPES = {"double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(), "array<double>": T.ArrayType(T.DoubleType())}


def matrix(b: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a spectrum, as a matrix of doubles; their places). All spectra must be of one length."""
    col = b.column(column)
    there = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False))
    col = col.drop_null()
    values = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if not len(there):
        return np.empty((0, 0)), there
    lengths = np.unique(np.diff(col.offsets.to_numpy()))
    if len(lengths) != 1:
        raise ValueError(f"spectra of {len(lengths)} lengths in {column}")
    return values.reshape(len(there), -1), there


def _column(values: np.ndarray, there: np.ndarray, n: int, kind: T.DataType) -> pa.Array:
    if isinstance(kind, T.ArrayType):
        size = np.zeros(n + 1, np.int32)
        size[there + 1] = values.shape[1]
        valid = np.zeros(n, bool)
        valid[there] = True
        out = pa.ListArray.from_arrays(pa.array(np.cumsum(size, dtype=np.int32)), pa.array(np.ascontiguousarray(values, dtype=float).ravel()))
        return out if valid.all() else pa.ListArray.from_arrays(out.offsets, out.values, mask=pa.array(~valid))
    whole = np.zeros(n, float if isinstance(kind, T.DoubleType) else np.int64)
    whole[there] = values
    hidden = np.ones(n, bool)
    hidden[there] = False
    return pa.array(whole, type=pa.float64() if isinstance(kind, T.DoubleType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.int64(), mask=hidden)


def append(df: DataFrame, spectrum: str, fields: Mapping[str, str], fn: Callable[[np.ndarray], tuple]) -> DataFrame:
    """``df`` with ``fields`` (name to type) from ``fn``, which gets a matrix of spectra and gives an array a field.

    Columns of those names are replaced; a null spectrum has null fields.
    """
    kept = df.drop(*fields)
    schema = T.StructType([*kept.schema.fields, *[T.StructField(n, _TYPES[t]) for n, t in fields.items()]])
    arrow, names = to_arrow_schema(schema), kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, there = matrix(b, spectrum)
            done = fn(x) if len(there) else tuple(np.empty((0, 1)) if t.startswith("array") else np.empty(0) for t in fields.values())
            cols = [_column(np.asarray(v), there, b.num_rows, _TYPES[t]) for v, t in zip(done, fields.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *cols], names=arrow.names)

    return kept.mapInArrow(run, schema)
