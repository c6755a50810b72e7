"""Columns of vectors as whole numbers: what the operators on embeddings share.

A component x becomes floor(scale * x), x as double. Scores and distances are then whole numbers, which doubles hold exactly below 2^53; vectors
that would go beyond that are an error, never a wrong number.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Components must stay below this, so that a distance of 64 of them, and a sum of 2^40 components, is exact.
LARGEST = 1 << 22


def quantised(col: pa.Array, scale: int, dim: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows hold a vector (of dim components, if given; none null or not finite), their whole numbers in a row, and how many each has."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(n)
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    ok = (wrong[ends] == wrong[ends - n]) & ~np.asarray(col.is_null())
    if dim is not None:
        ok &= n == dim
    x = np.floor(scale * x[np.repeat(ok, n)])
    if len(x) and np.abs(x).max() >= LARGEST:
        raise ValueError(f"a component of {np.abs(x).max() / scale} is too large for exact scores")
    return ok, x.astype(np.int32), n[ok]


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column: each row its values' bytes."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    if ends[-1] < 1 << 31:
        return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(col: pa.Array, dim: int, kind=np.int32) -> np.ndarray:
    """The rows of a packed column as a matrix; shorter ones end in zeros."""
    data, offs = C.flat(col)
    n = np.diff(offs) // np.dtype(kind).itemsize
    x = np.frombuffer(data.tobytes(), kind)
    if (n == dim).all():
        return x.reshape(len(n), dim)
    out = np.zeros((len(n), dim), kind)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)] = x
    return out


def _pack(batches: Iterator[pa.RecordBatch], scale: int, dim: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok, x, n = quantised(batch.column(batch.num_columns - 1), scale, dim)
        keep = pa.array(ok)
        rest = [batch.column(i).filter(keep) for i in range(batch.num_columns - 1)]
        norms = np.concatenate([[0], np.cumsum(x.astype(np.int64) ** 2)])
        ends = np.cumsum(n)
        yield pa.RecordBatch.from_arrays([*rest, packed(x, n), pa.array(n.astype(np.int32)), pa.array(norms[ends] - norms[ends - n])], names=[*batch.schema.names[:-1], "v", "dim", "norm2"])


def whole_vectors(df: DataFrame, vector: str, scale: int, dim: int | None = None, **keep: Column) -> DataFrame:
    """The columns of keep, by their names, with v (the vector's whole numbers, packed), dim and norm2, in a staged table. Rows whose vector is null, has a null or non-finite component or another length are left out."""
    slim = df.select(*[c.alias(k) for k, c in keep.items()], F.col(f"`{vector}`").alias("_vector"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema[:-1])
    return C.staged(C.map_arrow(slim, functools.partial(_pack, scale=scale, dim=dim), f"{schema}, v binary, dim int, norm2 long"), "vectors")
