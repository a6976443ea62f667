"""Between Arrow list columns and NumPy matrices, for work done per Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def to_matrix(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The non-null rows as a float64 matrix, and the mask that says which rows they are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    present = np.asarray(column.is_valid())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    count = int(present.sum())
    if dim is None:
        dim = len(flat) // count if count else 0
    lengths = np.asarray(column.drop_null().value_lengths())
    if count and not (lengths == dim).all():
        raise ValueError(f"every vector must have {dim} elements")
    return flat.reshape(count, dim), present


def to_lists(matrix: np.ndarray, present: np.ndarray, element: pa.DataType) -> pa.Array:
    """Rows of ``matrix`` as lists at the ``present`` places, nulls elsewhere."""
    ends = np.cumsum(np.where(present, matrix.shape[1], 0))
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    values = pa.array(np.ascontiguousarray(matrix).reshape(-1), type=element)
    if present.all():
        return pa.ListArray.from_arrays(offsets, values)
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array(~present))
