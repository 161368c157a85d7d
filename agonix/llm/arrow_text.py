"""Words of a batch of texts as dictionary indices, by Arrow kernels: one flat array over all texts, no Python strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as strings, null as the empty text."""
    return pc.fill_null(batch.column(batch.schema.names.index(name)).cast(pa.string()), "")


def coded(values: pa.Array | np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(index into the distinct values, distinct values) of each value."""
    d = (pa.array(values) if isinstance(values, np.ndarray) else values).dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def pieces(texts: pa.Array, separators: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and index of every non-empty piece of each text between runs of ``separators``, in order; the distinct pieces."""
    lists = pc.split_pattern_regex(texts, pattern=separators)
    rows = pc.list_parent_indices(lists).to_numpy()
    ids, distinct = coded(pc.list_flatten(lists))
    some = ids != pc.index(distinct, "").as_py()
    return rows[some], ids[some], distinct


def starts(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` texts begins in a flat array whose rows are ascending; one more for the end."""
    return np.searchsorted(rows, np.arange(n + 1))


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each text's segment, 0 for an empty one."""
    out = np.zeros(len(bounds) - 1, np.int64)
    some = bounds[1:] > bounds[:-1]
    if some.any():
        out[some] = np.add.reduceat(values.astype(np.int64), bounds[:-1][some])
    return out
