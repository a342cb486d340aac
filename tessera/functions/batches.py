"""Texts of an Arrow batch in parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TEXT_BYTES = 1 << 20  # text that a Python worker holds at once, besides Spark's Arrow batch


def text_parts(texts: pa.Array, most: int = TEXT_BYTES) -> Iterator[list[str | None]]:
    """The texts in order, as lists of ``most`` bytes at most, or of one text.
    A batch is bounded by its rows (and, on some versions, bytes), so what is
    made of a text must not be kept for a whole batch."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        yield texts.slice(at, stop - at).to_pylist()
        at = stop


def row_parts(batch: pa.RecordBatch, col: str, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in batches of ``most`` bytes of ``col`` at most, or of one row."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def list_array(sizes: list[int], values: pa.Array) -> pa.ListArray:
    """Lists of the given sizes, one after another in ``values``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)), values)
