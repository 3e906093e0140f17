"""Steps that several operators share: reading tables, cutting Arrow batches, ragged arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# Texts are handled in runs of about this many bytes, so that a task's memory follows this
# number (or its one longest text), not the size of an Arrow batch.
SLICE_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in runs whose ``column`` takes about ``limit`` bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        run = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64) + 64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, offsets from 0) of a text column; null is empty."""
    values = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(values.buffers()[1], np.int64)
    offsets = offsets[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """``data`` cut at ``starts`` (ascending, from 0), without copying it."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )


class Memo:
    """Values of byte strings, kept in Arrow arrays so that look-ups make no Python objects.

    ``compute`` maps a list of unknown keys to one tuple of byte strings each. The memo only
    saves work: beyond ``limit`` keys it starts anew and what is asked for is computed again.
    """

    def __init__(self, compute, columns: int, limit: int = 800_000):
        self.compute, self.limit = compute, limit
        self.empty = pa.array([], pa.large_binary())
        self.keys, self.values = self.empty, [self.empty] * columns

    def numbers(self, keys: pa.Array) -> np.ndarray:
        """Where the values of distinct ``keys`` stand in ``values``."""
        if len(self.keys) > self.limit:
            self.keys, self.values = self.empty, [self.empty] * len(self.values)
        found = pc.index_in(keys, value_set=self.keys)
        unknown = keys.filter(found.is_null())
        numbers = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).copy()
        if len(unknown):
            numbers[numbers < 0] = np.arange(len(unknown)) + len(self.keys)
            self.keys = pa.concat_arrays([self.keys, unknown])
            new = zip(*self.compute(unknown.to_pylist()))
            self.values = [
                pa.concat_arrays([old, pa.array(list(column), pa.large_binary())])
                for old, column in zip(self.values, new)
            ]
        return numbers

    def gather(self, column: int, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
        """One column's values for ``numbers`` in one buffer, and the offsets in it."""
        data, offsets = buffers(self.values[column].take(pa.array(numbers)))
        return data.tobytes(), offsets


def free_name(name: str, columns: list[str]) -> str:
    """``name`` with as many underscores behind it as keep it apart from ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
