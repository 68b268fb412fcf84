"""Runs of characters of many texts at once: boundaries by numpy, distinct
runs by Arrow's hash table, so no text is taken apart word by word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text cut together; a longer text is cut alone.
TOGETHER = 2 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the ``n + 1`` offsets; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, together: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``together`` bytes of text, one row at least."""
    for batch in batches:
        _, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + together, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def array_of(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Values that stand one after the other in ``flat``."""
    kept = [pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, *kept])


def split_runs(raw: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Maximal runs of the bytes marked ``inside``, none across two texts:
    the text number of each run, and the runs."""
    edge = np.zeros(len(raw) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[at] = True
    cut = np.flatnonzero(edge)
    starts, ends = cut[:-1], cut[1:]
    held = inside[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[held], ends[held]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    return np.searchsorted(at, starts, side="right") - 1, array_of(raw[inside], offsets)


def distinct(values: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """The code of each value and the distinct values."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A copy with A-Z in lower case."""
    return raw + (((raw >= 65) & (raw <= 90)).view(np.uint8) << 5)
