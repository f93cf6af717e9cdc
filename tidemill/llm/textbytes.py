"""Runs of bytes of a class in columns of UTF-8 texts, found by numpy over whole slices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (null: none), A-Z in lower case, and where each text begins and the last one ends."""
    column = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()).fill_null("")  # taken, so it starts at its buffers' start
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1) if len(column) else np.zeros(1, dtype=np.int64)
    data = column.buffers()[2] if len(column) else None
    return _LOWER[np.frombuffer(data, dtype=np.uint8, count=int(offsets[-1])) if data is not None else np.zeros(0, dtype=np.uint8)], offsets


class Runs:
    """The maximal runs of bytes for which `inside` (256 flags) holds, none over a text's end.

    `text` is each run's text, `start` its first byte, `strings` the runs themselves as an Arrow column.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        there = inside[data]
        begins = there.copy()
        begins[1:] &= ~there[:-1]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        begins[heads] = there[heads]
        self.start = np.flatnonzero(begins)
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        kept = np.cumsum(there)
        bounds = np.append(kept[self.start] - 1, kept[-1] if len(kept) else 0).astype(np.int64) if len(self.start) else np.zeros(1, dtype=np.int64)
        self.strings = pa.LargeStringArray.from_buffers(len(self.start), pa.py_buffer(bounds.tobytes()), pa.py_buffer(data[there].tobytes()))
