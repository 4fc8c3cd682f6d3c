"""Shuffles of packed arrays: rows of (part, a binary for each column), made and read by numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Parts of a packed shuffle: at most so many.
MAX_PARTS = 1 << 15


def parts_for(rows: int, each: int, at_least: int) -> int:
    """A power of two: parts of about `each` rows."""
    wanted = max(1, at_least, -(-rows // each))
    return min(MAX_PARTS, 1 << (wanted - 1).bit_length())


def parted(key: np.ndarray, parts: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """(part, a binary of each column): a row for each part of the keys (uint64, well mixed) that
    occurs, with the bytes of its share of the columns, in their order. A shuffle of such rows moves
    whole arrays, so the JVM handles some thousand rows instead of millions."""
    part = (key >> np.uint64(64 - parts.bit_length() + 1)).astype(np.uint16) if parts > 1 else np.zeros(len(key), np.uint16)
    order = np.argsort(part, kind="stable")
    count = np.bincount(part, minlength=parts)
    some = np.flatnonzero(count)
    ends = np.r_[0, np.cumsum(count[some])]
    data = []
    for a in columns.values():
        sorted_ = np.ascontiguousarray(a[order])
        data.append(pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((ends * a.itemsize).astype(np.int32)), pa.py_buffer(sorted_)]))
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *data], ["part", *columns])


def all_of(batch: pa.RecordBatch, column: int, kind: type) -> np.ndarray:
    """The values in all rows of a binary column, one behind the other."""
    c = batch.column(column)
    offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
    return np.frombuffer(c.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind) if len(c) and offsets[-1] > offsets[0] else np.zeros(0, kind)


def batches_of(batches: Iterator[pa.RecordBatch], kinds: list[type], most: int) -> Iterator[list[np.ndarray]]:
    """The columns behind the first (part), as arrays of about `most` values at a time."""
    held: list[list[np.ndarray]] = [[] for _ in kinds]
    size = 0
    for batch in batches:
        for i, kind in enumerate(kinds):
            held[i].append(all_of(batch, i + 1, kind).copy())
        size += len(held[0][-1])
        if size >= most:
            yield [np.concatenate(h) for h in held]
            held, size = [[] for _ in kinds], 0
    if size:
        yield [np.concatenate(h) for h in held]
