"""Whole columns of strings in numpy, for counts over bases: no row for each base, no string for each character."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings in a row, and the n + 1 offsets at which they begin; null is empty."""
    a = pc.fill_null(strings, "").cast(pa.string())
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = a.buffers()
    at = np.frombuffer(ends, np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """The other way round."""
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.astype(np.uint8).tobytes()))


def places(at: np.ndarray) -> np.ndarray:
    """Of each byte its place in its string, from 0."""
    return np.arange(at[-1]) - np.repeat(at[:-1], np.diff(at))


def sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of values between begin and end, which may be empty."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return upto[end] - upto[begin]


def added(total: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Sum of two tables of counts of which the first axis may be longer in one."""
    if len(total) < len(part):
        total, part = part, total
    total = total.copy()
    total[: len(part)] += part
    return total


def table(b: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in b.values()], names=list(b))


def _changes(b: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where a row's keys differ from those of the row before; always in the first."""
    out = np.ones(b.num_rows, bool)
    if b.num_rows > 1:
        out[1:] = False
        for c in (b.column(k) for k in keys):
            left, right = c.slice(0, len(c) - 1), c.slice(1)
            same = pc.fill_null(pc.equal(left, right), False).to_numpy(zero_copy_only=False) | (pc.is_null(left).to_numpy(zero_copy_only=False) & pc.is_null(right).to_numpy(zero_copy_only=False))
            out[1:] |= ~same
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of sorted rows, cut anew so that no group of equal keys is divided, and the number of each row's group."""
    held = None
    for b in batches:
        b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        new = _changes(b, keys)
        last = int(np.flatnonzero(new)[-1]) if b.num_rows else 0
        held = b.slice(last)
        if last:
            yield b.slice(0, last), np.cumsum(new[:last]) - 1
    if held is not None and held.num_rows:
        yield held, np.zeros(held.num_rows, np.int64)
