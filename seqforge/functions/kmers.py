"""k-mers, strands and prefixes of whole columns of bases in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .batches import flat, places

_CODE = np.zeros(256, np.int64)
_CODE[[ord(b) for b in "CGT"]] = 1, 2, 3
_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[[ord(b) for b in "ACGTacgt"]] = [ord(b) for b in "TGCATGCA"]


def codes(data: np.ndarray, k: int) -> np.ndarray:
    """Base-4 number of the k bytes from each byte on (A and N 0, C 1, G 2, T 3); the last k - 1 have none."""
    n = max(0, len(data) - k + 1)
    out, digits = np.zeros(n, np.int64), _CODE[data]
    for i in range(k):
        out = out * 4 + digits[i : i + n]
    return out


def reversed_complement(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bytes of all strings, each reversed and complemented."""
    size = np.diff(at)
    return _COMPLEMENT[data[np.repeat(at[1:] + at[:-1] - 1, size) - np.arange(at[-1])]]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def window_kmers(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """kmer, contig, pos of the k-mers of windows (contig, start, bases) that don't begin with N."""
    for b in slices(batches):
        data, at = flat(b.column("bases"))
        value, size = codes(data, k), np.diff(at)
        of, place = np.repeat(np.arange(b.num_rows), size), places(at)
        ok = np.flatnonzero((place + k <= size[of]) & (data != ord("N")))
        yield pa.RecordBatch.from_arrays([pa.array(value[ok]), b.column("contig").take(pa.array(of[ok])), pa.array(b.column("start").to_numpy()[of[ok]] + place[ok])], names=["kmer", "contig", "pos"])


def read_seeds(batches: Iterator[pa.RecordBatch], k: int, number: int) -> Iterator[pa.RecordBatch]:
    """read_id, strand, read_pos, kmer, length of the seeds of reads (read_id, seq) on both strands: a seed every
    step = max(length div number, k div 2) bases, and the last k bases."""
    for b in slices(batches, 5000):
        data, at = flat(b.column("seq"))
        size = np.diff(at)
        step = np.maximum(size // number, k // 2)
        last = size - k
        many = np.where(last > 0, -(-last // step) + (last % step != 0), 0)
        of = np.repeat(np.arange(b.num_rows), many)
        pos = np.minimum(places(np.concatenate([[0], np.cumsum(many)])) * step[of], last[of])
        ids, length = b.column("read_id").take(pa.array(of)), size[of]
        for strand, text in ((0, data), (1, reversed_complement(data, at))):
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(of), strand, np.int32)), pa.array(pos), pa.array(codes(text, k)[at[:-1][of] + pos] if len(of) else np.zeros(0, np.int64)), pa.array(length)], names=["read_id", "strand", "read_pos", "kmer", "length"])


def common_prefixes(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Length of the common prefix of each pair of strings."""
    (x, at), (y, bt) = flat(a), flat(b)
    n = np.minimum(np.diff(at), np.diff(bt))
    begin = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(begin, n)
    wrong = np.flatnonzero(x[np.repeat(at[:-1], n) + place] != y[np.repeat(bt[:-1], n) + place])
    out = n.copy()
    of = np.searchsorted(np.cumsum(n), wrong, side="right")
    np.minimum.at(out, of, place[wrong])
    return out
