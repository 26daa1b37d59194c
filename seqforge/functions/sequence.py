"""Column functions on base and quality strings. Positions are 0-based unless said otherwise."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import batches

PHRED = 33


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def revcomp(seq: Column | str) -> Column:
    """Reverse complement, upper case; N stays N."""
    return F.reverse(F.translate(F.upper(_c(seq)), "ACGTN", "TGCAN"))


def kmer_code(kmer: Column | str) -> Column:
    """Big-endian base-4 number of a k-mer: A and N 0, C 1, G 2, T 3 (k up to 31)."""
    return F.conv(F.translate(_c(kmer), "ACGTN", "01230"), 4, 10).cast("long")


def count_of(seq: Column | str, bases: str) -> Column:
    """How many characters of seq are in bases."""
    s = _c(seq)
    return (F.length(s) - F.length(F.translate(s, bases, ""))).cast("long")


def mismatches(a: Column | str, b: Column | str) -> Column:
    """Hamming distance over the shorter of the two."""
    a, b = _c(a), _c(b)
    n = F.least(F.length(a), F.length(b))
    at = F.sequence(F.lit(1), n)
    return F.when(n > 0, F.aggregate(at, F.lit(0), lambda t, i: t + (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))).cast("int"))).otherwise(0).cast("long")


def mismatch_quality(a: Column | str, b: Column | str, qual: Column | str) -> Column:
    """Sum of the qualities (Phred+33) where a and b differ."""
    a, b, q = _c(a), _c(b), _c(qual)
    n = F.least(F.length(a), F.length(b))
    add = lambda i: F.when(F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)), F.ascii(F.substring(q, i, F.lit(1))) - PHRED).otherwise(0)
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda t, i: t + add(i))).otherwise(0).cast("long")


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """Length of the common prefix."""
    a, b = _c(a), _c(b)
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.get(differ, 0) - 1, n)).cast("long")


def qualities(qual: Column | str, phred: int = PHRED) -> Column:
    """Array of numbers."""
    q = _c(qual)
    return F.when(F.length(q) > 0, F.transform(F.sequence(F.lit(1), F.length(q)), lambda i: F.ascii(F.substring(q, i, F.lit(1))) - phred)).otherwise(F.array().cast("array<int>"))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda t, x: t + x)


def mean_quality(qual: Column | str, phred: int = PHRED) -> Column:
    """Null for an empty string. Batches of strings are summed as one array."""

    @F.arrow_udf("double")
    def mean(q: pa.Array) -> pa.Array:
        data, at = batches.flat(q)
        n = np.diff(at)
        return pa.array(batches.sums(data, at[:-1], at[1:]) / np.maximum(n, 1) - phred, mask=n == 0)

    return mean(_c(qual))


def out_of_range(qual: Column | str, low: float, high: float, phred: int = PHRED) -> Column:
    """How many qualities are below low or above high."""

    @F.arrow_udf("long")
    def count(q: pa.Array) -> pa.Array:
        data, at = batches.flat(q)
        value = data.astype(np.int64) - phred
        return pa.array(batches.sums((value < low) | (value > high), at[:-1], at[1:]))

    return count(_c(qual))


def first_token(name: Column | str) -> Column:
    return F.split(_c(name), " ")[0]


def attribute(attributes: Column | str, key: str) -> Column:
    """Value of key "value" in a GTF attribute column; empty if it isn't there."""
    return F.regexp_extract(_c(attributes), rf'{key} "([^"]*)"', 1)


def human_contig(name: Column | str) -> Column:
    """23, 24 and 25 are X, Y and MT."""
    n = _c(name)
    return F.when(n == "23", "X").when(n == "24", "Y").when(n == "25", "MT").otherwise(n)


def dinucleotide(previous: Column | str, base: Column | str) -> Column:
    """0 to 15 in the order A, G, C, T of the first and the second base; 16 without a pair of these."""
    a, b = F.instr(F.lit("AGCT"), _c(previous)), F.instr(F.lit("AGCT"), _c(base))
    single = (F.length(_c(previous)) == 1) & (F.length(_c(base)) == 1)
    return F.when(single & (a > 0) & (b > 0), 4 * (a - 1) + b - 1).otherwise(16).cast("long")


def four_bit_bases(codes: Column) -> Column:
    """Sequence of an array of 4-bit codes: 1 A, 2 C, 4 G, 8 T, other N."""
    base = lambda c: F.when(c == 1, "A").when(c == 2, "C").when(c == 4, "G").when(c == 8, "T").otherwise("N")
    return F.array_join(F.transform(codes, base), "")


def quality_string(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda q: F.char(q + PHRED)), "")


def truth(name: Column | str) -> Column:
    """contig, start and end of a simulated read's name contig_start_end_..."""
    p = F.split(_c(name), "_")
    return F.struct(p[0].alias("contig"), p[1].cast("long").alias("start"), p[2].cast("long").alias("end"))
