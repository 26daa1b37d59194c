"""Operators on reads (read_id, seq, qual): filters, trimming, adapters, profiles, seeds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batches
from ..functions import sequence as S

Range = tuple[float, float]
ANY: Range = (0, 100_000)


@dataclass(frozen=True)
class ReadFilter:
    """Limits of a read filter; ranges include both ends. The ends' quality ranges hold for the mean of the first
    left_length and the last right_length bases."""

    length: Range = ANY
    quality: Range = ANY
    left_length: int = 0
    left_quality: Range = ANY
    right_length: int = 0
    right_quality: Range = ANY
    max_n: int = 100_000
    max_out_of_quality: int = 100_000
    phred: int = S.PHRED

    def without_ends(self) -> ReadFilter:
        return ReadFilter(self.length, self.quality, max_n=self.max_n, max_out_of_quality=self.max_out_of_quality, phred=self.phred)


def _between(x: Column, r: Range) -> Column:
    return x.between(r[0], r[1])


def passes(f: ReadFilter) -> Column:
    q, n = F.col("qual"), F.length("seq")
    ok = _between(n, f.length) & (S.count_of("seq", "N") <= f.max_n)
    if f.quality != ANY:
        ok &= _between(S.mean_quality(q, f.phred), f.quality)
        ok &= S.out_of_range(q, *f.quality, f.phred) <= f.max_out_of_quality
    if f.left_length:
        ok &= _between(S.mean_quality(F.substring(q, 1, f.left_length), f.phred), f.left_quality)
    if f.right_length:
        ok &= _between(S.mean_quality(F.substring(q, -f.right_length, f.right_length), f.phred), f.right_quality)
    return F.coalesce(ok, F.lit(False))


def filter_reads(reads: DataFrame, f: ReadFilter) -> DataFrame:
    """reads with passed; write it partitioned by that column for two files."""
    return reads.withColumn("passed", passes(f))


def split_counts(filtered: DataFrame) -> DataFrame:
    return filtered.agg(F.count_if("passed").alias("num_passed"), F.count_if(~F.col("passed")).alias("num_failed"))


def trim_reads(reads: DataFrame, left_length: int, left_quality: Range, right_length: int, right_quality: Range, phred: int = S.PHRED) -> DataFrame:
    """Cut bases from the left end while their quality is out of range, at most left_length; likewise at the right."""
    n = F.length("seq")
    ends = lambda text: S.qualities(text, phred)
    head = ends(F.substring("qual", 1, left_length))
    good_left = F.array_position(F.transform(head, lambda x: _between(x, left_quality).cast("int")), 1) if left_length else F.lit(1)
    cut_left = F.when(F.lit(left_length) == 0, 0).when(good_left > 0, good_left - 1).otherwise(F.least(F.lit(left_length), n))
    tail = F.reverse(ends(F.substring("qual", -max(1, right_length), max(1, right_length))))
    good_right = F.array_position(F.transform(tail, lambda x: _between(x, right_quality).cast("int")), 1)
    cut_right = F.when(F.lit(right_length) == 0, 0).when(good_right > 0, good_right - 1).otherwise(F.least(F.lit(right_length), n))
    kept = F.greatest(n - F.col("_l") - F.col("_r"), F.lit(0))
    start = (F.col("_l") + 1).cast("int")
    return (
        reads.withColumn("_l", cut_left.cast("int")).withColumn("_r", cut_right.cast("int"))
        .withColumn("_n", kept.cast("int"))
        .withColumn("qual", F.substring("qual", start, F.col("_n"))).withColumn("seq", F.substring("seq", start, F.col("_n")))
        .withColumn("edited", (F.col("_l") > 0) | (F.col("_r") > 0)).drop("_l", "_r", "_n")
    )


def trim_adapter(reads: DataFrame, adapter: str, prefix: int = 5) -> DataFrame:
    """Cut an adapter, then its reverse complement: find its first prefix bases, compare on to the nearer end and accept
    if mismatches <= round(0.1 x compared). The first accepted occurrence counts: if it touches the last third the
    right part goes, else if it touches the first third the left part; else the read stays."""
    n = F.length("seq")
    back = adapter[::-1].translate(str.maketrans("ACGTN", "TGCAN"))

    def hit(pattern: str) -> Column:
        size = len(pattern)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(n - prefix + 1, F.lit(1))), lambda i: F.substring(F.col("seq"), i, F.lit(prefix)) == pattern[:prefix])

        def wrong(i: Column) -> Column:
            return F.struct(i.alias("s"), F.least(i + size - 1, n).alias("e"), S.mismatches(F.substring(F.col("seq"), i + prefix, F.lit(size)), F.lit(pattern[prefix:])).alias("m"), (F.least(i + size - 1, n) - i - prefix + 1).alias("c"))

        return F.get(F.filter(F.transform(starts, wrong), lambda x: x["m"] <= F.round(x["c"] * 0.1)), 0)

    third = F.floor(n / 3)
    right = lambda h: (h["s"] - 1 > n - third) | (h["e"] - 1 > n - third)
    left = lambda h: (h["s"] - 1 < third) | (h["e"] - 1 < third)
    out = reads.withColumn("_h", F.coalesce(hit(adapter), hit(back))).withColumn("adapter_strand", F.when(hit(adapter).isNotNull(), 0).when(hit(back).isNotNull(), 1))
    h = F.col("_h")
    cut = F.when(h.isNull(), "none").when(right(h), "right").when(left(h), "left").otherwise("none")
    begin = F.when(F.col("adapter_cut") == "left", h["e"] + 1).otherwise(1).cast("int")
    size = F.when(F.col("adapter_cut") == "right", h["s"] - 1).when(F.col("adapter_cut") == "left", n - h["e"]).otherwise(n).cast("int")
    return (
        out.withColumn("adapter_cut", cut).withColumn("_b", begin).withColumn("_n", size)
        .withColumn("adapter_length", F.length("seq") - F.col("_n"))
        .withColumn("qual", F.substring("qual", F.col("_b"), F.col("_n"))).withColumn("seq", F.substring("seq", F.col("_b"), F.col("_n"))).drop("_h", "_b", "_n")
    )


def with_strands(reads: DataFrame) -> DataFrame:
    """Each read as it is (strand 0) and reverse-complemented (strand 1)."""
    both = F.array(F.struct(F.lit(0).alias("strand"), F.col("seq").alias("s")), F.struct(F.lit(1).alias("strand"), S.revcomp("seq").alias("s")))
    return reads.withColumn("_b", F.explode(both)).withColumn("strand", F.col("_b.strand")).withColumn("seq", F.col("_b.s")).drop("_b")


def seed_positions(length: Column, k: int, seeds: int) -> Column:
    """0-based starts: every step = max(length div seeds, k div 2) while start < length - k, and length - k if that isn't
    one of the steps."""
    step = F.greatest(F.floor(length / seeds), F.lit(k // 2)).cast("int")
    last = (length - k).cast("int")
    regular = F.sequence(F.lit(0), last - 1, step)
    extra = F.when(last % step != 0, F.array(last)).otherwise(F.array().cast("array<int>"))
    return F.when(last > 0, F.concat(regular, extra)).otherwise(F.array().cast("array<int>"))


def seeds(reads: DataFrame, k: int = 18, number: int = 20) -> DataFrame:
    """A row for each seed of each read: its place read_pos and its k-mer code. reads may have a strand."""
    spread = reads.withColumn("read_pos", F.explode(seed_positions(F.length("seq"), k, number)))
    return spread.withColumn("kmer", S.kmer_code(F.substring(F.col("seq"), F.col("read_pos") + 1, F.lit(k))))


# -- profiles


def scalar_profile(reads: DataFrame, phred: int = S.PHRED) -> DataFrame:
    counts = [F.sum(S.count_of("seq", b)).alias(f"num_{b.lower()}") for b in "ACGTN"]
    n = F.length("seq")
    return reads.agg(F.count("*").alias("num_reads"), F.min(n).cast("long").alias("min_length"), F.max(n).cast("long").alias("max_length"), F.avg(n).alias("mean_length"), F.avg(S.mean_quality("qual", phred)).alias("mean_quality"), *counts).withColumn(
        "gc_percent", 100.0 * (F.col("num_g") + F.col("num_c")) / (F.col("num_a") + F.col("num_c") + F.col("num_g") + F.col("num_t") + F.col("num_n"))
    )


def _filled(counts: DataFrame, key: str, low: int, high: int | None) -> DataFrame:
    """Counts with a row for each key from low to high (None: the largest)."""
    top = F.lit(high) if high is not None else F.coalesce(F.max(key), F.lit(low - 1))
    domain = counts.agg(top.alias("_t")).where(F.col("_t") >= low).select(F.explode(F.sequence(F.lit(low).cast("long"), F.col("_t").cast("long"))).alias(key))
    return domain.join(counts, key, "left").na.fill(0)


def length_histogram(reads: DataFrame) -> DataFrame:
    return _filled(reads.groupBy(F.length("seq").cast("long").alias("length")).agg(F.count("*").alias("n")), "length", 1, None)


def quality_histogram(reads: DataFrame, phred: int = S.PHRED) -> DataFrame:
    return reads.groupBy(F.round(S.mean_quality("qual", phred)).cast("long").alias("quality")).agg(F.count("*").alias("n"))


def gc_histogram(reads: DataFrame) -> DataFrame:
    """By the integer part of 100 (G + C) / length."""
    gc = F.floor(100 * S.count_of("seq", "GC") / F.length("seq")).cast("long")
    return reads.where(F.length("seq") > 0).groupBy(gc.alias("gc")).agg(F.count("*").alias("n"))


def bases(reads: DataFrame) -> DataFrame:
    """A row for each base: read_id, pos (from 1), base, q (Phred+33 ASCII). Aggregations above combine map-side."""
    return reads.select("read_id", "seq", "qual", F.explode(F.sequence(F.lit(1), F.length("seq"))).alias("pos")).where("length(seq) > 0").select(
        "read_id", F.col("pos").cast("long").alias("pos"), F.expr("substring(seq, pos, 1)").alias("base"), F.expr("ascii(substring(qual, pos, 1))").alias("q")
    )


def _by_position(reads: DataFrame, column: str, tally: Callable[[np.ndarray, np.ndarray], np.ndarray], names: list[str]) -> DataFrame:
    """pos (from 1) and sums: each task adds up tables of positions x names that tally makes of places and bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((0, len(names)), np.int64)
        for b in it:
            data, at = batches.flat(b.column(0))
            if len(data):
                total = batches.added(total, tally(batches.places(at), data))
        if len(total):
            yield batches.table({"pos": np.arange(1, len(total) + 1), **{n: total[:, k].copy() for k, n in enumerate(names)}})

    parts = reads.select(column).mapInArrow(run, ", ".join(["pos long", *(f"{n} long" for n in names)]))
    return parts.groupBy("pos").agg(*[F.sum(n).alias(n) for n in names])


def position_quality(reads: DataFrame, phred: int = S.PHRED) -> DataFrame:
    """pos, n, sum_q (ASCII) and mean_quality; qual has a character for each base."""

    def tally(place: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(place), np.bincount(place, q).astype(np.int64)], axis=1)

    return _by_position(reads, "qual", tally, ["n", "sum_q"]).withColumn("mean_quality", F.col("sum_q") / F.col("n") - phred)


def position_bases(reads: DataFrame) -> DataFrame:
    kind = np.full(256, 5)
    kind[np.frombuffer(b"ATGCN", np.uint8)] = np.arange(5)

    def tally(place: np.ndarray, base: np.ndarray) -> np.ndarray:
        by = np.bincount(place * 6 + kind[base], minlength=6 * (int(place.max()) + 1)).reshape(-1, 6)
        return np.column_stack([by.sum(axis=1), by[:, :5]])

    counted = _by_position(reads, "seq", tally, ["n", *(f"n_{b}" for b in "atgcn")])
    return counted.select("*", *[(100.0 * F.col(f"n_{b}") / F.col("n")).alias(f"pct_{b}") for b in "atgcn"])


def dinucleotides(reads: DataFrame) -> DataFrame:
    """dinuc (0 to 15 in the order A, G, C, T of a base and the one before it; 16 without a pair of these) and n."""
    code = np.full(256, 4)
    code[np.frombuffer(b"AGCT", np.uint8)] = np.arange(4)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(17, np.int64)
        for b in it:
            total += np.bincount(pair_codes(*batches.flat(b.column(0)), code), minlength=17)
        yield batches.table({"dinuc": np.arange(17), "n": total})

    return reads.select("seq").mapInArrow(run, "dinuc long, n long").groupBy("dinuc").agg(F.sum("n").alias("n")).where("n > 0")


def pair_codes(bases: np.ndarray, at: np.ndarray, code: np.ndarray) -> np.ndarray:
    own = code[bases]
    before = np.concatenate([[4], own[:-1]])[: len(own)]
    before[at[:-1][at[:-1] < len(own)]] = 4
    return np.where((own < 4) & (before < 4), 4 * before + own, 16)


def position_gc(reads: DataFrame, least: float = 1.0) -> DataFrame:
    gc = 100.0 * (F.col("n_g") + F.col("n_c")) / F.col("n")
    return position_bases(reads).select("pos", gc.alias("gc")).where(F.col("gc") > least)


def _kmers(reads: DataFrame, k: int) -> DataFrame:
    at = F.explode(F.sequence(F.lit(1), F.length("seq") - k + 1)).alias("pos")
    words = reads.where(F.length("seq") >= k).select("seq", at).select(F.col("pos").cast("long").alias("pos"), F.expr(f"substring(seq, pos, {k})").alias("kmer"))
    return words.where(~F.col("kmer").contains("N"))


def _kmer_sums(reads: DataFrame, k: int) -> DataFrame:
    """kmer and n of the k-mers without N (k up to 31): codes are counted batch by batch, then summed."""
    code = np.full(256, -1)
    code[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, at = batches.flat(b.column(0))
            n = len(data) - k + 1
            if n <= 0:
                continue
            digit = code[data]
            word, ok = np.zeros(n, np.int64), batches.places(at)[k - 1 :] >= k - 1
            for i in range(k):
                word = word * 4 + digit[i : i + n]
                ok &= digit[i : i + n] >= 0
            found, count = np.unique(word[ok], return_counts=True)
            letters = np.frombuffer(b"ACGT", np.uint8)[(found[:, None] >> np.arange(2 * k - 2, -1, -2)) & 3]
            yield pa.RecordBatch.from_arrays([batches.strings(letters.ravel(), np.arange(len(found) + 1) * k), pa.array(count)], names=["kmer", "n"])

    return reads.select("seq").mapInArrow(run, "kmer string, n long").groupBy("kmer").agg(F.sum("n").alias("n"))


def kmer_counts(reads: DataFrame, k: int = 5) -> DataFrame:
    """All 4^k k-mers with their counts, zero included."""
    letters = F.array(*[F.lit(b) for b in "ACGT"])
    domain = reads.sparkSession.range(1).select(F.lit("").alias("kmer"))
    for _ in range(k):
        domain = domain.select("kmer", F.explode(letters).alias("b")).select(F.concat("kmer", "b").alias("kmer"))
    return domain.join(_kmer_sums(reads, k), "kmer", "left").na.fill(0, ["n"])


def top_kmers(reads: DataFrame, k: int = 5, top: int = 20) -> DataFrame:
    return kmer_counts(reads, k).orderBy(F.desc("n"), "kmer").limit(top)


def kmer_positions(reads: DataFrame, k: int = 5, top: int = 5) -> DataFrame:
    """Counts by position of the most frequent k-mers."""
    best = F.broadcast(top_kmers(reads, k, top).select("kmer"))  # top rows
    return _kmers(reads, k).join(best, "kmer", "left_semi").groupBy("kmer", "pos").agg(F.count("*").alias("n"))
