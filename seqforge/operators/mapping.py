"""Parts of mapping reads to a reference: k-mer index, seeds, candidate regions, ranking (the flow is in flow.py).

The index is a table (kmer, contig, pos). Seeds meet it in one equi-join; k-mers with too many places are left out of
the index when it is built, which also bounds the join's skew. Whole-read hits are resolved first and leave the flow,
so the expensive steps see only the rest. References are tables of windows (contig, start, bases); a fetch of bases is
a join by window, never a broadcast of a genome.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import batches, kmers, scores
from ..functions import sequence as S
from . import kernels
from .intervals import islands
from .reads import with_strands

K = 18
WINDOW = 1 << 12


# -- reference and index


def base_counts(reference: DataFrame) -> DataFrame:
    return reference.agg(*[F.sum(S.count_of("bases", b)).alias(f"num_{b.lower()}") for b in "ACGTN"])


def windows(contigs: DataFrame, width: int = WINDOW, overlap: int = 0) -> DataFrame:
    """contig, start, bases: pieces of width + overlap bases. contigs: contig, bases."""
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length("bases") - 1, F.lit(0)), F.lit(width))).alias("start")
    return contigs.select("contig", "bases", at).select("contig", F.col("start").cast("long").alias("start"), F.expr(f"substring(bases, start + 1, {width + overlap})").alias("bases"))


def merge_references(reference: DataFrame, decoy: DataFrame) -> DataFrame:
    """Both, with kind 0 for the reference's contigs and 2 for decoys."""
    return reference.withColumn("kind", F.lit(0)).unionByName(decoy.withColumn("kind", F.lit(2)))


def mark_decoys(contigs: DataFrame, names: DataFrame) -> DataFrame:
    """kind 2 for contigs whose name is in names."""
    listed = names.select(F.col("name").alias("_n")).distinct()
    return contigs.join(listed, F.col("name") == F.col("_n"), "left").withColumn("kind", F.when(F.col("_n").isNotNull(), 2).otherwise(F.col("kind"))).drop("_n")


def window_kmers(windows: DataFrame, k: int = K) -> DataFrame:
    """kmer, contig, pos of every k-mer of windows (contig, start, bases) that doesn't begin with N."""
    kind = windows.schema["contig"].dataType.simpleString()
    return windows.select("contig", F.col("start").cast("long").alias("start"), "bases").mapInArrow(lambda it: kmers.window_kmers(it, k), f"kmer long, contig {kind}, pos long")


def kmer_index(reference: DataFrame, k: int = K, most: int = 2000) -> DataFrame:
    """kmer, contig, pos of every k-mer that doesn't begin with N and stands at fewer than most places. reference:
    contig, start, bases, where windows overlap by k - 1 so that each k-mer stands in one (see windows)."""
    found = window_kmers(reference, k)
    frequent = found.groupBy("kmer").agg(F.count("*").alias("n")).where(F.col("n") >= most).select("kmer")
    return found.join(frequent, "kmer", "left_anti")


def write_index(index: DataFrame, path: str, partitions: int) -> None:
    """Parquet, dealt and sorted by k-mer, so that probes prune by statistics."""
    index.repartitionByRange(partitions, "kmer").sortWithinPartitions("kmer").write.mode("overwrite").parquet(path)


def fetch(spans: DataFrame, reference: DataFrame, id_cols: list[str], width: int = WINDOW) -> DataFrame:
    """spans (id_cols, contig, start, end; half-open) with their bases. reference: windows of width without overlap."""
    first, last = F.floor(F.greatest(F.col("start"), F.lit(0)) / width), F.floor((F.col("end") - 1) / width)
    asked = spans.withColumn("_w", F.explode(F.sequence(first, F.greatest(first, last))))
    have = reference.select("contig", F.col("start").alias("_ws"), F.floor(F.col("start") / width).alias("_w"), F.col("bases").alias("_b"))
    lo, hi = F.greatest(F.col("start"), F.col("_ws")), F.least(F.col("end"), F.col("_ws") + F.length("_b"))
    piece = F.col("_b").substr((lo - F.col("_ws") + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
    parts = asked.join(have, ["contig", "_w"]).withColumn("_p", piece)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_ws", "_p"))), lambda x: x["_p"]), "")
    return parts.groupBy(*id_cols, "contig", "start", "end").agg(joined.alias("bases"))


def spanning(reference: DataFrame, longest: int, width: int = WINDOW) -> DataFrame:
    """contig, window and bases from each window's start on, as far as a span of longest bases from it may reach.
    reference: windows of width without overlap."""
    more = -(-longest // width)
    copies = reference.select("contig", F.floor(F.col("start") / width).alias("w"), "bases", F.explode(F.sequence(F.lit(0), F.lit(more))).alias("back"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("back", "bases"))), lambda x: x["bases"]), "")
    both = copies.where("w >= back").groupBy("contig", (F.col("w") - F.col("back")).alias("window")).agg(joined.alias("bases"), F.min("back").alias("first"))
    return both.where("first = 0").select("contig", "window", "bases")


class Windows(NamedTuple):
    """Windows from which spans of up to longest bases can be taken whole (see spanning)."""

    df: DataFrame
    longest: int


def reaching(reference: DataFrame, longest: int, width: int = WINDOW, known: Windows | None = None) -> Windows:
    """known if it reaches as far as longest, else such windows."""
    return known if known and known.longest >= longest else Windows(spanning(reference, longest, width), longest)


def fetch_short(spans: DataFrame, windows: Windows, width: int = WINDOW) -> DataFrame:
    """spans (contig, start, end; half-open) with their bases, by one join: no span is longer than the windows reach, so no
    pieces are put together."""
    lo = F.greatest(F.col("start"), F.lit(0))
    asked = spans.withColumn("_w", F.floor(lo / width))
    have = windows.df.select("contig", F.col("window").alias("_w"), F.col("bases").alias("_b"))
    piece = F.col("_b").substr((lo - F.col("_w") * width + 1).cast("int"), F.greatest(F.col("end") - lo, F.lit(0)).cast("int"))
    return asked.join(have, ["contig", "_w"]).withColumn("bases", piece).drop("_w", "_b")


# -- seeds and exact hits


def read_seeds(reads: DataFrame, k: int = K, number: int = 20) -> DataFrame:
    """read_id, strand, read_pos, kmer and length of each seed of both strands."""
    kind = reads.schema["read_id"].dataType.simpleString()
    return reads.select("read_id", "seq").mapInArrow(lambda it: kmers.read_seeds(it, k, number), f"read_id {kind}, strand int, read_pos long, kmer long, length long")


def seed_hits(reads: DataFrame, index: DataFrame, k: int = K, number: int = 20, limit: int = 2000) -> DataFrame:
    """read_id, strand, contig, read_pos, pos of each seed's places; seeds at limit places or more are dropped."""
    hits = read_seeds(reads, k, number).drop("length").join(index, "kmer")
    n = F.count("*").over(Window.partitionBy("read_id", "strand", "read_pos"))
    return hits.withColumn("_n", n).where(F.col("_n") < limit).select("read_id", "strand", "contig", "read_pos", "pos")


def longest_read(reads: DataFrame) -> int:
    return reads.agg(F.max(F.length("seq")).alias("n")).first()["n"] or 1


def exact_reads(reads: DataFrame, index: DataFrame, reference: DataFrame, k: int = K, most: int = 500, width: int = WINDOW, windows: Windows | None = None) -> DataFrame:
    """Whole-read matches: the first k-mer's places where the reference goes on as the read does. Reads at more than
    most places are left out."""
    both = with_strands(reads).where(F.length("seq") >= k)
    probe = both.select("read_id", "strand", F.col("seq").alias("s"), S.kmer_code(F.substring("seq", 1, k)).alias("kmer"))
    places = probe.join(index, "kmer").select("read_id", "strand", "s", "contig", F.col("pos").alias("start"), (F.col("pos") + F.length("s")).alias("end"))
    got = fetch_short(places, windows or reaching(reference, longest_read(reads), width), width).where("bases = s")
    n = F.count("*").over(Window.partitionBy("read_id"))
    return got.select("read_id", "strand", "contig", F.col("start").alias("pos"), F.length("s").alias("_l")).withColumn("_n", n).where(F.col("_n") <= most).select("read_id", "strand", "contig", "pos", F.concat(F.col("_l").cast("string"), F.lit("=")).alias("cigar"), F.col("_l").cast("long").alias("length"))


def longest_matches(hits: DataFrame, reads: DataFrame, reference: DataFrame, k: int = K, width: int = WINDOW) -> DataFrame:
    """Of each seed the hits with the longest match to the right, all ties, with match_len."""
    sides = with_strands(reads).select("read_id", "strand", F.col("seq").alias("s"))
    spans = hits.join(sides, ["read_id", "strand"]).select("read_id", "strand", "read_pos", F.expr("substring(s, int(read_pos + 1))").alias("rest"), "contig", F.col("pos").alias("start"), (F.col("pos") + F.length("s") - F.col("read_pos")).alias("end"))
    got = fetch_short(spans, reaching(reference, longest_read(reads), width), width)
    names = ["read_id", "strand", "contig", "read_pos", "start"]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = kmers.common_prefixes(b.column("rest"), b.column("bases"))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(n)], names=[*names, "match_len"])

    kinds = {f.name: f.dataType.simpleString() for f in got.schema.fields}
    long = got.select(*names, "rest", "bases").mapInArrow(measured, ", ".join(f"{c} {kinds[c]}" for c in names) + ", match_len long")
    best = F.max("match_len").over(Window.partitionBy("read_id", "strand", "read_pos"))
    return long.withColumn("_m", best).where("match_len = _m").select("read_id", "strand", "contig", "read_pos", F.col("start").alias("pos"), "match_len")


# -- candidate regions


def diagonal_regions(seeds_: DataFrame, length: str = "length", band: int = 200) -> DataFrame:
    """Seeds (read_id, strand, contig, read_start, read_end, g_start, g_end inclusive, length) merged to regions: a seed
    goes on if its read and genome gaps are at most length and differ by less than band."""
    w = Window.partitionBy("read_id", "strand", "contig").orderBy("g_start", "read_start")
    r_gap, g_gap = F.col("read_start") - F.lag("read_end").over(w), F.col("g_start") - F.lag("g_end").over(w)
    on = (r_gap <= F.col(length)) & (g_gap <= F.col(length)) & (F.abs(r_gap - g_gap) < band)
    marked = seeds_.withColumn("_f", F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1)).withColumn("cal", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("read_id", "strand", "contig", "cal").agg(F.min("g_start").alias("start"), F.max("g_end").alias("end"), F.min("read_start").alias("read_start"), F.max("read_end").alias("read_end"), F.sum(F.col("read_end") - F.col("read_start") + 1).alias("read_area"), F.count("*").alias("n_seeds")).drop("cal")


def distance_regions(seeds_: DataFrame, length: str = "length") -> DataFrame:
    """Seeds merged by genome distance alone, at most the read's length."""
    marked = islands(seeds_, ["read_id", "strand", "contig"], "g_start", "g_end", F.col(length))
    return marked.groupBy("read_id", "strand", "contig", "island").agg(F.min("g_start").alias("start"), F.max("g_end").alias("end"), F.count("*").alias("n_seeds")).drop("island")


def valid_regions(cals: DataFrame) -> DataFrame:
    """read_area at least a third of the read, open gaps under 5 %, mismatches under 9 %. cals: length, read_area,
    open_gaps, mism."""
    n = F.col("length")
    return cals.where((F.col("read_area") >= F.floor(n / 3)) & (F.col("open_gaps") < 0.05 * n) & (F.col("mism") < 0.09 * n))


def gap_limit(seeds_: DataFrame, keys: list[str], most: int = 2000) -> DataFrame:
    """keys and invalid: a read or genome gap between neighbours, or an open end, is longer than most."""
    w = Window.partitionBy(*keys).orderBy("g_start")
    gap = F.greatest(F.col("read_start") - F.lag("read_end").over(w) - 1, F.col("g_start") - F.lag("g_end").over(w) - 1)
    return seeds_.withColumn("_g", gap).groupBy(*keys).agg((F.coalesce(F.max("_g"), F.lit(0)) > most).alias("wide"), F.min("read_start").alias("_a"), F.max("read_end").alias("_b"), F.max("length").alias("_n")).select(*keys, (F.col("wide") | (F.col("_a") > most) | (F.col("_n") - 1 - F.col("_b") > most)).alias("invalid"))


def good_seed(cigar: str = "cigar", run: int = 10, least: int = 20):
    """Runs of = longer than run sum to more than least."""
    return F.aggregate(F.filter(C.parse(cigar), lambda o: (o["op"] == "=") & (o["n"] > run)), F.lit(0), lambda t, o: t + o["n"]) > least


def coherent_regions(cals: DataFrame, seeds_: DataFrame, cap: int = 100) -> DataFrame:
    """Regions (read_id, strand, contig, cal) whose seeds neither overlap, run backwards nor jump over the genome by
    more than twice the read; at most cap a read, by start."""
    w = Window.partitionBy("read_id", "strand", "contig", "cal").orderBy("g_start")
    bad = (F.col("read_start") <= F.lag("read_end").over(w)) | (F.col("g_start") <= F.lag("g_end").over(w)) | (F.col("g_start") - F.lag("g_end").over(w) > 2 * F.col("length"))
    keys = ["read_id", "strand", "contig", "cal"]
    broken = seeds_.withColumn("_b", F.coalesce(bad, F.lit(False)).cast("int")).groupBy(*keys).agg(F.max("_b").alias("_b")).where("_b = 1")
    left = cals.join(broken, keys, "left_anti")
    return left.withColumn("_r", F.row_number().over(Window.partitionBy("read_id").orderBy("start", "strand", "contig"))).where(F.col("_r") <= cap).drop("_r")


def cal_scores(seeds_: DataFrame, keys: list[str]) -> DataFrame:
    """read_area and score of each region. At each seed, in order, the errors so far are charged: area is the sum of
    span - (mism + 2 open + ext), all cumulative."""
    w = Window.partitionBy(*keys).orderBy("g_start", "read_start").rowsBetween(Window.unboundedPreceding, 0)
    m, o, e = (F.sum(c).over(w) for c in ("mism", "open_gaps", "ext_gaps"))
    charged = seeds_.withColumn("_a", F.col("read_end") - F.col("read_start") + 1 - (m + 2 * o + e))
    sums = charged.groupBy(*keys).agg(F.sum("_a").alias("read_area"), *[F.sum(c).alias(c) for c in ("mism", "open_gaps", "ext_gaps")])
    return sums.withColumn("score", F.col("read_area") - 5 * F.col("mism") - 7 * F.col("open_gaps") - 2 * F.col("ext_gaps"))


# -- ranking (cals: read_id, score, read_area, invalid, ...)


def rank_regions(cals: DataFrame, near: int = 7) -> DataFrame:
    """rank, best, second and num_hits of each candidate; the order is by score, then place."""
    w = Window.partitionBy("read_id").orderBy(F.desc("score"), "contig", "start", "strand")
    whole = Window.partitionBy("read_id")
    ranked = cals.withColumn("rank", F.row_number().over(w)).withColumn("best", F.max("score").over(whole)).withColumn("second", F.max(F.when(F.col("rank") == 2, F.col("score"))).over(whole))
    close = (F.abs(F.col("best").cast("int") - F.col("score").cast("int")) < near) & (F.col("rank") > 1)
    return ranked.withColumn("num_hits", 1 + F.sum(close.cast("int")).over(whole))


def with_mapq(ranked: DataFrame) -> DataFrame:
    """mapq of the best, from its read_area, for all candidates of the read."""
    area = F.max(F.when(F.col("rank") == 1, F.col("read_area"))).over(Window.partitionBy("read_id"))
    return ranked.withColumn("_a", area).withColumn("mapq", scores.mapq("_a", "best", "second", "num_hits")).drop("_a")


def select_best(ranked: DataFrame) -> DataFrame:
    """Nothing if the best is invalid or an invalid candidate is within twice the read's length of its score; else the
    best if its mapq is positive, else the num_hits best."""
    whole = Window.partitionBy("read_id")
    bad = F.max((F.col("invalid") & ((F.col("rank") == 1) | (F.col("best") - F.col("score") < 2 * F.col("length")))).cast("int")).over(whole)
    return ranked.withColumn("_bad", bad).where("_bad = 0").where(F.col("rank") <= F.when(F.col("mapq") > 0, 1).otherwise(F.col("num_hits"))).drop("_bad")


def max_score_regions(cals: DataFrame) -> DataFrame:
    """Candidates whose CIGAR covers the read within gap and mismatch limits and whose score reaches the best of them.
    cals: cigar text (extended), length."""
    ops = C.parse("cigar")
    n = F.col("length")
    ok = (C.read_length(ops) == n) & (C.number(ops, "ID") < 0.05 * n) & (C.total(ops, "X") < 0.09 * n)
    scored = cals.withColumn("cigar_score", scores.cigar_score(ops)).withColumn("_ok", ok)
    top = F.max(F.when(F.col("_ok"), F.col("cigar_score"))).over(Window.partitionBy("read_id"))
    return scored.withColumn("_t", top).where(F.col("_ok") & (F.col("cigar_score") >= F.col("_t"))).drop("_ok", "_t")


def area_filters(cals: DataFrame, largest: bool = False, most_errors: int | None = None, fewest_mismatches: bool = False) -> DataFrame:
    """Keep the largest read_area, an error-free area of at most most_errors, or the fewest mismatches of each read."""
    w = Window.partitionBy("read_id")
    out = cals
    if largest:
        out = out.withColumn("_x", F.max("read_area").over(w)).where("read_area = _x").drop("_x")
    if most_errors is not None:
        out = out.where(F.col("read_area") - F.col("mism") <= most_errors)
    if fewest_mismatches:
        out = out.withColumn("_x", F.min("mism").over(w)).where("mism = _x").drop("_x")
    return out


def rna_rank(cals: DataFrame, cap: int = 200, keep: int = 5, least: float = 30) -> DataFrame:
    """Candidates by covered percentage of the read: at most cap, the best keep while at least least; the first always."""
    w = Window.partitionBy("read_id").orderBy("arrival")
    capped = cals.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")
    scored = capped.withColumn("coverage", (F.col("covered") * 100 / F.col("length")))
    by = Window.partitionBy("read_id").orderBy(F.desc("coverage"), "arrival")
    return scored.withColumn("rank", F.row_number().over(by)).where((F.col("rank") <= keep) & ((F.col("rank") == 1) | (F.col("coverage") >= least)))


def chains(fragments: DataFrame, keys: tuple[str, ...] = ("read_id", "strand", "contig")) -> DataFrame:
    """Best collinear chain of the fragments (r_start, r_end, g_start, g_end, inclusive) of each group of equal keys, with
    chain_score. Rows are dealt and sorted by group; whole batches of groups are chained at once. A read has a bounded
    number of fragments (seeds x limit of places), so a group is small."""
    kind = fragments.schema
    names = [*keys, "r_start", "r_end", "g_start", "g_end"]
    ddl = ", ".join(f"{n} {kind[n].dataType.simpleString()}" for n in names)

    def best(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, group in batches.whole_groups(batches_, list(keys)):
            rows, score = kernels.chains(group, *[b.column(c).to_numpy() for c in names[-4:]])
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(rows)).columns, pa.array(score[group[rows]])], names=[*names, "chain_score"])

    dealt = fragments.select(*names).repartition(*keys).sortWithinPartitions(*keys, "g_start", "r_start")
    return dealt.mapInArrow(best, ddl + ", chain_score double")
