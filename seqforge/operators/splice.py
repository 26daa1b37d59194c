"""Splice junctions, exons and spliced candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import sequence as S
from .intervals import merge_intervals

#: Fixed codes of donor and acceptor pairs; 1 and 2 are canonical, odd ones are on the forward strand.
TYPES = {"GT-AG": 1, "CT-AC": 2, "AT-AC": 3, "GT-AT": 4, "GC-AG": 5, "CT-GC": 6}
MIN_INTRON, MAX_INTRON = 40, 500_000


def splice_type(motif: Column | str) -> Column:
    """Code of a motif such as GT-AG; -1 for others."""
    m = F.col(motif) if isinstance(motif, str) else motif
    codes = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, m), F.lit(-1)).cast("long")


def splice_strand(kind: Column | str) -> Column:
    k = F.col(kind) if isinstance(kind, str) else kind
    return F.when(k.isin(2, 4, 6), 1).when(k.isin(1, 3, 5), 0).cast("long")


def is_intron(start: Column, end: Column, low: int = MIN_INTRON, high: int = MAX_INTRON) -> Column:
    return (end - start + 1).between(low, high)


def cigar_junctions(alignments: DataFrame) -> DataFrame:
    """Each N of alignments (read_id, contig, pos 0-based, cigar): 1-based first and last base of the intron, and the
    reference ends of the blocks beside it."""
    ops = C.offsets(C.parse("cigar"))
    ns = F.filter(ops, lambda o: o["op"] == "N")
    rows = alignments.select("read_id", "contig", "pos", C.reference_length(C.parse("cigar")).alias("_len"), F.explode(ns).alias("n"))
    return rows.select("read_id", "contig", (F.col("pos") + F.col("n.g") + 1).alias("start"), (F.col("pos") + F.col("n.g") + F.col("n.n")).alias("end"), (F.col("pos") + 1).alias("start_extend"), (F.col("pos") + F.col("_len")).alias("end_extend"))


def with_motif(junctions: DataFrame, reference: DataFrame, width: int) -> DataFrame:
    """Junctions with motif, kind and strand, those of recognised kinds. reference: windows (mapping.fetch)."""
    from .mapping import fetch

    row = junctions.withColumn("_row", F.monotonically_increasing_id())
    ends = row.select("_row", "contig", F.explode(F.array(F.struct(F.lit(0).alias("side"), (F.col("start") - 1).alias("s")), F.struct(F.lit(1).alias("side"), (F.col("end") - 2).alias("s")))).alias("x"))
    got = fetch(ends.select("_row", F.col("x.side").alias("side"), "contig", F.col("x.s").alias("start"), (F.col("x.s") + 2).alias("end")), reference, ["_row", "side"], width)
    motif = got.groupBy("_row").agg(F.concat_ws("-", F.max(F.when(F.col("side") == 0, F.col("bases"))), F.max(F.when(F.col("side") == 1, F.col("bases")))).alias("motif"))
    return row.join(motif, "_row").drop("_row").withColumn("kind", splice_type("motif")).where("kind > 0").withColumn("strand", splice_strand("kind"))


def count_junctions(junctions: DataFrame) -> DataFrame:
    """Reads of each (strand, contig, start, end) and the furthest extension of its blocks."""
    return junctions.groupBy("strand", "contig", "start", "end").agg(F.count("*").alias("reads"), F.min("start_extend").alias("start_extend"), F.max("end_extend").alias("end_extend"), F.max("motif").alias("motif"))


def junction_totals(junctions: DataFrame) -> DataFrame:
    k = splice_type("motif")
    return junctions.agg(F.count("*").alias("total"), F.count_if(k.isin(1, 2)).alias("canonical"), F.count_if(k.isin(3, 4, 5, 6)).alias("semi_canonical"))


def junction_rows(counted: DataFrame, human_names: bool = False) -> DataFrame:
    """Rows of the junction file: contig, start, end, name, reads, strand, motif; junctions with reads, numbered in the
    order strand, contig, start, end. The number is a global row number over distinct junctions, taken by partition
    offsets of a range sort."""
    ordered = counted.where("reads > 0").orderBy("strand", "contig", "start", "end")
    parts = ordered.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy("strand", "contig", "start", "end")))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_k"))  # a row for each partition
    before = sizes.withColumn("_o", F.coalesce(F.sum("_k").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_o")
    name = F.concat(F.lit("JUNCTION_"), (F.col("_o") + F.col("_i") - 1).cast("string"))
    contig = S.human_contig(F.col("contig").cast("string")) if human_names else F.col("contig").cast("string")
    return parts.join(F.broadcast(before), "_p").select(contig.alias("contig"), "start", "end", name.alias("name"), "reads", F.when(F.col("strand") == 0, "+").otherwise("-").alias("strand"), "motif")


def introns(exons: DataFrame) -> DataFrame:
    """Consecutive exons (contig, strand, transcript, start, end; 1-based) of a transcript: the intron between them as a
    junction without reads."""
    w = Window.partitionBy("transcript").orderBy("start", "end")
    nxt = exons.withColumn("_next", F.lead("start").over(w))
    rows = nxt.where(F.col("_next") > F.col("end") + 1).select("strand", "contig", (F.col("end") + 1).alias("start"), (F.col("_next") - 1).alias("end"))
    return rows.groupBy("strand", "contig", "start", "end").agg(F.count("*").alias("transcripts")).withColumn("reads", F.lit(0).cast("long"))


def metaexons(intervals: DataFrame, distance: int = 40) -> DataFrame:
    """Merged exon and alignment intervals (contig, start, end, left_break, right_break: null or a junction's place)
    with their distinct breaks."""
    breaks = [F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("left_break", "right_break")]
    return merge_intervals(intervals, ["contig"], distance=distance, aggregates=breaks)


def chain_over_introns(cals: DataFrame, max_intron: int = MAX_INTRON, overlap: int = 5) -> DataFrame:
    """Candidates (read_id, strand, contig, seed_id, read_start, read_end, start, end) with the number of the spliced
    candidate that each belongs to: the next one goes on if it is of another seed, keeps the read's order but for a
    small overlap, and starts within an intron of the last."""
    w = Window.partitionBy("read_id", "strand", "contig").orderBy("start", "seed_id")
    on = (F.col("seed_id") != F.lag("seed_id").over(w)) & (F.col("read_start") + overlap > F.lag("read_end").over(w)) & (F.col("start") <= F.lag("end").over(w) + max_intron)
    return cals.withColumn("_f", F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1)).withColumn("chain", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")


def junction_lookup(queries: DataFrame, junctions: DataFrame, side: str = "start", bucket: int = 1024) -> DataFrame:
    """Junctions of the query's strand and contig whose side lies in [lim_start, lim_end]."""
    j = junctions.withColumn("_t", F.floor(F.col(side) / bucket))
    q = queries.withColumn("_t", F.explode(F.sequence(F.floor(F.col("lim_start") / bucket), F.floor(F.col("lim_end") / bucket))))
    return q.join(j, ["strand", "contig", "_t"]).where(F.col(side).between(F.col("lim_start"), F.col("lim_end"))).drop("_t")


def best_split(gaps: DataFrame, kinds: tuple[str, ...] = ("GT-AG", "CT-AC"), most_errors: int = 10, low: int = MIN_INTRON) -> DataFrame:
    """Where to cut the read between two anchors. gaps: id, query (unassigned read bases, n of them), donor (n + 2 or
    more reference bases after the left anchor), acceptor (as many before the right one), left_end and right_start
    (0-based reference places: the last base of the left anchor, the first of the right one).

    Every cut l + r = n with a motif of kinds at its two ends is a candidate; its score is 0.5 a match and -0.4 a
    mismatch over both sides, and the first with the highest score is taken."""
    q = F.col("query")
    n = F.length(q)
    cuts = gaps.withColumn("l", F.explode(F.sequence(F.lit(0), n))).withColumn("r", n - F.col("l"))
    dn = F.length("acceptor")
    motif = F.concat_ws("-", F.col("donor").substr(F.col("l") + 1, F.lit(2)), F.col("acceptor").substr((dn - F.col("r") - 1).cast("int"), F.lit(2)))
    left = S.mismatches(q.substr(F.lit(1), F.col("l")), F.col("donor").substr(F.lit(1), F.col("l")))
    right = S.mismatches(q.substr(F.col("l") + 1, F.col("r")), F.col("acceptor").substr((dn - F.col("r") + 1).cast("int"), F.col("r")))
    scored = cuts.withColumn("motif", motif).where(F.col("motif").isin(*kinds)).withColumn("mism", left + right)
    found = scored.withColumn("score", 0.5 * (n - F.col("mism")) - 0.4 * F.col("mism"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "l")
    best = found.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    start, end = F.col("left_end") + F.col("l") + 2, F.col("right_start") - F.col("r")  # 1-based ends of the intron
    kind = splice_type("motif")
    return best.where((F.col("mism") <= most_errors) & (end - start + 1 >= low)).select("id", "l", "r", "motif", "mism", "score", start.alias("start"), end.alias("end"), splice_strand(kind).alias("strand"))


def search_junctions(gaps: DataFrame, **limits) -> DataFrame:
    """Canonical cuts, and semi-canonical ones where there is none."""
    first = best_split(gaps, **limits)
    rest = gaps.join(first.select("id"), "id", "left_anti")
    return first.unionByName(best_split(rest, ("AT-AC", "GT-AT", "GC-AG", "CT-GC"), **limits))


def break_candidates(donors: DataFrame, acceptors: DataFrame, slack: int = 4) -> DataFrame:
    """Donor and acceptor places (id, kind, off) of a gap (gap_read bases) of one kind, |left + right - gap| <= slack."""
    return donors.select("id", "kind", "gap_read", F.col("off").alias("left")).join(acceptors.select("id", "kind", F.col("off").alias("right")), ["id", "kind"]).where(F.abs(F.col("left") + F.col("right") - F.col("gap_read")) <= slack)


def connect_anchors(pairs: DataFrame, junctions: DataFrame) -> DataFrame:
    """Double anchors (id, strand, contig, end1, start2, gap: read bases between) joined by a known junction between
    them whose two sides use up the gap."""
    near = junction_lookup(pairs.withColumn("lim_start", F.col("end1") + 1).withColumn("lim_end", F.col("end1") + 1 + F.greatest(F.col("gap"), F.lit(0))), junctions.select("strand", "contig", F.col("start").alias("j_start"), F.col("end").alias("j_end")), "j_start")
    left, right = F.col("j_start") - F.col("end1") - 1, F.col("start2") - F.col("j_end") - 1
    return near.withColumn("l", left).withColumn("r", right).where((F.col("r") >= 0) & (F.col("l") + F.col("r") == F.col("gap"))).select("id", "strand", "contig", "j_start", "j_end", "l", "r")
