"""Operators on alignments (qname, flag, contig, pos 0-based, mapq, cigar text, seq, qual, mcontig, mpos, tlen, nm)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import scores
from ..functions import sequence as S
from .intervals import overlap_join
from .reads import ANY, Range, _filled
from .settle import small

PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY, QC_FAIL, DUPLICATE = (1 << i for i in range(11))


def has(bit: int, flag: str = "flag") -> Column:
    return F.col(flag).bitwiseAND(F.lit(bit)) != 0


def flag_of(**bits: Column) -> Column:
    """SAM FLAG as the sum of the bits whose condition holds; names as the constants, in lower case."""
    names = {n.lower(): v for n, v in globals().items() if n in ("PAIRED", "PROPER", "UNMAPPED", "MATE_UNMAPPED", "REVERSE", "MATE_REVERSE", "FIRST", "SECOND", "SECONDARY", "QC_FAIL", "DUPLICATE")}
    total = F.lit(0)
    for name, condition in bits.items():
        total = total + F.when(condition, names[name]).otherwise(0)
    return total.cast("long")


def flag_bits(df: DataFrame) -> DataFrame:
    """One boolean column for each bit."""
    names = ["paired", "proper", "unmapped", "mate_unmapped", "reverse", "mate_reverse", "first", "second", "secondary", "qc_fail", "duplicate"]
    return df.select("*", *[has(1 << i).alias(f"is_{n}") for i, n in enumerate(names)])


def to_reads(alignments: DataFrame) -> DataFrame:
    """Primary alignments as reads: sequence and quality of reverse ones restored."""
    rows = alignments.where(~has(SECONDARY))
    back = has(REVERSE)
    return rows.select(F.col("qname").alias("read_id"), F.when(has(SECOND), 2).when(has(FIRST), 1).otherwise(0).alias("mate"), F.when(back, S.revcomp("seq")).otherwise(F.col("seq")).alias("seq"), F.when(back, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"))


def match_mates(alignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (qname, first, second) of primary alignments whose mate position is the other's position, and the rows
    left over."""
    rows = alignments.where(~has(SECONDARY)).withColumn("_row", F.monotonically_increasing_id())
    side = lambda bit, name: rows.where(has(bit)).select("qname", F.struct(*rows.columns).alias(name))
    pairs = side(FIRST, "first").join(side(SECOND, "second"), "qname").where("first.mpos = second.pos AND second.mpos = first.pos")
    used = pairs.select(F.explode(F.array("first._row", "second._row")).alias("_row")).distinct()
    return pairs, rows.join(used, "_row", "left_anti").drop("_row")


def unmapped_pairs(alignments: DataFrame) -> DataFrame:
    """Names with two unmapped rows."""
    return alignments.where(has(UNMAPPED)).groupBy("qname").agg(F.count("*").alias("n")).where("n = 2").select("qname")


def is_paired(alignments: DataFrame, rows: int = 100) -> DataFrame:
    """One row: whether one of the first rows, by position, name and flag, is mapped and paired."""
    return alignments.orderBy("contig", "pos", "qname", "flag").limit(rows).agg(F.coalesce(F.max((~has(UNMAPPED) & has(PAIRED)).cast("int")), F.lit(0)).cast("boolean").alias("paired"))


def usable(max_flags: int = UNMAPPED | SECONDARY | QC_FAIL | DUPLICATE) -> Column:
    """Mask of rows that regional processing uses: mapped well, mate on the same contig, with a CIGAR."""
    return (F.col("mapq") > 0) & (F.col("mcontig") == F.col("contig")) & (F.col("cigar") != "*") & (F.col("flag").bitwiseAND(F.lit(max_flags)) == 0)


def recalibration_rows() -> Column:
    return (F.col("mapq") != 0) & ~has(SECONDARY) & ~has(UNMAPPED) & F.col("contig").isNotNull() & (F.length("seq") > 0)


def filter_alignments(alignments: DataFrame, unique: bool = False, proper: bool = False, length: Range = ANY, quality: Range = ANY, errors: Range = ANY, regions: DataFrame | None = None) -> DataFrame:
    """The rows that satisfy all; unique: one row for the name and mate. regions: contig, r_start, r_end."""
    out = alignments.where(F.length("seq").between(*length) & F.col("mapq").between(*quality) & F.col("nm").between(*errors))
    if proper:
        out = out.where(has(PROPER))
    if unique:
        mate = F.col("flag").bitwiseAND(F.lit(FIRST | SECOND))
        out = out.withColumn("_n", F.count("*").over(Window.partitionBy("qname", mate))).where("_n = 1").drop("_n")
    if regions is not None:
        spans = out.withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + F.length("seq"))
        out = overlap_join(spans, regions, ["contig"], how="left_semi").drop("start", "end")
    return out


# -- statistics of mapped rows


def scalar_stats(alignments: DataFrame) -> DataFrame:
    """Means are over all rows, as the reference values are."""
    mapped, ops = ~has(UNMAPPED), C.parse("cigar")
    n = F.length("seq")
    when = lambda x: F.sum(F.when(mapped, x).otherwise(0))
    return alignments.agg(
        F.count("*").alias("num_reads"), F.count_if(mapped).alias("num_mapped"), F.count_if(~mapped).alias("num_unmapped"),
        F.count_if(mapped & has(FIRST)).alias("num_mapped_1"), F.count_if(mapped & has(SECOND)).alias("num_mapped_2"),
        F.count_if(~mapped & has(FIRST)).alias("num_unmapped_1"), F.count_if(~mapped & has(SECOND)).alias("num_unmapped_2"),
        *[when(S.count_of("seq", b)).cast("long").alias(f"num_{b.lower()}") for b in "ACGTN"],
        when(C.number(ops, "ID")).alias("num_indels"), when(C.total(ops, "ID")).alias("indel_bases"),
        F.min(F.when(mapped, n)).cast("long").alias("min_length"), F.max(F.when(mapped, n)).cast("long").alias("max_length"),
        (when(n) / F.count("*")).alias("length_per_read"), F.min(F.when(mapped, F.col("mapq"))).cast("long").alias("min_mapq"), F.max(F.when(mapped, F.col("mapq"))).cast("long").alias("max_mapq"),
        (when(F.col("mapq")) / F.count("*")).alias("mapq_per_read"), (when(F.abs("tlen")) / F.count("*")).alias("insert_per_read"),
    )


def unique_reads(alignments: DataFrame) -> DataFrame:
    """Mapped rows with unique: the name and mate has one mapped row."""
    mate = F.col("flag").bitwiseAND(F.lit(FIRST | SECOND))
    return alignments.where(~has(UNMAPPED)).withColumn("unique", F.count("*").over(Window.partitionBy("qname", mate)) == 1)


def strand_counts(alignments: DataFrame) -> DataFrame:
    return unique_reads(alignments).groupBy(has(REVERSE).cast("long").alias("strand")).agg(F.count("*").alias("mapped"), F.count_if("unique").alias("unique_rows"))


def error_histogram(alignments: DataFrame, top: int = 20) -> DataFrame:
    counts = alignments.where(~has(UNMAPPED)).groupBy(F.least("nm", F.lit(top)).cast("long").alias("errors")).agg(F.count("*").alias("n"))
    return _filled(counts, "errors", 0, top)


def gc_percent_histogram(alignments: DataFrame) -> DataFrame:
    """By rounded 100 GC / length, 0 to 100."""
    gc = F.round(100 * S.count_of("seq", "GC") / F.length("seq")).cast("long")
    return _filled(alignments.where(~has(UNMAPPED) & (F.length("seq") > 0)).groupBy(gc.alias("gc")).agg(F.count("*").alias("n")), "gc", 0, 100)


def mapq_histogram(alignments: DataFrame) -> DataFrame:
    return _filled(alignments.where(~has(UNMAPPED)).groupBy(F.col("mapq").cast("long").alias("mapq")).agg(F.count("*").alias("n")), "mapq", 0, 255)


def mapping_summary(reads: DataFrame, alignments: DataFrame) -> DataFrame:
    """reads: read_id; alignments: read_id. Reads, mapped, unmapped, mappings and reads with several."""
    per = alignments.groupBy("read_id").agg(F.count("*").alias("hits"))
    joined = reads.select("read_id").join(per, "read_id", "left").na.fill(0, ["hits"])
    return joined.agg(F.count("*").alias("reads"), F.count_if(F.col("hits") > 0).alias("mapped"), F.count_if(F.col("hits") == 0).alias("unmapped"), F.sum("hits").alias("mappings"), F.count_if(F.col("hits") > 1).alias("multi")).withColumn("mapped_percent", 100 * F.col("mapped") / F.col("reads"))


# -- order and SAM rows


def sort_by_position(alignments: DataFrame) -> DataFrame:
    """Range-partitioned global order."""
    return alignments.orderBy("contig", "pos", "qname")


def sort_by_name(alignments: DataFrame) -> DataFrame:
    return alignments.orderBy("qname", "flag", "pos")


def sam_header(contigs: DataFrame, program: str = "seqforge") -> DataFrame:
    """line and its order: version, program, one line for each contig (name, length)."""
    rows = contigs.select(F.concat(F.lit("@SQ\tSN:"), F.col("name"), F.lit("\tLN:"), F.col("length").cast("string")).alias("line"), F.lit(2).alias("ord"))
    head = contigs.sparkSession.sql(f"SELECT '@HD\tVN:1.4\tSO:unsorted' AS line, 0 AS ord UNION ALL SELECT '@PG\tID:{program}\tVN:1.0', 1")
    return head.unionByName(rows)


def decoy_rule(alignments: DataFrame, contigs: DataFrame) -> DataFrame:
    """Drops mappings on decoy contigs (flag 2); a read with nothing else becomes unmapped with the decoy's name."""
    marked = alignments.join(small(contigs.select("contig", F.col("name").alias("_name"), (F.col("kind") == 2).alias("_decoy"))), "contig", "left")
    n = F.count("*").over(Window.partitionBy("read_id"))
    return (
        marked.withColumn("_n", n).where(~F.coalesce("_decoy", F.lit(False)) | (F.col("_n") == 1))
        .withColumn("decoy_name", F.when(F.coalesce("_decoy", F.lit(False)), F.col("_name")))
        .drop("_name", "_decoy", "_n")
    )


def sam_single(reads: DataFrame, alignments: DataFrame, contigs: DataFrame) -> DataFrame:
    """SAM columns of single reads. alignments: read_id, contig, pos, mapq, cigar (extended text), strand, score."""
    per = alignments.withColumn("_n", F.count("*").over(Window.partitionBy("read_id")))
    named = per.join(small(contigs.select("contig", "name")), "contig")
    ops = C.parse("cigar")
    rows = reads.select("read_id", "seq", "qual").join(named, "read_id", "left")
    mapped = F.col("pos").isNotNull()
    back = F.col("strand") == 1
    return rows.select(
        F.col("read_id").cast("string").alias("qname"), F.when(~mapped, 4).when(back, 16).otherwise(0).cast("long").alias("flag"),
        F.coalesce("name", F.lit("*")).alias("rname"), F.when(mapped, F.col("pos") + 1).otherwise(0).cast("long").alias("pos"),
        F.when(~mapped | (F.col("_n") > 1), 0).otherwise(F.col("mapq")).cast("long").alias("mapq"),
        F.when(mapped, C.render(C.m_form(ops))).otherwise("*").alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).cast("long").alias("pnext"), F.lit(0).cast("long").alias("tlen"),
        F.when(mapped & back, S.revcomp("seq")).otherwise(F.col("seq")).alias("seq"), F.when(mapped & back, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"),
        F.when(mapped, F.concat(F.lit("AS:i:"), F.col("score").cast("long").cast("string"), F.lit("\tNM:i:"), C.distance(ops).cast("string"))).otherwise("").alias("tags"),
    )


def rna_rows(alignments: DataFrame) -> DataFrame:
    """Adds mapq by the read's number of mappings, and tags."""
    n = F.count("*").over(Window.partitionBy("read_id"))
    return alignments.withColumn("nh", n).withColumn("mapq", scores.rna_mapq("nh")).withColumn("tags", F.concat(F.lit("AS:i:"), F.col("score").cast("long").cast("string"), F.lit("\tNM:i:"), F.col("nm").cast("string"), F.lit("\tNH:i:"), F.col("nh").cast("string")))
