"""Tab-separated sources: annotation, alignments as text, regions; and option strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import attribute

SAM = ["qname", "flag", "rname", "pos1", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]


def read_gtf(spark: SparkSession, path: str, contigs: DataFrame | None = None) -> DataFrame:
    """Exons: contig, strand (0, 1), start, end (1-based), exon_number, gene_id, transcript_id, exon_id; those of known
    contigs (name) if contigs are given."""
    schema = "contig string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string"
    rows = spark.read.csv(path, sep="\t", comment="#", schema=schema, quote="").where("feature = 'exon'")
    if contigs is not None:
        rows = rows.join(contigs.select(F.col("name").alias("contig")).distinct(), "contig", "left_semi")
    a = F.col("attributes")
    number = F.regexp_extract(a, 'exon_number "?([0-9]+)"?', 1)
    return rows.select("contig", F.when(F.col("strand") == "-", 1).otherwise(0).alias("strand"), "start", "end", F.when(number != "", number.cast("int")).alias("exon_number"), attribute(a, "gene_id").alias("gene_id"), attribute(a, "transcript_id").alias("transcript"), attribute(a, "exon_id").alias("exon_id"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of a SAM text file: qname, flag, contig, pos (0-based), mapq, cigar, mcontig, mpos, tlen, seq, qual,
    nm, tags (map)."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> '' AND NOT startswith(value, '@')").select(*[f[i].alias(n) for i, n in enumerate(SAM)], F.slice(f, 12, 1000).alias("t"))
    tags = F.map_from_entries(F.transform("t", lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 6, 1 << 20))))
    star = lambda c: F.when(F.col(c) != "*", F.col(c))
    mate = F.when(F.col("rnext") == "=", F.col("rname")).when(F.col("rnext") != "*", F.col("rnext"))
    out = rows.select("qname", F.col("flag").cast("int").alias("flag"), star("rname").alias("contig"), (F.col("pos1").cast("long") - 1).alias("pos"), F.col("mapq").cast("int").alias("mapq"), "cigar", mate.alias("mcontig"), (F.col("pnext").cast("long") - 1).alias("mpos"), F.col("tlen").cast("long").alias("tlen"), "seq", "qual", tags.alias("tags"))
    return out.withColumn("nm", F.try_element_at("tags", F.lit("NM")).cast("long"))


def sam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """name and length of the header's sequences."""
    rows = spark.read.text(path).where("startswith(value, '@SQ')")
    return rows.select(F.regexp_extract("value", "SN:([^\t]+)", 1).alias("name"), F.regexp_extract("value", "LN:(\\d+)", 1).cast("long").alias("length"))


def parse_regions(spark: SparkSession, text: str) -> DataFrame:
    """contig, r_start, r_end of a list such as 1:3000-3200,4:100-200."""
    parts = [p.strip() for p in text.split(",") if p.strip()]
    rows = []
    for p in parts:
        contig, _, span = p.rpartition(":")
        low, _, high = span.partition("-")
        if not contig or not low.isdigit() or not high.isdigit() or int(low) > int(high):
            raise ValueError(f"not a region: {p}")
        rows.append((contig, int(low), int(high)))
    return spark.createDataFrame(rows, "contig string, r_start long, r_end long")


def read_gff_regions(spark: SparkSession, path: str) -> DataFrame:
    schema = "contig string, source string, feature string, r_start long, r_end long, score string, strand string, frame string, attributes string"
    return spark.read.csv(path, sep="\t", comment="#", schema=schema, quote="").select("contig", "r_start", "r_end")


def parse_range(text: str | None, low: int = 0, high: int = 100_000) -> tuple[int, int]:
    """(low, high) of "min,max", where either may be missing and a single number is the minimum."""
    if not text:
        return low, high
    a, _, b = text.partition(",")
    got = (int(a) if a.strip() else low, int(b) if b.strip() else high)
    if got[0] < 0 or got[1] < 0 or got[0] > got[1]:
        raise ValueError(f"not a range: {text}")
    return got
