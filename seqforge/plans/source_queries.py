"""Queries on sources and sinks: files are written from the driver's tables into the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import lookup
from ..operators import mapping as M
from ..operators import reads as R
from ..operators import recalibration as B
from ..operators.intervals import overlap_join
from ..operators.settle import new_path, settled
from ..sources import sinks, tables
from ..sources import text_records as T
from . import mapping_queries, quality_queries
from . import views as V

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _written(spark, reads, compression=None):
    path = new_path(spark, "reads.fq")
    sinks.write_fastq(reads, path, compression=compression)
    return path


def _records(rows):
    return rows.select(F.col("read_id").cast("long").alias("read_id"), "seq", "qual")


_READS = V.duck("reads") + " SELECT read_id, seq, qual FROM reads"


@query("SC01_fastq_scan", _READS)
def fastq_scan(spark, d):
    return _records(T.read_fastq(spark, _written(spark, V.reads(spark, d))))


@query("SC02_fastq_pairs", V.duck("reads") + " SELECT read_id, CAST(1 AS BIGINT) AS mate, seq FROM reads UNION ALL SELECT read_id, 2, reverse(translate(seq, 'ACGTN', 'TGCAN')) FROM reads")
def fastq_pairs(spark, d):
    """Both files of a pair are written by the same tasks, so they have the same records."""
    both = settled(V.reads(spark, d))
    first, second = _written(spark, both), _written(spark, both.withColumn("seq", S.revcomp("seq")).withColumn("qual", F.reverse("qual")))
    files = lambda path: sorted(r[0] for r in spark.read.text(path).select("_metadata.file_path").distinct().collect())  # noqa: E731 - names of files
    rows = T.read_fastq_pairs(spark, files(first), files(second))
    return rows.select(F.col("read_id").cast("long").alias("read_id"), F.col("mate").cast("long").alias("mate"), "seq")


@query("SC03_fastq_gz", _READS)
def fastq_gz(spark, d):
    return _records(T.read_fastq(spark, _written(spark, V.reads(spark, d), "gzip")))


@query("SC04_multi_file", _READS)
def multi_file(spark, d):
    r = V.reads(spark, d)
    return _records(T.read_fastq(spark, [_written(spark, r.where("read_id % 3 = 0")), _written(spark, r.where("read_id % 3 <> 0"))]))


@query("SC10_fasta_scan", mapping_queries.ORACLES["SC10_windows"])
def fasta_scan(spark, d):
    path = new_path(spark, "genome.fa")
    sinks.write_fasta(V.genome(spark, d).select(F.concat(F.lit("c"), "contig").alias("name"), "bases"), path)
    got = T.windows_of(T.read_fasta(spark, path), V.WIDTH)
    return got.select(F.expr("bigint(substring(contig, 2))").alias("contig"), "start", "bases")


@query("SC11_index_load", mapping_queries.ORACLES["A04_index_build"])
def index_load(spark, d):
    path = new_path(spark, "index")
    M.write_index(V.index(spark, d), path, 8)
    return spark.read.parquet(path).groupBy("contig").agg(F.count("*").alias("kmers"), F.count_distinct("kmer").alias("distinct_kmers"))


@query("SC12_gtf_scan", V.duck("exons") + " SELECT 'chr' || contig AS contig, strand, s AS start, e AS \"end\", transcript % 9 AS exon_number, 'g' || transcript % 100 AS gene_id, 't' || transcript AS transcript FROM exons")
def gtf_scan(spark, d):
    path = new_path(spark, "exons.gtf")
    e = V.exons(spark, d)
    sign = F.when(F.col("strand") == 1, "-").otherwise("+")
    attributes = F.format_string('gene_id "g%d"; transcript_id "t%d"; exon_number "%d";', F.col("transcript") % 100, F.col("transcript"), F.col("transcript") % 9)
    e.select(F.concat_ws("\t", F.concat(F.lit("chr"), "contig"), F.lit("src"), F.lit("exon"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), sign, F.lit("."), attributes).alias("value")).write.text(path)
    return tables.read_gtf(spark, path).select("contig", F.col("strand").cast("long").alias("strand"), "start", "end", F.col("exon_number").cast("long").alias("exon_number"), "gene_id", "transcript")


_REGIONS = [(0, 1000, 30_000), (1, 100_000, 100_500), (3, 150_000, 199_999)]


@query("SC14_region_spec", V.duck("aln") + ", r AS (SELECT * FROM (VALUES " + ", ".join(map(str, _REGIONS)) + ") v(contig, rs, re)) SELECT frag, ln, pk, rs AS r_start FROM aln JOIN r USING (contig) WHERE pos + 1 <= re AND pos + len >= rs")
def region_spec(spark, d):
    r = tables.parse_regions(spark, ",".join(f"{c}:{s}-{e}" for c, s, e in _REGIONS)).withColumn("contig", F.col("contig").cast("long"))
    a = V.alignments(spark, d).withColumn("start", F.col("pos") + 1).withColumn("end", F.col("pos") + F.col("len"))
    return overlap_join(a, r, ["contig"]).select("frag", "ln", "pk", "r_start")


@query("SC15_range_spec", V.duck("reads") + " SELECT read_id FROM reads WHERE length(seq) BETWEEN 20 AND 90")
def range_spec(spark, d):
    return R.filter_reads(V.reads(spark, d), R.ReadFilter(length=tables.parse_range("20,90"))).where("passed").select("read_id")


@query("K09_report_text", f"WITH s AS (SELECT count(*) AS n, CAST(min(l_partkey) AS BIGINT) AS p, max(l_orderkey) AS o FROM lineitem) SELECT CAST(i AS BIGINT) AS line, t AS text FROM s, LATERAL (VALUES (0, 'Rows'), (1, '===='), (2, 'rows  : ' || n), (3, 'least : ' || p), (4, 'last  : ' || o)) v(i, t)")
def report_text(spark, d):
    stats = V.table(spark, d, "lineitem").agg(F.count("*").alias("rows"), F.min("l_partkey").alias("least"), F.max("l_orderkey").alias("last"))
    return spark.createDataFrame(list(enumerate(sinks.report_text(stats, "Rows").splitlines())), "line long, text string")


@query("K10_report_series", V.duck("reads") + " SELECT length(seq) AS length, count(*) AS n FROM reads GROUP BY 1")
def report_series(spark, d):
    path = new_path(spark, "lengths")
    sinks.write_series(R.length_histogram(V.sequences(spark, d)).where("n > 0"), path)
    return spark.read.csv(path, sep="\t", header=True, schema="length long, n long")


@query("K12_recal_persist", quality_queries.ORACLES["B06_deltas"])
def recal_persist(spark, d):
    path = new_path(spark, "recalibration")
    B.fit(quality_queries._aligned(spark, d)).write.parquet(path)
    return spark.read.parquet(path).select("level", "q", "cycle", "dinuc", F.round("delta", 5).alias("delta"))


@query("F17_exceeded_cut", mapping_queries.ORACLES["J01_seed_lookup"].replace("count(*) OVER (PARTITION BY read_id, strand, read_pos) < 2000", "count(*) OVER (PARTITION BY read_id, strand, read_pos) < 500"))
def exceeded_cut(spark, d):
    """Seeds at 500 places or more are dropped."""
    return lookup.seed_places(V.sequence_probes(spark, d), lookup.dealt(V.genome(spark, d)), limit=500)
