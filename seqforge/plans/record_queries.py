"""Queries on records and names: encodings, contig lookups, mate columns, text lines, chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import mapping as M
from ..operators import pairing as P
from ..operators import realign, splice
from . import views as V

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("A03_kmer_encode", V.duck("reads") + """, w AS (SELECT read_id, i AS pos, substr(seq, CAST(i + 1 AS BIGINT), 18) AS w FROM (SELECT read_id, seq, unnest(range(0, length(seq) - 17)) AS i FROM reads) WHERE substr(seq, CAST(i + 1 AS BIGINT), 1) <> 'N')
 SELECT read_id, pos, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(w, ''), lambda b: CAST(CASE b WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 0 END AS BIGINT))), lambda x, y: x * 4 + y) AS kmer FROM w""")
def kmer_encode(spark, d):
    """The codes of all 18-mers of all reads that don't begin with N."""
    return M.window_kmers(V.sequences(spark, d).select(F.col("read_id").alias("contig"), F.lit(0).cast("long").alias("start"), F.col("seq").alias("bases"))).select(F.col("contig").alias("read_id"), "pos", "kmer")


@query("A05_merged_references", V.duck("genome") + """ SELECT contig, length(bases) AS length, CASE WHEN contig % 3 = 0 OR contig % 7 = 0 THEN 2 ELSE 0 END AS kind FROM genome""")
def merged_references(spark, d):
    """Contigs of two references, the second one decoys, and further decoys by name."""
    g = V.genome(spark, d).select("contig", F.length("bases").cast("long").alias("length"), F.concat(F.lit("chr"), "contig").alias("name"))
    both = M.merge_references(g.where("contig % 3 <> 0"), g.where("contig % 3 = 0"))
    return M.mark_decoys(both, g.where("contig % 7 = 0").select("name")).select("contig", "length", "kind")


@query("F19_intron_range", V.duck("exons") + """, n AS (SELECT transcript, contig, e + 1 AS s, lead(s) OVER (PARTITION BY transcript, contig ORDER BY s, e) - 1 AS e FROM exons) SELECT transcript, contig, s AS start, e AS "end" FROM n WHERE e - s + 1 BETWEEN 40 AND 500000""")
def intron_range(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("transcript", "contig").orderBy("start", "end")
    gaps = V.exons(spark, d).select("transcript", "contig", (F.col("end") + 1).alias("s"), (F.lead("start").over(w) - 1).alias("e"))
    return gaps.where(splice.is_intron(F.col("s"), F.col("e"))).select("transcript", "contig", F.col("s").alias("start"), F.col("e").alias("end"))


@query("J14_contig_lookup", V.duck("aln", "contigs") + " SELECT frag, ln, pk, name, length, kind FROM aln JOIN contigs USING (contig)")
def contig_lookup(spark, d):
    """A header's contigs are few by nature; a broadcast is left to the optimizer, which sees their size."""
    return V.alignments(spark, d).join(V.contigs(spark, d), "contig").select("frag", "ln", "pk", "name", "length", "kind")


@query("X07_truth", V.duck("aln") + " SELECT frag, ln, pk, contig || '' AS contig, pos AS start, pos + len AS \"end\", mpos BETWEEN pos AND pos + len AS inside FROM aln")
def truth(spark, d):
    a = V.alignments(spark, d).withColumn("name", F.concat_ws("_", "contig", "pos", F.col("pos") + F.col("len"), F.lit("0"), "ln")).withColumn("t", S.truth("name"))
    return a.select("frag", "ln", "pk", F.col("t.contig").alias("contig"), F.col("t.start").alias("start"), F.col("t.end").alias("end"), F.col("mpos").between(F.col("t.start"), F.col("t.end")).alias("inside"))


@query("X09_names", """SELECT o_orderkey AS id, 'g' || o_custkey AS gene, '' AS missing, CASE o_orderkey % 27 WHEN 23 THEN 'X' WHEN 24 THEN 'Y' WHEN 25 THEN 'MT' ELSE CAST(o_orderkey % 27 AS VARCHAR) END AS contig, 'r' || o_orderkey AS token FROM orders""")
def names(spark, d):
    """First tokens, attributes of annotation rows and contig names."""
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr("""concat('gene_id "g', o_custkey, '"; exon_number "1";')""").alias("attributes"), F.expr("concat('r', o_orderkey, ' length=100')").alias("name"))
    return o.select("id", S.attribute("attributes", "gene_id").alias("gene"), S.attribute("attributes", "transcript_id").alias("missing"), S.human_contig((F.col("id") % 27).cast("string")).alias("contig"), S.first_token("name").alias("token"))


@query("K08_fastq_lines", V.duck("reads") + " SELECT read_id, '@r' || read_id || chr(10) || seq || chr(10) || '+' || chr(10) || qual AS record FROM reads")
def fastq_lines(spark, d):
    return V.reads(spark, d).select("read_id", F.concat_ws("\n", F.concat(F.lit("@r"), "read_id"), "seq", F.lit("+"), "qual").alias("record"))


@query("W15_mispaired_mates", V.duck("aln") + """, a AS (SELECT DISTINCT frag AS fragment, 2 - ln % 2 AS mate, contig, pos, pk * 10 + ln AS id FROM aln),
 f AS (SELECT fragment, 3 - mate AS mate, contig AS mcontig, pos AS mpos FROM a QUALIFY row_number() OVER (PARTITION BY fragment, mate ORDER BY id, contig, pos) = 1),
 n AS (SELECT *, count(*) OVER (PARTITION BY fragment, mate) AS n FROM a)
 SELECT fragment, mate, id, contig, pos, CASE WHEN n = 1 THEN 3 WHEN n = 2 THEN 2 WHEN n BETWEEN 3 AND 8 THEN 1 ELSE 0 END AS map_quality, mcontig, mpos FROM n LEFT JOIN f USING (fragment, mate)""")
def mispaired_mates(spark, d):
    a = V.alignments(spark, d).selectExpr("frag AS fragment", "2 - ln % 2 AS mate", "contig", "pos", "pk * 10 + ln AS id").distinct()
    return P.mispaired(a).select("fragment", "mate", "id", "contig", "pos", "map_quality", "mcontig", "mpos")


@query("L03_reads_in_regions", V.duck("aln") + """, r AS (SELECT DISTINCT contig, pos // 5000 * 5000 AS s, pos // 5000 * 5000 + 40 AS e FROM aln)
 SELECT frag, ln, pk, r.s AS region_start FROM aln JOIN r ON r.contig = aln.contig AND pos + 1 <= r.e AND pos + CASE nm % 3 WHEN 1 THEN len + 2 WHEN 2 THEN len - 2 ELSE len END >= r.s""")
def reads_in_regions(spark, d):
    a = V.alignments(spark, d)
    regions = a.selectExpr("contig", "pos div 5000 * 5000 AS start", "pos div 5000 * 5000 + 40 AS end").distinct()
    return realign.reads_in_regions(a, regions).select("frag", "ln", "pk", "region_start")


@query("A09_chain", V.duck("aln").replace("WITH ", "WITH RECURSIVE ", 1) + """,
 f AS (SELECT *, row_number() OVER (PARTITION BY read_id, strand, contig ORDER BY g_start, r_start) AS k FROM (SELECT DISTINCT frag AS read_id, flag // 16 % 2 AS strand, contig, ln * 10 AS r_start, ln * 10 + 17 AS r_end, pos AS g_start, pos + 17 AS g_end FROM aln)),
 p AS (SELECT read_id, strand, contig, k, r_end, g_end, 18 AS score, [k] AS path FROM f
  UNION ALL SELECT f.read_id, f.strand, f.contig, f.k, f.r_end, f.g_end, p.score - abs((f.g_start - p.g_end) - (f.r_start - p.r_end)) + 18, list_concat([f.k], p.path) FROM p JOIN f ON f.read_id = p.read_id AND f.strand = p.strand AND f.contig = p.contig
   AND p.r_end < f.r_start AND p.g_end < f.g_start AND p.score - abs((f.g_start - p.g_end) - (f.r_start - p.r_end)) > 0),
 best AS (SELECT read_id, strand, contig, score, unnest(path) AS k FROM p QUALIFY row_number() OVER (PARTITION BY read_id, strand, contig ORDER BY score DESC, path) = 1)
 SELECT read_id, strand, contig, r_start, r_end, g_start, g_end, CAST(score AS DOUBLE) AS chain_score FROM best JOIN f USING (read_id, strand, contig, k)""")
def chain(spark, d):
    """Best collinear chain of the seeds of each fragment, strand and contig."""
    a = V.alignments(spark, d).selectExpr("frag AS read_id", "flag div 16 % 2 AS strand", "contig", "ln * 10 AS r_start", "ln * 10 + 17 AS r_end", "pos AS g_start", "pos + 17 AS g_end").distinct()
    return M.chains(a)
