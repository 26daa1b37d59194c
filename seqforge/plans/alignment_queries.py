"""Queries on alignments: filters, statistics, depth, order, SAM rows, CIGAR algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cigar as C
from ..operators import alignments as A
from ..operators import intervals as I
from ..operators import realign
from . import views as V

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_ALN = V.duck("aln")
_KEY = ["frag", "ln", "pk"]


@query("SC05_bam_single", _ALN + " SELECT frag, ln, pk, CASE WHEN flag & 16 <> 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq FROM aln WHERE flag & 256 = 0")
def bam_single(spark, d):
    a = V.alignments(spark, d).withColumn("qual", F.col("seq"))
    named = a.withColumn("qname", F.struct(*_KEY))
    return A.to_reads(named).select("read_id.*", "seq")


@query("SC06_bam_paired", _ALN + """, r AS (SELECT *, pos % 50 AS p2, (pos * 3) % 50 AS m2 FROM aln WHERE flag & 256 = 0)
 SELECT a.qname, a.ln AS ln1, a.pk AS pk1, b.ln AS ln2, b.pk AS pk2 FROM r a JOIN r b USING (qname) WHERE a.flag & 64 <> 0 AND b.flag & 128 <> 0 AND a.m2 = b.p2 AND b.m2 = a.p2""")
def bam_paired(spark, d):
    a = V.alignments(spark, d).withColumn("mpos", F.col("pos") * 3 % 50).withColumn("pos", F.col("pos") % 50)
    pairs, _ = A.match_mates(a)
    return pairs.select("qname", F.col("first.ln").alias("ln1"), F.col("first.pk").alias("pk1"), F.col("second.ln").alias("ln2"), F.col("second.pk").alias("pk2"))


@query("SC07_bam_unmapped", _ALN + " SELECT qname FROM aln WHERE flag & 4 <> 0 GROUP BY 1 HAVING count(*) = 2")
def bam_unmapped(spark, d):
    return A.unmapped_pairs(V.alignments(spark, d))


@query("SC08_conflicts", _ALN + """, r AS (SELECT *, row_number() OVER () AS id, pos % 50 AS p2, (pos * 3) % 50 AS m2 FROM aln WHERE flag & 256 = 0),
 u AS (SELECT a.id AS x, b.id AS y FROM r a JOIN r b USING (qname) WHERE a.flag & 64 <> 0 AND b.flag & 128 <> 0 AND a.m2 = b.p2 AND b.m2 = a.p2)
 SELECT frag, ln, pk FROM r WHERE id NOT IN (SELECT x FROM u UNION SELECT y FROM u)""")
def conflicts(spark, d):
    a = V.alignments(spark, d).withColumn("mpos", F.col("pos") * 3 % 50).withColumn("pos", F.col("pos") % 50)
    return A.match_mates(a)[1].select(*_KEY)


@query("SC09_is_pair", _ALN + " SELECT bool_or(flag & 4 = 0 AND flag & 1 = 1) AS paired FROM aln")
def is_pair(spark, d):
    return A.is_paired(V.alignments(spark, d))


@query("F04_bam_filter", _ALN + """, r AS (SELECT * FROM aln WHERE len BETWEEN 60 AND 90 AND mapq BETWEEN 20 AND 60 AND nm BETWEEN 0 AND 6 AND flag & 2 <> 0 AND contig = 1 AND pos + len >= 3000 AND pos <= 120000)
 SELECT frag, ln, pk, pos FROM (SELECT *, count(*) OVER (PARTITION BY qname, flag & 192) AS n FROM aln WHERE len BETWEEN 60 AND 90 AND mapq BETWEEN 20 AND 60 AND nm BETWEEN 0 AND 6 AND flag & 2 <> 0) WHERE n = 1 AND contig = 1 AND pos + len >= 3000 AND pos <= 120000""")
def bam_filter(spark, d):
    regions = spark.sql("SELECT 1L AS contig, 3000L AS r_start, 120000L AS r_end")
    return A.filter_alignments(V.alignments(spark, d), unique=True, proper=True, length=(60, 90), quality=(20, 60), errors=(0, 6), regions=regions).select(*_KEY, "pos")


@query("F05_region_overlap", _ALN + """, g AS (SELECT CAST(i % 5 AS BIGINT) AS contig, CAST(i * 1900 AS BIGINT) AS rs, CAST(i * 1900 + 400 AS BIGINT) AS re FROM range(100) t(i))
 SELECT frag, ln, pk, rs AS r_start FROM aln JOIN g USING (contig) WHERE NOT (pos + len < rs OR pos > re)""")
def region_overlap(spark, d):
    regions = spark.range(100).selectExpr("id % 5 AS contig", "id * 1900 AS r_start", "id * 1900 + 400 AS r_end")
    spans = V.alignments(spark, d).select(*_KEY, "contig", F.col("pos").alias("start"), (F.col("pos") + F.col("len")).alias("end"))
    return I.overlap_join(spans, regions, ["contig"]).select(*_KEY, "r_start")


@query("F06_read_mask", _ALN + " SELECT frag, ln, pk, mapq > 0 AND mcontig = contig AND cigar <> '*' AND flag & 1796 = 0 AS usable FROM aln")
def read_mask(spark, d):
    return V.alignments(spark, d).select(*_KEY, A.usable().alias("usable"))


@query("F07_recal_read_mask", _ALN + " SELECT frag, ln, pk FROM aln WHERE mapq <> 0 AND flag & 256 = 0 AND flag & 4 = 0")
def recal_mask(spark, d):
    return V.alignments(spark, d).where(A.recalibration_rows()).select(*_KEY)


@query("K03_flags", _ALN + " SELECT frag, ln, pk, " + ", ".join(f"flag & {1 << i} <> 0 AS is_{n}" for i, n in enumerate(["paired", "proper", "unmapped", "mate_unmapped", "reverse", "mate_reverse", "first", "second", "secondary", "qc_fail", "duplicate"])) + ", flag FROM aln")
def flags(spark, d):
    bits = A.flag_bits(V.alignments(spark, d))
    names = [c for c in bits.columns if c.startswith("is_")]
    again = A.flag_of(**{n[3:]: F.col(n) for n in names})
    return bits.select(*_KEY, *names, again.alias("flag"))


@query("K01_sam_header", V.duck("contigs") + " SELECT '@HD\tVN:1.4\tSO:unsorted' AS line, 0 AS ord UNION ALL SELECT '@PG\tID:seqforge\tVN:1.0', 1 UNION ALL SELECT '@SQ\tSN:' || name || '\tLN:' || length, 2 FROM contigs")
def sam_header(spark, d):
    return A.sam_header(V.contigs(spark, d))


@query("K02_sam_single", V.duck("aln", "contigs") + """, r AS (SELECT DISTINCT ON (o_orderkey) o_orderkey AS read_id FROM orders),
 m AS (SELECT frag AS read_id, contig, pos, mapq, flag // 16 % 2 AS strand, len, nm, count(*) OVER (PARTITION BY frag) AS n FROM aln WHERE ln <= 2)
 SELECT CAST(read_id AS VARCHAR) AS qname, CASE WHEN pos IS NULL THEN 4 WHEN strand = 1 THEN 16 ELSE 0 END AS flag, coalesce(name, '*') AS rname, coalesce(pos + 1, 0) AS pos, CASE WHEN pos IS NULL OR n > 1 THEN 0 ELSE mapq END AS mapq,
 CASE WHEN pos IS NULL THEN '*' ELSE len || 'M' END AS cigar, CASE WHEN pos IS NULL THEN '' ELSE 'AS:i:' || (len - nm) || '\tNM:i:' || nm END AS tags FROM r LEFT JOIN (m JOIN contigs USING (contig)) USING (read_id)""")
def sam_single(spark, d):
    a = V.alignments(spark, d).where("ln <= 2").selectExpr("frag AS read_id", "contig", "pos", "mapq", "flag div 16 % 2 AS strand", "concat(len - nm, '=', nm, 'X') AS cigar", "len - nm AS score")
    a = a.withColumn("cigar", F.regexp_replace("cigar", "=0X$", "="))
    r = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("read_id")).distinct().withColumn("seq", F.lit("ACGT")).withColumn("qual", F.lit("IIII"))
    return A.sam_single(r, a, V.contigs(spark, d)).select("qname", "flag", "rname", "pos", "mapq", "cigar", "tags")


@query("K04_decoy_rule", V.duck("aln", "contigs") + """ SELECT frag, ln, pk, CASE WHEN kind = 2 THEN name END AS decoy_name FROM (SELECT *, count(*) OVER (PARTITION BY frag) AS n FROM aln JOIN contigs USING (contig)) WHERE kind <> 2 OR n = 1""")
def decoy_rule(spark, d):
    a = V.alignments(spark, d).withColumn("read_id", F.col("frag"))
    return A.decoy_rule(a, V.contigs(spark, d)).select(*_KEY, "decoy_name")


@query("K06_sam_rna", _ALN + """ SELECT frag, ln, pk, n AS nh, CASE WHEN n = 1 THEN 50 WHEN n = 2 THEN 3 WHEN n IN (3, 4) THEN 1 ELSE 0 END AS mapq, 'AS:i:' || (len - nm) || '\tNM:i:' || nm || '\tNH:i:' || n AS tags FROM (SELECT *, count(*) OVER (PARTITION BY frag) AS n FROM aln)""")
def sam_rna(spark, d):
    a = V.alignments(spark, d).withColumn("read_id", F.col("frag")).withColumn("score", F.col("len") - F.col("nm"))
    return A.rna_rows(a).select(*_KEY, "nh", "mapq", "tags")


@query("G11_bam_scalar", _ALN + """, m AS (SELECT *, flag & 4 = 0 AS ok FROM aln) SELECT count(*) AS num_reads, count(*) FILTER (ok) AS num_mapped, count(*) FILTER (NOT ok) AS num_unmapped, count(*) FILTER (ok AND flag & 64 <> 0) AS num_mapped_1, count(*) FILTER (ok AND flag & 128 <> 0) AS num_mapped_2,
 count(*) FILTER (NOT ok AND flag & 64 <> 0) AS num_unmapped_1, count(*) FILTER (NOT ok AND flag & 128 <> 0) AS num_unmapped_2,
 """ + ", ".join(f"CAST(sum(len - length(replace(seq, '{b}', ''))) FILTER (ok) AS BIGINT) AS num_{b.lower()}" for b in "ACGTN") + """, count(*) FILTER (ok AND nm % 3 <> 0) AS num_indels, 2 * count(*) FILTER (ok AND nm % 3 <> 0) AS indel_bases,
 min(len) FILTER (ok) AS min_length, max(len) FILTER (ok) AS max_length, round(sum(len) FILTER (ok) / count(*), 6) AS length_per_read, min(mapq) FILTER (ok) AS min_mapq, max(mapq) FILTER (ok) AS max_mapq, round(sum(mapq) FILTER (ok) / count(*), 6) AS mapq_per_read, round(sum(abs(tlen)) FILTER (ok) / count(*), 6) AS insert_per_read FROM m""")
def bam_scalar(spark, d):
    out = A.scalar_stats(V.alignments(spark, d))
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("per_read") else c for c in out.columns])


@query("G12_per_strand", _ALN + " SELECT flag // 16 % 2 AS strand, count(*) AS mapped, count(*) FILTER (n = 1) AS unique_rows FROM (SELECT *, count(*) OVER (PARTITION BY qname, flag & 192) AS n FROM aln WHERE flag & 4 = 0) GROUP BY 1")
def per_strand(spark, d):
    return A.strand_counts(V.alignments(spark, d))


@query("G13_errors", _ALN + " SELECT e AS errors, count(frag) AS n FROM (SELECT unnest(range(0, 21)) AS e) LEFT JOIN (SELECT frag, least(nm, 20) AS x FROM aln WHERE flag & 4 = 0) ON x = e GROUP BY 1")
def errors(spark, d):
    return A.error_histogram(V.alignments(spark, d))


@query("G14_gc_bam", _ALN + " SELECT e AS gc, count(frag) AS n FROM (SELECT unnest(range(0, 101)) AS e) LEFT JOIN (SELECT frag, CAST(round(100.0 * (len - length(replace(replace(seq, 'C', ''), 'G', ''))) / len) AS BIGINT) AS x FROM aln WHERE flag & 4 = 0) ON x = e GROUP BY 1")
def gc_bam(spark, d):
    return A.gc_percent_histogram(V.alignments(spark, d))


@query("G15_mapq", _ALN + " SELECT e AS mapq, count(frag) AS n FROM (SELECT unnest(range(0, 256)) AS e) LEFT JOIN (SELECT frag, mapq AS x FROM aln WHERE flag & 4 = 0) ON x = e GROUP BY 1")
def mapq(spark, d):
    return A.mapq_histogram(V.alignments(spark, d))


_EVENTS = _ALN + """, ev AS (SELECT contig, p, sum(d) AS d FROM (SELECT contig, pos AS p, 1 AS d FROM aln UNION ALL SELECT contig, pos + len, -1 FROM aln) GROUP BY 1, 2),
 sg AS (SELECT contig, p AS s, lead(p) OVER (PARTITION BY contig ORDER BY p) AS e, CAST(sum(d) OVER (PARTITION BY contig ORDER BY p) AS BIGINT) AS depth FROM ev)"""


def _segments(spark, d):
    a = V.alignments(spark, d)
    return I.depth_segments(a.withColumn("end", F.col("pos") + F.col("len")), ["contig"], "pos", "end")


@query("G16_depth", _EVENTS + " SELECT contig, depth, CAST(sum(e - s) AS BIGINT) AS positions FROM sg WHERE depth > 0 GROUP BY 1, 2")
def depth(spark, d):
    return _segments(spark, d).groupBy("contig", "depth").agg(F.sum(F.col("seg_end") - F.col("seg_start")).alias("positions"))


@query("G17_coverage", _EVENTS + f", {V.DUCK['contigs']}" + """ SELECT contig, length, CAST(sum(depth * (e - s)) AS BIGINT) AS bases, CAST(sum(e - s) AS BIGINT) AS mapped, CAST(length - sum(e - s) AS BIGINT) AS unmapped, round(sum(depth * (e - s)) / length, 6) AS depth, round(sum(depth * (e - s)) / sum(e - s), 6) AS mapped_depth
 FROM sg JOIN contigs USING (contig) WHERE depth > 0 GROUP BY contig, length""")
def coverage(spark, d):
    out = I.coverage_summary(_segments(spark, d), V.contigs(spark, d).select("contig", "length"))
    return out.withColumn("depth", F.round("depth", 6)).withColumn("mapped_depth", F.round("mapped_depth", 6))


_HIST = _EVENTS + f", c AS (SELECT least(depth, 99) AS depth, sum(e - s) AS n FROM sg WHERE depth > 0 GROUP BY 1 UNION ALL SELECT 0, 5 * {V.CONTIG_LENGTH} - (SELECT sum(e - s) FROM sg WHERE depth > 0)), h AS (SELECT k AS depth, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest(range(0, 100)) AS k) LEFT JOIN c ON c.depth = k)"


@query("G18_coverage_histogram", _HIST + " SELECT * FROM h")
def coverage_histogram(spark, d):
    return I.coverage_histogram(_segments(spark, d), V.contigs(spark, d))


@query("G19_coverage_fraction", _HIST + " SELECT depth, round(100.0 * sum(n) OVER (ORDER BY depth DESC) / (SELECT sum(n) FROM h), 6) AS percent FROM h QUALIFY depth >= 1")
def coverage_fraction(spark, d):
    out = I.coverage_fraction(I.coverage_histogram(_segments(spark, d), V.contigs(spark, d)))
    return out.withColumn("percent", F.round("percent", 6))


@query("G20_chunks", _ALN + " SELECT contig, chunk, count(*) AS n FROM (SELECT contig, unnest(range(pos // 4000, (pos + len - 1) // 4000 + 1)) AS chunk FROM aln) GROUP BY 1, 2")
def chunks(spark, d):
    a = V.alignments(spark, d).withColumn("end", F.col("pos") + F.col("len") - 1)
    return I.chunk_counts(a, ["contig"], 4000, "pos", "end")


@query("G22_map_summary", _ALN + """, h AS (SELECT o_orderkey AS read_id, (SELECT count(*) FROM aln WHERE frag = o_orderkey) AS hits FROM orders)
 SELECT count(*) AS reads, count(*) FILTER (hits > 0) AS mapped, count(*) FILTER (hits = 0) AS unmapped, CAST(sum(hits) AS BIGINT) AS mappings, count(*) FILTER (hits > 1) AS multi, round(100.0 * count(*) FILTER (hits > 0) / count(*), 6) AS mapped_percent FROM h""")
def map_summary(spark, d):
    r = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("read_id"))
    out = A.mapping_summary(r, V.alignments(spark, d).withColumn("read_id", F.col("frag")))
    return out.withColumn("mapped_percent", F.round("mapped_percent", 6))


@query("G23_phase_summary", _ALN + " SELECT CASE WHEN nm = 0 THEN 'whole read' WHEN nm < 5 THEN 'first' ELSE 'second' END AS phase, count(DISTINCT frag) AS reads FROM aln GROUP BY 1")
def phase_summary(spark, d):
    phase = F.when(F.col("nm") == 0, "whole read").when(F.col("nm") < 5, "first").otherwise("second")
    return V.alignments(spark, d).groupBy(phase.alias("phase")).agg(F.count_distinct("frag").alias("reads"))


@query("K11_export", _ALN + """ SELECT qname, contig, CASE WHEN flag & 16 <> 0 THEN 1 ELSE 0 END AS strand, pos AS start, pos + len AS stop, flag, mapq, nm AS errors, CASE WHEN nm % 3 = 0 THEN 0 ELSE 1 END AS indels, CASE WHEN nm % 3 = 0 THEN 0 ELSE 2 END AS indel_len, tlen AS isize FROM aln""")
def export(spark, d):
    ops = C.parse("cigar")
    return V.alignments(spark, d).select("qname", "contig", F.when(A.has(16), 1).otherwise(0).cast("long").alias("strand"), F.col("pos").alias("start"), (F.col("pos") + F.col("len")).alias("stop"), "flag", "mapq", F.col("nm").alias("errors"), C.number(ops, "ID").alias("indels"), C.total(ops, "ID").alias("indel_len"), F.col("tlen").alias("isize"))


@query("S01_sort_position", _ALN + " SELECT contig, pos, qname, ln FROM aln ORDER BY contig, pos, qname")
def sort_position(spark, d):
    return A.sort_by_position(V.alignments(spark, d)).select("contig", "pos", "qname", "ln")


@query("S02_sort_name", _ALN + " SELECT qname, flag, pos FROM aln ORDER BY qname, flag, pos")
def sort_name(spark, d):
    return A.sort_by_name(V.alignments(spark, d)).select("qname", "flag", "pos")


_IV = V.duck("intervals")


@query("J04_interval_merge", _IV + """, o AS (SELECT *, max(e) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM intervals),
 g AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m + 40 THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM o) SELECT contig, min(s) AS start, max(e) AS "end", count(*) AS n FROM g GROUP BY contig, i""")
def interval_merge(spark, d):
    return I.merge_intervals(V.intervals(spark, d), ["contig"], distance=40)


@query("J03_contained_anti", _IV + """, big AS (SELECT contig, min(s) AS rs, min(s) + 600000 AS re FROM intervals GROUP BY 1) SELECT id FROM intervals i WHERE NOT EXISTS (SELECT 1 FROM big b WHERE b.contig = i.contig AND i.s >= rs AND i.e <= re)""")
def contained_anti(spark, d):
    iv = V.intervals(spark, d)
    big = iv.groupBy("contig").agg(F.min("start").alias("r_start")).withColumn("r_end", F.col("r_start") + 600_000)
    return I.containment_join(iv, big, ["contig"], bucket=100_000, how="left_anti").select("id")


@query("J09_last_overlap", _IV + """, q AS (SELECT id, contig, s, e FROM intervals), t AS (SELECT contig, s AS rs, e + 3000 AS re FROM intervals)
 SELECT id, rs AS r_start, re AS r_end FROM (SELECT id, rs, re, row_number() OVER (PARTITION BY id ORDER BY rs DESC, re DESC) AS k FROM q JOIN t USING (contig) WHERE s <= re AND e >= rs) WHERE k = 1""")
def last_overlap(spark, d):
    iv = V.intervals(spark, d)
    targets = iv.select("contig", F.col("start").alias("r_start"), (F.col("end") + 3000).alias("r_end"))
    return I.last_overlap(iv, targets, ["contig"], "id", bucket=4096).select("id", "r_start", "r_end")


_HALF = "len // 2"


@query("C03_cigar_algebra", _ALN + """ SELECT frag, ln, pk, cigar AS rendered, CASE WHEN nm % 3 = 2 THEN len ELSE len END AS on_read, CASE WHEN nm % 3 = 1 THEN len + 2 WHEN nm % 3 = 2 THEN len - 2 ELSE len END AS on_reference, CASE WHEN nm % 3 = 0 THEN 0 ELSE 1 END AS indels,
 CASE WHEN nm % 3 = 0 THEN cigar WHEN nm % 3 = 1 THEN (len - len // 2) || 'M2D' || (len // 2) || 'M' ELSE (len - len // 2 - 2) || 'M2I' || (len // 2) || 'M' END AS reversed,
 CASE WHEN nm % 3 = 0 THEN (len - 5) || 'M' WHEN nm % 3 = 1 THEN (len // 2 - 5) || 'M2D' || (len - len // 2) || 'M' ELSE (len // 2 - 5) || 'M2I' || (len - len // 2 - 2) || 'M' END AS trimmed, true AS valid FROM aln""")
def cigar_algebra(spark, d):
    ops = C.parse("cigar")
    return V.alignments(spark, d).select(*_KEY, C.render(ops).alias("rendered"), C.read_length(ops).alias("on_read"), C.reference_length(ops).alias("on_reference"), C.number(ops, "ID").alias("indels"), C.render(C.reverse(ops)).alias("reversed"), C.render(C.trim_left(ops, 5)).alias("trimmed"), C.is_valid(ops, F.col("len")).alias("valid"))


@query("L01_indel_regions", _ALN + " SELECT frag, ln, pk, contig, CASE WHEN nm % 3 = 1 THEN pos + 1 + len // 2 ELSE pos + len // 2 END AS start, CASE WHEN nm % 3 = 1 THEN pos + 2 + len // 2 ELSE pos + 1 + len // 2 END AS \"end\" FROM aln WHERE nm % 3 <> 0")
def indel_regions(spark, d):
    a = V.alignments(spark, d).withColumn("read_id", F.struct(*_KEY))
    return realign.indel_regions(a).select("read_id.*", "contig", "start", "end")


@query("G27_indel_region_merge", _ALN + """, i AS (SELECT contig, CASE WHEN nm % 3 = 1 THEN pos + 1 + len // 2 ELSE pos + len // 2 END AS s, CASE WHEN nm % 3 = 1 THEN pos + 2 + len // 2 ELSE pos + 1 + len // 2 END AS e FROM aln WHERE nm % 3 <> 0),
 o AS (SELECT *, max(e) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i), g AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o)
 SELECT contig, min(s) AS start, max(e) AS "end", count(*) AS n FROM g GROUP BY contig, k""")
def indel_region_merge(spark, d):
    return realign.merged_regions(V.alignments(spark, d).withColumn("read_id", F.col("frag")))


@query("L05_haplotypes", _ALN + """, x AS (SELECT DISTINCT contig, pos // 1000 AS region_start, 2 AS n, CASE WHEN nm % 3 = 1 THEN 'D' ELSE 'I' END AS op, pos + len // 2 AS ref_pos FROM aln WHERE nm % 3 <> 0)
 SELECT contig, region_start, n, op, ref_pos, haplotypes FROM (SELECT *, count(*) OVER (PARTITION BY contig, region_start) AS haplotypes FROM x) WHERE haplotypes >= 2""")
def haplotypes(spark, d):
    a = V.alignments(spark, d).withColumn("region_start", F.floor(F.col("pos") / 1000))
    return realign.haplotypes(a)


@query("L12_previous_region", _ALN + """, x AS (SELECT DISTINCT contig, pos // 1000 AS region_start, 2 AS n, CASE WHEN nm % 3 = 1 THEN 'D' ELSE 'I' END AS op, pos + len // 2 AS ref_pos FROM aln WHERE nm % 3 <> 0),
 p AS (SELECT *, lag(region_start * 1000 + 700) OVER (PARTITION BY contig ORDER BY region_start) AS e FROM (SELECT DISTINCT contig, region_start FROM x)),
 y AS (SELECT x.* FROM x JOIN p USING (contig, region_start) WHERE e IS NULL OR ref_pos + 1 > e + 700)
 SELECT contig, region_start, n, op, ref_pos, haplotypes FROM (SELECT *, count(*) OVER (PARTITION BY contig, region_start) AS haplotypes FROM y) WHERE haplotypes >= 2""")
def previous_region(spark, d):
    """Regions of 1,000 bases that end 1,400 bases after their begin, so indels may lie in the one before."""
    a = V.alignments(spark, d).withColumn("region_start", F.floor(F.col("pos") / 1000))
    seen = a.where("nm % 3 <> 0").select("contig", F.col("region_start").alias("start")).distinct().withColumn("end", F.col("start") * 1000 + 1400)
    return realign.haplotypes(a, realign.previous_ends(seen))
