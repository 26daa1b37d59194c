"""Queries on mapping, ranking, pairing and splicing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import scores
from ..functions import sequence as S
from ..operators import extension, flow, inexact, kernels, lookup
from ..operators import mapping as M
from ..operators import pairing as P
from ..operators import splice
from ..operators.settle import settled
from . import views as V

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_GENOME = V.duck("genome", "probes") + """,
k AS (SELECT contig, s + o AS pos, substr(piece, CAST(o + 1 AS BIGINT), 100) AS win FROM (SELECT contig, s, piece, unnest(range(0, least(256, length(piece) - 17))) AS o
  FROM (SELECT contig, s, substr(bases, CAST(s + 1 AS BIGINT), 355) AS piece FROM (SELECT contig, bases, unnest(range(0, length(bases) - 17, 256)) AS s FROM genome)))),
i AS (SELECT contig, pos, win, replace(substr(win, 1, 18), 'N', 'A') AS w FROM k WHERE win NOT LIKE 'N%'), idx AS (SELECT * FROM i WHERE w IN (SELECT w FROM i GROUP BY 1 HAVING count(*) < 2000)),
sides AS (SELECT read_id, 0 AS strand, seq AS s FROM probes UNION ALL SELECT read_id, 1, reverse(translate(seq, 'ACGTN', 'TGCAN')) FROM probes),
sd AS (SELECT read_id, strand, s, p AS read_pos, replace(substr(s, CAST(p + 1 AS BIGINT), 18), 'N', 'A') AS w
  FROM (SELECT read_id, strand, s, unnest(list_concat(range(0, length(s) - 18, 9), CASE WHEN (length(s) - 18) % 9 <> 0 THEN [length(s) - 18] ELSE [] END)) AS p FROM sides WHERE length(s) > 18))"""


def _beyond(probes) -> int:
    """Bases of the longest read besides a k-mer."""
    return max(0, M.longest_read(probes) - M.K)


@query("A04_index_build", _GENOME + " SELECT contig, count(*) AS kmers, count(DISTINCT w) AS distinct_kmers FROM idx GROUP BY 1")
def index_build(spark, d):
    return V.index(spark, d).groupBy("contig").agg(F.count("*").alias("kmers"), F.count_distinct("kmer").alias("distinct_kmers"))


@query("G30_base_counts", V.duck("genome") + " SELECT " + ", ".join(f"CAST(sum(length(bases) - length(replace(bases, '{b}', ''))) AS BIGINT) AS num_{b.lower()}" for b in "ACGTN") + " FROM genome")
def base_counts(spark, d):
    return M.base_counts(V.reference(spark, d))


@query("SC10_windows", V.duck("genome") + f" SELECT contig, CAST(s AS BIGINT) AS start, substr(bases, CAST(s + 1 AS BIGINT), {V.WIDTH}) AS bases FROM (SELECT contig, bases, unnest(range(0, length(bases), {V.WIDTH})) AS s FROM genome)")
def reference_windows(spark, d):
    return V.reference(spark, d)


@query("J17_reference_fetch", V.duck("genome") + ", q AS (SELECT contig, bases, CAST(unnest(range(0, length(bases), 97)) AS BIGINT) AS s FROM genome) SELECT CAST(contig * 100000 + s // 97 AS BIGINT) AS id, substr(bases, s + 1, 300) AS bases FROM q")
def reference_fetch(spark, d):
    """Spans of 300 bases from every 97th base of each contig on."""
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("bases") - 1) / 97).cast("int"))).alias("i")
    g = V.genome(spark, d).select("contig", at)
    spans = g.select((F.col("contig") * 100_000 + F.col("i")).alias("id"), "contig", (F.col("i") * 97).cast("long").alias("start")).withColumn("end", F.col("start") + 300)
    return M.fetch(spans, V.reference(spark, d), ["id"], V.WIDTH).select("id", "bases")


@query("J01_seed_lookup", _GENOME + """ SELECT read_id, strand, contig, read_pos, pos FROM sd JOIN idx USING (w) QUALIFY count(*) OVER (PARTITION BY read_id, strand, read_pos) < 2000""")
def seed_lookup(spark, d):
    return lookup.seed_places(V.sequence_probes(spark, d), lookup.dealt(V.genome(spark, d)))


@query("A06_exact_reads", _GENOME + " SELECT read_id, strand, contig, pos, cigar FROM (SELECT read_id, strand, contig, pos, length(s) || '=' AS cigar, count(*) OVER (PARTITION BY read_id) AS n FROM sides JOIN idx ON w = replace(substr(s, 1, 18), 'N', 'A') AND substr(win, 1, length(s)) = s WHERE length(s) >= 18) WHERE n <= 500")
def exact_reads(spark, d):
    probes = V.sequence_probes(spark, d)
    reference = lookup.dealt(V.genome(spark, d), right=_beyond(probes))
    return lookup.exact_places(probes, reference).select("read_id", "strand", "contig", "pos", "cigar")


@query("J02_longest_match", _GENOME + """,
 h AS (SELECT read_id, strand, contig, read_pos, pos, substr(s, CAST(read_pos + 1 AS BIGINT)) AS rest, substr(win, 1, CAST(length(s) - read_pos AS BIGINT)) AS ref FROM sd JOIN idx USING (w)),
 m AS (SELECT *, coalesce(list_position(list_transform(range(1, least(length(rest), length(ref)) + 1), lambda x: substr(rest, x, 1) <> substr(ref, x, 1)), true) - 1, least(length(rest), length(ref))) AS match_len FROM (SELECT * FROM h QUALIFY count(*) OVER (PARTITION BY read_id, strand, read_pos) < 2000))
 SELECT read_id, strand, contig, read_pos, pos, match_len FROM m QUALIFY match_len = max(match_len) OVER (PARTITION BY read_id, strand, read_pos)""")
def longest_match(spark, d):
    probes = V.sequence_probes(spark, d)
    return lookup.longest_places(probes, lookup.dealt(V.genome(spark, d), right=_beyond(probes)))


@query("Q_map_reads")
def map_reads(spark, d):
    """The whole DNA flow: exact hits, extended seeds, gaps, second look-up, ranking."""
    return flow.map_reads(V.probes(spark, d), V.reference(spark, d), V.index(spark, d), width=V.WIDTH)


@query("Q_map_pairs")
def map_pairs(spark, d):
    """The paired flow: every read with the reverse complement of the third one after it in its document, if there is one."""
    probes = settled(V.probes(spark, d).select("read_id", "seq"))
    later = probes.select((F.col("read_id") - 3).alias("fragment"), F.lit(2).alias("mate"), S.revcomp("seq").alias("seq"))
    fragments = probes.select(F.col("read_id").alias("fragment"), F.lit(1).alias("mate"), "seq").unionByName(later.join(probes.select(F.col("read_id").alias("fragment")), "fragment", "left_semi"))
    return flow.map_pairs(fragments, V.reference(spark, d), V.index(spark, d), width=V.WIDTH)


@query("A07_seed_extension")
def seed_extension(spark, d):
    """Regions of all probes: extended seeds with spans, errors and CIGARs."""
    return extension.extended_seeds(V.probes(spark, d), settled(V.index(spark, d)), V.reference(spark, d), width=V.WIDTH)


@query("A10_second_look_up")
def second_look_up(spark, d):
    """Chains of seeds of the probes that have no exact place."""
    probes, genome = V.sequence_probes(spark, d), V.genome(spark, d)
    exact = lookup.exact_places(probes, lookup.dealt(genome, right=_beyond(probes)))
    rest = settled(probes.join(exact.select("read_id").distinct(), "read_id", "left_anti"))
    chained = extension.chained_regions(rest, None, hits=lookup.seed_places(rest, lookup.dealt(genome)))
    return chained.select("read_id", "strand", "contig", "length", "read_area", F.size("seeds").alias("n_seeds"), F.col("seeds")[0]["g_start"].alias("start"), F.element_at("seeds", -1)["g_end"].alias("end"))


_GENOME_12 = _GENOME + """,
k12 AS (SELECT contig, s + o AS pos, substr(piece, CAST(o + 1 AS BIGINT), 12) AS word, substr(piece, CAST(o + 1 AS BIGINT), 24) AS win FROM (SELECT contig, s, piece, unnest(range(0, least(256, length(piece) - 11))) AS o
  FROM (SELECT contig, s, substr(bases, CAST(s + 1 AS BIGINT), 279) AS piece FROM (SELECT contig, bases, unnest(range(0, length(bases) - 11, 256)) AS s FROM genome)))),
i12 AS (SELECT contig, pos, replace(word, 'N', 'A') AS w FROM k12 WHERE word NOT LIKE 'N%' QUALIFY count(*) OVER (PARTITION BY replace(word, 'N', 'A')) < 2000)"""


@query("A15_one_error", _GENOME + """,
 c AS (SELECT DISTINCT read_id, strand, s, contig, start FROM (SELECT read_id, strand, s, contig, pos AS start FROM sides JOIN idx ON w = replace(substr(s, 1, 18), 'N', 'A') WHERE length(s) >= 36
   UNION ALL SELECT read_id, strand, s, contig, pos - length(s) + 18 FROM sides JOIN idx ON w = replace(right(s, 18), 'N', 'A') WHERE length(s) >= 36)),
 h AS (SELECT read_id, strand, s, c.contig, start, substr(win, 1, length(s)) AS ref FROM c JOIN k ON k.contig = c.contig AND k.pos = c.start WHERE length(win) >= length(s))
 SELECT read_id, strand, contig, start AS pos, CAST(hamming(s, ref) AS BIGINT) AS mism FROM h WHERE hamming(s, ref) <= 1""")
def one_error(spark, d):
    """All places of whole reads with at most one mismatch."""
    probes = V.sequence_probes(spark, d)
    more = _beyond(probes)
    return lookup.one_error_places(inexact.whole_reads(probes), lookup.dealt(V.genome(spark, d), left=more, right=more), ["read_id", "strand"]).drop("cigar")


@query("A15_retry_seeds", _GENOME_12 + """,
 long AS (SELECT read_id, strand, s FROM sides WHERE length(s) >= 24),
 p AS (SELECT read_id, strand, unnest(list_distinct(list_concat(range(0, length(s) - 23, 12), [length(s) - 24]))) AS read_pos, s FROM long),
 q AS (SELECT read_id, strand, read_pos, substr(s, CAST(read_pos + 1 AS BIGINT), 24) AS s FROM p),
 c AS (SELECT DISTINCT read_id, strand, read_pos, s, contig, start FROM (SELECT read_id, strand, read_pos, s, contig, pos AS start FROM q JOIN i12 ON w = replace(substr(s, 1, 12), 'N', 'A')
   UNION ALL SELECT read_id, strand, read_pos, s, contig, pos - 12 FROM q JOIN i12 ON w = replace(right(s, 12), 'N', 'A'))),
 h AS (SELECT read_id, strand, read_pos, s, c.contig, start, win FROM c JOIN k12 ON k12.contig = c.contig AND k12.pos = c.start WHERE length(win) = 24)
 SELECT read_id, strand, read_pos, contig, start AS pos, CAST(hamming(s, win) AS BIGINT) AS mism FROM h WHERE hamming(s, win) <= 1""")
def retry_seeds(spark, d):
    """Places of seeds of 24 bases with at most one mismatch."""
    reference = lookup.dealt(V.genome(spark, d), 12, left=12, right=12)
    return lookup.one_error_places(inexact.retry_pieces(V.sequence_probes(spark, d)), reference, ["read_id", "strand", "read_pos"]).drop("cigar")


@query("A12_smith_waterman")
def smith_waterman(spark, d):
    p = V.probes(spark, d)
    return p.select("read_id", kernels.smith_waterman()(F.substring("seq", 5, 40), F.col("seq")).alias("a")).select("read_id", "a.*")


@query("A08_mini_align")
def mini_align(spark, d):
    p = V.probes(spark, d)
    return p.select("read_id", kernels.extend_right(F.expr("substring(seq, 2, 30)"), F.col("seq")).alias("a")).select("read_id", "a.*")


def _seeds(spark, d):
    a = V.alignments(spark, d)
    return a.selectExpr("frag AS read_id", "flag div 16 % 2 AS strand", "contig", "ln * 10 AS read_start", "ln * 10 + 17 AS read_end", "pos * 512 + ln * 64 + len - 51 AS g_start", "pos * 512 + ln * 64 + len - 34 AS g_end", "100L AS length", "nm AS mism", "nm % 2 AS open_gaps", "nm % 3 AS ext_gaps", "pk")


_SEEDS = V.duck("aln") + ", sd AS (SELECT frag AS read_id, flag // 16 % 2 AS strand, contig, ln * 10 AS read_start, ln * 10 + 17 AS read_end, pos * 512 + ln * 64 + len - 51 AS g_start, pos * 512 + ln * 64 + len - 34 AS g_end, 100 AS length, nm AS mism, nm % 2 AS open_gaps, nm % 3 AS ext_gaps, pk FROM aln)"


@query("J05_diagonal_merge", _SEEDS + """, f AS (SELECT *, CASE WHEN read_start - lag(read_end) OVER w <= length AND g_start - lag(g_end) OVER w <= length AND abs(read_start - lag(read_end) OVER w - (g_start - lag(g_end) OVER w)) < 200 THEN 0 ELSE 1 END AS f FROM sd WINDOW w AS (PARTITION BY read_id, strand, contig ORDER BY g_start, read_start)),
 g AS (SELECT *, sum(f) OVER (PARTITION BY read_id, strand, contig ORDER BY g_start, read_start ROWS UNBOUNDED PRECEDING) AS k FROM f)
 SELECT read_id, strand, contig, min(g_start) AS start, max(g_end) AS "end", min(read_start) AS read_start, max(read_end) AS read_end, CAST(sum(read_end - read_start + 1) AS BIGINT) AS read_area, count(*) AS n_seeds FROM g GROUP BY read_id, strand, contig, k""")
def diagonal_merge(spark, d):
    return M.diagonal_regions(_seeds(spark, d))


@query("F09_cal_validity", _SEEDS + " SELECT read_id, pk FROM (SELECT *, 20 + pk % 40 AS read_area FROM sd) WHERE read_area >= length // 3 AND open_gaps < 0.05 * length AND mism < 0.09 * length")
def cal_validity(spark, d):
    return M.valid_regions(_seeds(spark, d).withColumn("read_area", 20 + F.col("pk") % 40)).select("read_id", "pk")


@query("F12_gap_limit", _SEEDS + """, g AS (SELECT *, greatest(read_start - lag(read_end) OVER w - 1, g_start - lag(g_end) OVER w - 1) AS gap FROM sd WINDOW w AS (PARTITION BY read_id, contig ORDER BY g_start))
 SELECT read_id, contig, coalesce(max(gap), 0) > 2000 OR min(read_start) > 2000 OR max(length) - 1 - max(read_end) > 2000 AS invalid FROM g GROUP BY 1, 2""")
def gap_limit(spark, d):
    return M.gap_limit(_seeds(spark, d), ["read_id", "contig"])


@query("F13_seed_quality", V.duck("aln") + " SELECT frag, ln, pk, CASE WHEN len // 2 > 10 THEN len // 2 ELSE 0 END > 20 AS good FROM aln")
def seed_quality(spark, d):
    a = V.alignments(spark, d).withColumn("cigar", F.expr("concat(len div 2, '=', '3X', '8=')"))
    return a.select("frag", "ln", "pk", M.good_seed().alias("good"))


@query("F15_incoherent_cals", _SEEDS + """, b AS (SELECT *, ln_bad AS bad FROM (SELECT *, coalesce(read_start <= lag(read_end) OVER w OR g_start <= lag(g_end) OVER w OR g_start - lag(g_end) OVER w > 200, false) AS ln_bad FROM sd WINDOW w AS (PARTITION BY read_id, strand, contig ORDER BY g_start, pk))),
 ok AS (SELECT read_id, strand, contig, min(g_start) AS start FROM b GROUP BY 1, 2, 3 HAVING NOT bool_or(bad)) SELECT read_id, strand, contig, start FROM ok QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY start, strand, contig) <= 100""")
def incoherent(spark, d):
    s = _seeds(spark, d).withColumn("cal", F.lit(1)).dropDuplicates(["read_id", "strand", "contig", "g_start", "pk"])
    cals = s.groupBy("read_id", "strand", "contig", "cal").agg(F.min("g_start").alias("start"))
    return M.coherent_regions(cals, s).select("read_id", "strand", "contig", "start")


@query("F16_multi_hit_cut", _SEEDS + " SELECT g_start, count(*) AS n FROM sd GROUP BY 1 HAVING count(*) < 3")
def multi_hit(spark, d):
    return _seeds(spark, d).groupBy("g_start").agg(F.count("*").alias("n")).where("n < 3")


@query("W01_cal_score", _SEEDS + """, c AS (SELECT *, sum(mism) OVER w AS m, sum(open_gaps) OVER w AS o, sum(ext_gaps) OVER w AS e FROM sd WINDOW w AS (PARTITION BY read_id, strand, contig ORDER BY g_start, read_start ROWS UNBOUNDED PRECEDING))
 SELECT read_id, strand, contig, CAST(sum(read_end - read_start + 1 - (m + 2 * o + e)) AS BIGINT) AS read_area, CAST(sum(mism) AS BIGINT) AS mism, CAST(sum(open_gaps) AS BIGINT) AS open_gaps, CAST(sum(ext_gaps) AS BIGINT) AS ext_gaps,
 CAST(sum(read_end - read_start + 1 - (m + 2 * o + e)) - 5 * sum(mism) - 7 * sum(open_gaps) - 2 * sum(ext_gaps) AS BIGINT) AS score FROM c GROUP BY 1, 2, 3""")
def cal_score(spark, d):
    return M.cal_scores(_seeds(spark, d), ["read_id", "strand", "contig"])


@query("W02_cigar_score", V.duck("aln") + " SELECT frag, ln, pk, ((len - nm) * 5.0 - nm * 4.0 - CASE WHEN nm % 3 = 0 THEN 0 ELSE 10.5 END) / 5 AS score FROM aln")
def cigar_score(spark, d):
    text = F.expr("concat(len - nm, '=', nm, 'X', if(nm % 3 = 0, '', '2I'))")
    return V.alignments(spark, d).select("frag", "ln", "pk", scores.cigar_score(C.parse(text)).alias("score"))


_RANK = V.duck("cals") + """, r AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY score DESC, contig, start, strand, id, mate) AS rank, max(score) OVER (PARTITION BY read_id) AS best FROM cals),
 s AS (SELECT *, max(CASE WHEN rank = 2 THEN score END) OVER (PARTITION BY read_id) AS second, 1 + sum(CASE WHEN rank > 1 AND abs(best - score) < 7 THEN 1 ELSE 0 END) OVER (PARTITION BY read_id) AS h, max(CASE WHEN rank = 1 THEN read_area END) OVER (PARTITION BY read_id) AS a FROM r),
 t AS (SELECT *, coalesce(second, 18) AS s2, 3.9120 / ln(CAST(a AS DOUBLE)) * pow(1 - (a - best) / CAST(5 AS DOUBLE) / a, 3) AS t FROM s),
 q AS (SELECT *, CAST(trunc(6.02 * (best - s2) * t + 0.499) AS BIGINT) - CASE WHEN h > 1 THEN CAST(trunc(4.343 * ln(CAST(h AS DOUBLE)) + 0.499) AS BIGINT) ELSE 0 END AS q FROM t),
 m AS (SELECT *, CASE WHEN s2 >= best THEN 0 ELSE greatest(0, least(60, q)) END AS mapq FROM q)"""


def _ranked(spark, d):
    return M.with_mapq(M.rank_regions(V.cals(spark, d)))


@query("W03_rank_cals", _RANK + " SELECT read_id, score, count(*) AS n, CAST(max(h) AS BIGINT) AS num_hits, max(best) AS best, max(second) AS second FROM m GROUP BY 1, 2")
def rank_cals(spark, d):
    return M.rank_regions(V.cals(spark, d)).groupBy("read_id", "score").agg(F.count("*").alias("n"), F.max("num_hits").alias("num_hits"), F.max("best").alias("best"), F.max("second").alias("second"))


@query("W04_mapq", V.duck("aln") + """, t AS (SELECT frag, ln, pk, len AS a, len - nm AS s1, len - nm - pk % 30 AS s2, 1 + pk % 3 AS h, 3.9120 / ln(CAST(len AS DOUBLE)) * pow(1 - nm / CAST(5 AS DOUBLE) / len, 3) AS t FROM aln)
 SELECT frag, ln, pk, CASE WHEN s2 >= s1 THEN 0 ELSE greatest(0, least(60, CAST(trunc(6.02 * (s1 - s2) * t + 0.499) AS BIGINT) - CASE WHEN h > 1 THEN CAST(trunc(4.343 * ln(CAST(h AS DOUBLE)) + 0.499) AS BIGINT) ELSE 0 END)) END AS mapq FROM t""")
def mapq(spark, d):
    a = V.alignments(spark, d)
    s1 = F.col("len") - F.col("nm")
    return a.select("frag", "ln", "pk", scores.mapq(F.col("len"), s1, s1 - F.col("pk") % 30, 1 + F.col("pk") % 3).alias("mapq"))


@query("W05_select_best", V.duck("cals") + """, c AS (SELECT DISTINCT read_id, contig, start, strand, score, length, invalid, start % 3 AS mapq FROM cals), r AS (SELECT *, row_number() OVER w AS rank, max(score) OVER (PARTITION BY read_id) AS best FROM c WINDOW w AS (PARTITION BY read_id ORDER BY score DESC, contig, start, strand)),
 b AS (SELECT *, max(CASE WHEN invalid AND (rank = 1 OR best - score < 2 * length) THEN 1 ELSE 0 END) OVER (PARTITION BY read_id) AS bad, 1 + sum(CASE WHEN rank > 1 AND abs(best - score) < 7 THEN 1 ELSE 0 END) OVER (PARTITION BY read_id) AS h FROM r)
 SELECT read_id, contig, start, strand FROM b WHERE bad = 0 AND rank <= CASE WHEN mapq > 0 THEN 1 ELSE h END""")
def select_best(spark, d):
    c = V.cals(spark, d).select("read_id", "contig", "start", "strand", "score", "length", "read_area", "invalid").distinct()
    ranked = M.rank_regions(c).withColumn("mapq", F.col("start") % 3)
    return M.select_best(ranked).select("read_id", "contig", "start", "strand")


@query("F10_cal_max_score", V.duck("aln") + """, s AS (SELECT frag, ln, pk, ((len - nm) * 5.0 - nm * 4.0) / 5 AS score, nm < 0.09 * len AS ok FROM aln) SELECT frag, ln, pk, score AS cigar_score FROM s WHERE ok QUALIFY score >= max(score) OVER (PARTITION BY frag)""")
def cal_max_score(spark, d):
    a = V.alignments(spark, d).withColumn("cigar", F.expr("if(nm = 0, concat(len, '='), concat(len - nm, '=', nm, 'X'))")).withColumn("length", F.col("len")).withColumn("read_id", F.col("frag"))
    return M.max_score_regions(a).select("frag", "ln", "pk", "cigar_score")


@query("F11_cal_area_filters", V.duck("cals") + " SELECT read_id, id, mate FROM (SELECT * FROM cals QUALIFY read_area = max(read_area) OVER (PARTITION BY read_id)) QUALIFY nm = min(nm) OVER (PARTITION BY read_id)")
def area_filters(spark, d):
    c = V.cals(spark, d).withColumn("mism", F.col("nm"))
    return M.area_filters(c, largest=True, fewest_mismatches=True).select("read_id", "id", "mate")


@query("F18_min_score", V.duck("aln") + " SELECT frag, ln, pk FROM aln WHERE trunc(greatest((len - nm) * 5.0 - nm * 4.0, 0) * 100 / (len * 5)) > 90")
def min_score(spark, d):
    a = V.alignments(spark, d).withColumn("score", scores.rna_score("len", "nm", F.lit(0), F.lit(0)))
    return a.where("score > 90").select("frag", "ln", "pk")


@query("W10_rna_cal_rank", V.duck("cals") + """, c AS (SELECT *, (length - nm * 7) * 100.0 / length AS coverage, id * 10 + mate AS arrival FROM cals) SELECT read_id, id, mate, round(coverage, 6) AS coverage FROM c QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY coverage DESC, arrival) <= 5 AND (row_number() OVER (PARTITION BY read_id ORDER BY coverage DESC, arrival) = 1 OR coverage >= 60)""")
def rna_rank(spark, d):
    c = V.cals(spark, d).withColumn("covered", F.col("length") - F.col("nm") * 7).withColumn("arrival", F.col("id") * 10 + F.col("mate"))
    return M.rna_rank(c, least=60).select("read_id", "id", "mate", F.round("coverage", 6).alias("coverage"))


@query("W11_rna_score", V.duck("aln") + """ SELECT frag, ln, pk, CAST(trunc(greatest((len - nm - 2) * 5.0 + nm * -4.0 - 0.5 - 10, 0) * 100 / (len * 5)) AS BIGINT) AS score FROM aln""")
def rna_score(spark, d):
    return V.alignments(spark, d).select("frag", "ln", "pk", scores.rna_score("len", F.col("nm") + 2, F.lit(1), F.lit(2)).alias("score"))


@query("W12_cigar_code_score", V.duck("aln") + " SELECT frag, ln, pk, round(((len - nm) - 0.4 * (nm + 2)) * 100 / len, 6) AS score FROM aln")
def cigar_code_score(spark, d):
    return V.alignments(spark, d).select("frag", "ln", "pk", F.round(scores.cigar_code_score("len", "len", F.col("nm") + 2, F.lit(2)), 6).alias("score"))


def _arrivals(spark, d):
    return V.alignments(spark, d).selectExpr("frag AS read_id", "mapq AS map_quality", "pk * 10 + ln AS arrival")


_ARR = V.duck("aln") + ", x AS (SELECT frag AS read_id, mapq AS map_quality, pk * 10 + ln AS arrival FROM aln) "


@query("W06_report_best", _ARR + "SELECT * FROM x QUALIFY rank() OVER (PARTITION BY read_id ORDER BY map_quality DESC) = 1")
def report_best(spark, d):
    return P.report(_arrivals(spark, d)).select("read_id", "map_quality", "arrival")


@query("W07_report_n_best", _ARR + "SELECT read_id, map_quality, arrival, row_number() OVER (PARTITION BY read_id ORDER BY map_quality DESC, arrival) = 1 AS \"primary\" FROM x QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY map_quality DESC, arrival) <= 3")
def report_n_best(spark, d):
    return P.report(_arrivals(spark, d), n_best=3)


@query("W08_report_n_hits", _ARR + "SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY arrival) <= 2")
def report_n_hits(spark, d):
    return P.report(_arrivals(spark, d), n_hits=2).select("read_id", "map_quality", "arrival")


@query("W09_report_mode", _ARR + "SELECT (SELECT count(*) FROM (SELECT 1 FROM x QUALIFY rank() OVER (PARTITION BY read_id ORDER BY map_quality DESC) = 1)) AS by_precedence, (SELECT count(*) FROM x) AS every_row")
def report_mode(spark, d):
    a = P.report(_arrivals(spark, d), best=True, n_best=3, n_hits=1).agg(F.count("*").alias("by_precedence"))
    return a.join(P.report(_arrivals(spark, d), every=True).agg(F.count("*").alias("every_row")))


def _frags(spark, d):
    return V.alignments(spark, d).selectExpr("frag AS fragment", "2 - ln % 2 AS mate", "contig % 2 AS contig", "pk * 10 + ln AS id", "pos % 3000 AS pos", "pos % 3000 AS start", "pos % 3000 + len AS end", "len", "mapq", "len AS read_area", "flag div 16 % 2 AS strand", "len AS length").distinct()


_FR = V.duck("aln") + """, fr AS (SELECT DISTINCT frag AS fragment, 2 - ln % 2 AS mate, contig % 2 AS contig, pk * 10 + ln AS id, pos % 3000 AS pos, len, mapq, flag // 16 % 2 AS strand FROM aln),
 pr AS (SELECT a.fragment, a.contig, a.id AS id1, b.id AS id2, a.pos AS pos1, b.pos AS pos2, a.len AS len1, b.len AS len2, a.mapq AS mapq1, b.mapq AS mapq2, CASE WHEN b.pos > a.pos + a.len THEN b.pos + b.len - a.pos + 1 ELSE a.pos + a.len - b.pos + 1 END AS dist,
  CASE WHEN b.pos > a.pos THEN b.pos + b.len - a.pos ELSE a.pos + a.len - b.pos END AS adist FROM fr a JOIN fr b USING (fragment, contig) WHERE a.mate = 1 AND b.mate = 2)"""


@query("J06_mate_pairs", _FR + " SELECT fragment, contig, id1, id2, dist AS distance FROM pr WHERE dist BETWEEN 200 AND 800")
def mate_pairs(spark, d):
    return P.valid_pairs(_frags(spark, d)).select("fragment", "contig", "id1", "id2", "distance")


@query("J07_pair_filter", _FR + """, m AS (SELECT fragment, 1 AS mate, id1 AS id FROM pr WHERE dist BETWEEN 200 AND 800 UNION SELECT fragment, 2, id2 FROM pr WHERE dist BETWEEN 200 AND 800)
 SELECT fragment, mate, id FROM fr WHERE (fragment, mate, id) IN (SELECT (fragment, mate, id) FROM m) OR fragment NOT IN (SELECT fragment FROM m)""")
def pair_filter(spark, d):
    return P.filter_by_pairs(_frags(spark, d)).select("fragment", "mate", "id")


@query("P01_insert_size", _FR + """, one AS (SELECT * FROM fr QUALIFY count(*) OVER (PARTITION BY fragment, mate) = 1), ds AS (SELECT p.dist AS x FROM pr p JOIN one a ON a.fragment = p.fragment AND a.id = p.id1 AND a.mate = 1 JOIN one b ON b.fragment = p.fragment AND b.id = p.id2 AND b.mate = 2 WHERE dist < 10000),
 md AS (SELECT list_sort(list(x)) AS l FROM ds) SELECT CASE WHEN len(l) > 10 THEN greatest(l[CAST(floor(len(l) * 0.5) AS BIGINT) + 1] - 300, 1) ELSE 200 END AS low, CASE WHEN len(l) > 10 THEN l[CAST(floor(len(l) * 0.5) AS BIGINT) + 1] + 300 ELSE 800 END AS high FROM md""")
def insert_size(spark, d):
    return P.insert_size(_frags(spark, d))


@query("P02_pair_enumerate", _FR + " SELECT fragment, id1, id2, adist AS distance, 0.5 * (mapq1 + mapq2) AS score, row_number() OVER (PARTITION BY fragment ORDER BY 0.5 * (mapq1 + mapq2) DESC, id1, id2, adist) AS rank FROM pr WHERE adist BETWEEN 200 AND 800")
def pair_enumerate(spark, d):
    return P.enumerate_pairs(_frags(spark, d)).select("fragment", "id1", "id2", "distance", "score", F.col("rank").cast("long").alias("rank"))


@query("P03_pair_greedy", _FR.replace("WITH ", "WITH RECURSIVE ", 1) + """, rk AS (SELECT fragment, id1, id2, row_number() OVER (PARTITION BY fragment ORDER BY 0.5 * (mapq1 + mapq2) DESC, id1, id2, adist) AS rank FROM pr WHERE adist BETWEEN 200 AND 800),
 gr AS (SELECT fragment, id1, id2, rank, true AS kept, [id1] AS one, [id2] AS two FROM rk WHERE rank = 1
  UNION ALL SELECT k.fragment, k.id1, k.id2, k.rank, NOT (list_contains(one, k.id1) OR list_contains(two, k.id2)), CASE WHEN list_contains(one, k.id1) OR list_contains(two, k.id2) THEN one ELSE list_append(one, k.id1) END, CASE WHEN list_contains(one, k.id1) OR list_contains(two, k.id2) THEN two ELSE list_append(two, k.id2) END
   FROM gr JOIN rk k ON k.fragment = gr.fragment AND k.rank = gr.rank + 1)
 SELECT fragment, id1, id2, rank FROM gr WHERE kept""")
def pair_greedy(spark, d):
    return P.greedy_pairs(P.enumerate_pairs(_frags(spark, d))).select("fragment", "id1", "id2", F.col("rank").cast("long").alias("rank"))


@query("P04_pair_rescue", _FR + """, r AS (SELECT fragment, id1, id2, mapq1 % 3 AS m1, mapq2 % 3 AS m2, 0.5 * (mapq1 % 3 + mapq2 % 3) AS score FROM pr WHERE adist BETWEEN 200 AND 800),
 k AS (SELECT *, row_number() OVER (PARTITION BY fragment ORDER BY score DESC, id1, id2) AS rank, count(*) OVER (PARTITION BY fragment, score) AS n FROM r)
 SELECT fragment, id1, id2, CASE WHEN rank = 1 AND n = 1 AND m1 = 0 THEN m2 ELSE m1 END AS mapq1, CASE WHEN rank = 1 AND n = 1 AND m2 = 0 THEN m1 ELSE m2 END AS mapq2 FROM k""")
def pair_rescue(spark, d):
    pairs = P.enumerate_pairs(_frags(spark, d).withColumn("mapq", F.col("mapq") % 3))
    return P.rescue_quality(pairs).select("fragment", "id1", "id2", "mapq1", "mapq2")


@query("P05_pair_fallback", _FR + """, l AS (SELECT *, count(*) OVER (PARTITION BY fragment, mate) AS n FROM fr WHERE fragment NOT IN (SELECT fragment FROM pr WHERE adist BETWEEN 200 AND 800)),
 f AS (SELECT fragment, 3 - mate AS mate, contig AS mcontig, pos AS mpos FROM l QUALIFY row_number() OVER (PARTITION BY fragment, mate ORDER BY id) = 1)
 SELECT l.fragment, l.mate, id, CASE WHEN n = 1 THEN 3 WHEN n = 2 THEN 2 WHEN n BETWEEN 3 AND 8 THEN 1 ELSE 0 END AS map_quality, mcontig, mpos FROM l LEFT JOIN f USING (fragment, mate)""")
def pair_fallback(spark, d):
    a = _frags(spark, d)
    return P.fallback(a, P.enumerate_pairs(a)).select("fragment", "mate", "id", "map_quality", "mcontig", "mpos")


@query("P06_template_length", _FR + """ SELECT fragment, id1, id2, CASE WHEN pos1 > pos2 THEN pos2 - (pos1 + len1) ELSE pos2 + len2 - pos1 END AS tlen1, CASE WHEN pos1 > pos2 THEN pos1 + len1 - pos2 ELSE pos1 - (pos2 + len2) END AS tlen2 FROM pr WHERE adist BETWEEN 200 AND 800""")
def template_length(spark, d):
    t1, t2 = P.template_length()
    return P.enumerate_pairs(_frags(spark, d)).select("fragment", "id1", "id2", t1.alias("tlen1"), t2.alias("tlen2"))


@query("P07_check_pairs", _FR + """, n AS (SELECT fragment, count(*) FILTER (mate = 1) AS n1, count(*) FILTER (mate = 2) AS n2 FROM fr GROUP BY 1), b AS (SELECT fragment, id1, id2 FROM pr WHERE dist BETWEEN 200 AND 800 QUALIFY row_number() OVER (PARTITION BY fragment ORDER BY len1 + len2 DESC, id1, id2) = 1)
 SELECT fragment, n1, n2, CASE WHEN n1 > 0 AND n2 > 0 THEN 'both' ELSE 'one' END AS status, id1, id2, n1 > 1 AND n2 > 1 AND id1 IS NULL AS cleared FROM n LEFT JOIN b USING (fragment)""")
def check_pairs(spark, d):
    return P.check_pairs(_frags(spark, d))


@query("J08_mate_rescue", _FR + """, w AS (SELECT fragment, contig, 1 - strand AS strand, greatest(pos - 800 - len, 0) AS rs, pos + len + 800 + len AS re FROM fr WHERE mate = 1) SELECT fragment, id, rs FROM fr JOIN w USING (fragment, contig, strand) WHERE mate = 2 AND pos >= rs AND pos < re""")
def mate_rescue(spark, d):
    f = _frags(spark, d)
    hits = f.where("mate = 2").select("fragment", "contig", "strand", "id", "pos")
    return P.rescue_window(f.where("mate = 1")).join(hits, ["fragment", "contig", "strand"]).where("pos >= r_start AND pos < r_end").select("fragment", "id", F.col("r_start").alias("rs"))


@query("J16_anchor_pairs", V.duck("aln") + """, a AS (SELECT DISTINCT frag AS read_id, flag // 16 % 2 AS strand, contig % 2 AS contig, CASE WHEN ln % 2 = 1 THEN 'F' ELSE 'B' END AS dir, pos AS s, pos + len // 3 + 3 AS e, len // 3 + 4 AS size FROM aln WHERE len // 3 + 4 >= 25),
 p AS (SELECT f.read_id, f.strand, f.contig, f.s AS start1, f.e AS end1, f.size AS size1, b.s AS start2, b.e AS end2, b.size AS size2 FROM a f JOIN a b USING (read_id, strand, contig) WHERE f.dir = 'F' AND b.dir = 'B' AND b.s >= f.s AND b.s - f.e <= 500000 QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY f.size + b.size DESC, contig, strand, f.s, b.s) = 1)
 SELECT * FROM p UNION ALL SELECT read_id, strand, contig, s, e, size, NULL, NULL, NULL FROM (SELECT * FROM a WHERE size > 35 AND read_id NOT IN (SELECT read_id FROM p) QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY size DESC, contig, strand, s) = 1)""")
def anchor_pairs(spark, d):
    a = V.alignments(spark, d).selectExpr("frag AS read_id", "flag div 16 % 2 AS strand", "contig % 2 AS contig", "if(ln % 2 = 1, 'F', 'B') AS dir", "pos AS start", "pos + len div 3 + 3 AS end").distinct()
    return P.anchor_pairs(a, alone=35).select("read_id", "strand", "contig", "start1", "end1", "size1", "start2", "end2", "size2")


# -- splicing


@query("R01_splice_type", V.duck("genome") + f""", w AS (SELECT contig, substr(bases, CAST(s + 1 AS BIGINT), {V.WIDTH}) AS b FROM (SELECT contig, bases, unnest(range(0, length(bases), {V.WIDTH})) AS s FROM genome)),
 m AS (SELECT contig, unnest(list_transform(range(1, length(b) - 38), lambda i: substr(b, i, 2) || '-' || substr(b, i + 38, 2))) AS motif FROM w),
 t AS (SELECT contig, motif, CASE motif WHEN 'GT-AG' THEN 1 WHEN 'CT-AC' THEN 2 WHEN 'AT-AC' THEN 3 WHEN 'GT-AT' THEN 4 WHEN 'GC-AG' THEN 5 WHEN 'CT-GC' THEN 6 ELSE -1 END AS kind FROM m)
 SELECT contig, motif, kind, CASE WHEN kind IN (2, 4, 6) THEN 1 WHEN kind IN (1, 3, 5) THEN 0 END AS strand, count(*) AS n FROM t GROUP BY 1, 2, 3, 4""")
def splice_type(spark, d):
    """The ends of all spans of 40 bases in the windows of the reference."""
    ends = F.transform(F.sequence(F.lit(1), F.length("bases") - 39), lambda i: F.concat(F.substring("bases", i, F.lit(2)), F.lit("-"), F.substring("bases", i + 38, F.lit(2))))
    motifs = V.reference(spark, d).where("length(bases) >= 40").select("contig", F.explode(ends).alias("motif")).groupBy("contig", "motif").agg(F.count("*").alias("n"))
    return motifs.withColumn("kind", splice.splice_type("motif")).withColumn("strand", splice.splice_strand("kind"))


@query("R03_cigar_junctions", V.duck("aln") + " SELECT frag AS read_id, contig, pos + len // 2 + 1 AS start, pos + len // 2 + 100 + nm AS \"end\", pos + 1 AS start_extend, pos + len + 100 + nm AS end_extend FROM aln")
def cigar_junctions(spark, d):
    a = V.alignments(spark, d).withColumn("read_id", F.col("frag")).withColumn("cigar", F.expr("concat(len div 2, 'M', 100 + nm, 'N', len - len div 2, 'M')"))
    return splice.cigar_junctions(a)


def _junctions(spark, d):
    a = V.alignments(spark, d)
    return a.selectExpr("flag div 16 % 2 AS strand", "contig", "pos div 500 AS start", "pos div 500 + 60 AS end", "pos AS start_extend", "pos + len AS end_extend", "if(nm % 5 = 0, 'AT-AC', 'GT-AG') AS motif")


_JN = V.duck("aln") + ", jn AS (SELECT flag // 16 % 2 AS strand, contig, pos // 500 AS s, pos // 500 + 60 AS e, pos AS sx, pos + len AS ex, CASE WHEN nm % 5 = 0 THEN 'AT-AC' ELSE 'GT-AG' END AS motif FROM aln)"


@query("G24_junction_count", _JN + ' SELECT strand, contig, s AS start, e AS "end", count(*) AS reads, min(sx) AS start_extend, max(ex) AS end_extend, max(motif) AS motif FROM jn GROUP BY 1, 2, 3, 4')
def junction_count(spark, d):
    return splice.count_junctions(_junctions(spark, d))


@query("G25_junction_totals", _JN + " SELECT count(*) AS total, count(*) FILTER (motif = 'GT-AG') AS canonical, count(*) FILTER (motif = 'AT-AC') AS semi_canonical FROM jn")
def junction_totals(spark, d):
    return splice.junction_totals(_junctions(spark, d))


@query("K07_junction_rows", _JN + """, c AS (SELECT strand, contig, s, e, count(*) AS reads, max(motif) AS motif FROM jn GROUP BY 1, 2, 3, 4) SELECT CAST(contig AS VARCHAR) AS contig, s AS start, e AS "end", 'JUNCTION_' || (row_number() OVER (ORDER BY c.strand, c.contig, s, e) - 1) AS name, reads, CASE WHEN strand = 0 THEN '+' ELSE '-' END AS strand, motif FROM c""")
def junction_rows(spark, d):
    return splice.junction_rows(splice.count_junctions(_junctions(spark, d)))


@query("J11_introns", V.duck("exons") + """, n AS (SELECT *, lead(s) OVER (PARTITION BY transcript ORDER BY s, e) AS nx FROM exons) SELECT strand, contig, e + 1 AS start, nx - 1 AS "end", count(*) AS transcripts FROM n WHERE nx > e + 1 GROUP BY 1, 2, 3, 4""")
def introns(spark, d):
    return splice.introns(V.exons(spark, d)).select("strand", "contig", "start", "end", "transcripts")


@query("J12_chain_introns", V.duck("aln") + """, c AS (SELECT DISTINCT frag AS read_id, 0 AS strand, contig % 2 AS contig, pk * 10 + ln AS seed_id, ln * 12 AS rs, ln * 12 + 17 AS re, pos AS s, pos + 17 AS e FROM aln),
 f AS (SELECT *, CASE WHEN coalesce(seed_id <> lag(seed_id) OVER w AND rs + 5 > lag(re) OVER w AND s <= lag(e) OVER w + 50000, false) THEN 0 ELSE 1 END AS f FROM c WINDOW w AS (PARTITION BY read_id, strand, contig ORDER BY s, seed_id))
 SELECT read_id, contig, seed_id, CAST(sum(f) OVER (PARTITION BY read_id, strand, contig ORDER BY s, seed_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chain FROM f""")
def chain_introns(spark, d):
    c = V.alignments(spark, d).selectExpr("frag AS read_id", "0 AS strand", "contig % 2 AS contig", "pk * 10 + ln AS seed_id", "ln * 12 AS read_start", "ln * 12 + 17 AS read_end", "pos AS start", "pos + 17 AS end").distinct()
    return splice.chain_over_introns(c, 50_000).select("read_id", "contig", "seed_id", "chain")


@query("J10_junction_lookup", _JN + """, q AS (SELECT pk AS id, strand, contig, lo, lo + 3 AS hi FROM (SELECT pk, flag // 16 % 2 AS strand, contig, pos // 700 AS lo FROM aln)), u AS (SELECT DISTINCT strand, contig, s, e FROM jn) SELECT id, lo, s AS start, e AS "end" FROM q JOIN u USING (strand, contig) WHERE s BETWEEN lo AND hi""")
def junction_lookup(spark, d):
    q = V.alignments(spark, d).selectExpr("pk AS id", "flag div 16 % 2 AS strand", "contig", "pos div 700 AS lim_start", "pos div 700 + 3 AS lim_end")
    u = _junctions(spark, d).select("strand", "contig", "start", "end").distinct()
    return splice.junction_lookup(q, u, bucket=64).select("id", F.col("lim_start").alias("lo"), "start", "end")


@query("G26_metaexons", V.duck("exons") + """, o AS (SELECT *, max(e) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM exons), g AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m + 40 THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o)
 SELECT contig, min(s) AS start, max(e) AS "end", count(*) AS n, array_to_string(list_sort(list(DISTINCT s)), ',') AS lefts FROM g GROUP BY contig, k""")
def metaexons(spark, d):
    e = V.exons(spark, d).withColumn("left_break", F.col("start")).withColumn("right_break", F.col("end"))
    return splice.metaexons(e).select("contig", "start", "end", "n", F.concat_ws(",", F.transform("left_breaks", lambda x: x.cast("string"))).alias("lefts"))


def _gaps(spark, d):
    r = V.sequences(spark, d).where("length(seq) >= 60")
    return r.select(F.col("read_id").alias("id"), F.expr("concat(substring(seq, 1, 6), substring(seq, 34, 6))").alias("query"), F.expr("concat(substring(seq, 1, 6), 'GT', substring(seq, 9, 6))").alias("donor"), F.expr("concat(substring(seq, 20, 6), 'AG', substring(seq, 34, 6))").alias("acceptor"), F.lit(1000).cast("long").alias("left_end"), F.lit(1200).cast("long").alias("right_start"))


@query("R04_canonical_search", V.duck("reads") + """, g AS (SELECT read_id AS id, substr(seq, 1, 6) || substr(seq, 34, 6) AS q, substr(seq, 1, 6) || 'GT' || substr(seq, 9, 6) AS dn, substr(seq, 20, 6) || 'AG' || substr(seq, 34, 6) AS ac FROM reads WHERE length(seq) >= 60),
 c AS (SELECT *, 12 - l AS r FROM (SELECT *, unnest(range(0, 13)) AS l FROM g)), m AS (SELECT *, substr(dn, CAST(l + 1 AS BIGINT), 2) || '-' || substr(ac, CAST(14 - r - 1 AS BIGINT), 2) AS motif,
  (SELECT count(*) FROM range(1, l + 1) t(i) WHERE substr(q, CAST(i AS BIGINT), 1) <> substr(dn, CAST(i AS BIGINT), 1)) + (SELECT count(*) FROM range(1, r + 1) t(i) WHERE substr(q, CAST(l + i AS BIGINT), 1) <> substr(ac, CAST(14 - r + i AS BIGINT), 1)) AS mism FROM c)
 SELECT id, l, r, motif, mism, 0.5 * (12 - mism) - 0.4 * mism AS score, 1000 + l + 2 AS start, 1200 - r AS "end" FROM (SELECT * FROM m WHERE motif IN ('GT-AG', 'CT-AC') QUALIFY row_number() OVER (PARTITION BY id ORDER BY 0.5 * (12 - mism) - 0.4 * mism DESC, l) = 1) WHERE mism <= 10""")
def canonical_search(spark, d):
    return splice.best_split(_gaps(spark, d)).select("id", F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"), "motif", "mism", "score", "start", "end")


_CUTS = ORACLES["R04_canonical_search"].split(" SELECT id, l, r, motif, mism, 0.5")[0]
_BEST = "QUALIFY row_number() OVER (PARTITION BY id ORDER BY 0.5 * (12 - mism) - 0.4 * mism DESC, l) = 1"


@query("R05_semi_canonical_search", _CUTS + f""", b1 AS (SELECT * FROM (SELECT * FROM m WHERE motif IN ('GT-AG', 'CT-AC') {_BEST}) WHERE mism <= 10),
 b2 AS (SELECT * FROM (SELECT * FROM m WHERE motif IN ('AT-AC', 'GT-AT', 'GC-AG', 'CT-GC') AND id NOT IN (SELECT id FROM b1) {_BEST}) WHERE mism <= 10)
 SELECT id, l, r, motif, mism, 0.5 * (12 - mism) - 0.4 * mism AS score, 1000 + l + 2 AS start, 1200 - r AS "end", CASE WHEN motif IN ('CT-AC', 'GT-AT', 'CT-GC') THEN 1 ELSE 0 END AS strand FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2)""")
def semi_canonical(spark, d):
    out = splice.search_junctions(_gaps(spark, d))
    return out.select("id", F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"), "motif", "mism", "score", "start", "end", "strand")


@query("R06_break_candidates", V.duck("aln") + """, x AS (SELECT frag AS id, nm % 3 AS kind, ln * 3 AS off, ln % 2 AS side FROM aln), dn AS (SELECT DISTINCT id, kind, 12 AS gap_read, off FROM x WHERE side = 1), ac AS (SELECT DISTINCT id, kind, off FROM x WHERE side = 0)
 SELECT id, kind, dn.off AS "left", ac.off AS "right" FROM dn JOIN ac USING (id, kind) WHERE abs(dn.off + ac.off - gap_read) <= 4""")
def break_candidates(spark, d):
    x = V.alignments(spark, d).selectExpr("frag AS id", "nm % 3 AS kind", "ln * 3 AS off", "ln % 2 AS side")
    dn = x.where("side = 1").select("id", "kind", F.lit(12).alias("gap_read"), "off").distinct()
    return splice.break_candidates(dn, x.where("side = 0").select("id", "kind", "off").distinct()).select("id", "kind", "left", "right")
