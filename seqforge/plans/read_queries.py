"""Queries on reads: filters, trimming, profiles, seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import reads as R
from . import views as V

QUERIES, ORACLES = {}, {}
_MEAN = "(SELECT read_id, avg(a - 33) AS mq, min(a - 33) AS lo FROM bases GROUP BY 1)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_FILTER = R.ReadFilter(length=(50, 100), quality=(20, 30), left_length=10, left_quality=(15, 35), right_length=10, right_quality=(15, 35), max_n=30, max_out_of_quality=90)
_PASSED = V.duck("bases") + """,
p AS (SELECT r.read_id, length(seq) BETWEEN 50 AND 100 AND length(seq) - length(replace(seq, 'N', '')) <= 30
   AND (SELECT avg(a - 33) BETWEEN 20 AND 30 AND count(*) FILTER (a - 33 NOT BETWEEN 20 AND 30) <= 90 AND avg(a - 33) FILTER (pos <= 10) BETWEEN 15 AND 35
        AND avg(a - 33) FILTER (pos > length(r.seq) - 10) BETWEEN 15 AND 35 FROM bases b WHERE b.read_id = r.read_id) AS passed FROM reads r) """


@query("F01_fastq_filter", _PASSED + "SELECT read_id, coalesce(passed, false) AS passed FROM p")
def fastq_filter(spark, d):
    return R.filter_reads(V.reads(spark, d), _FILTER).select("read_id", "passed")


@query("F02_split_count", _PASSED + "SELECT count(*) FILTER (passed) AS num_passed, count(*) FILTER (passed IS NOT TRUE) AS num_failed FROM p")
def split_count(spark, d):
    return R.split_counts(R.filter_reads(V.reads(spark, d), _FILTER))


@query("F03_fastq_trim", V.duck("bases") + """,
l AS (SELECT read_id, coalesce(min(pos) FILTER (a - 33 >= 20), 11) - 1 AS l FROM bases WHERE pos <= 10 GROUP BY 1),
r AS (SELECT read_id, coalesce(n - max(pos) FILTER (a - 33 >= 20), 10) AS r FROM (SELECT b.*, max(pos) OVER (PARTITION BY read_id) AS n FROM bases b) WHERE pos > n - 10 GROUP BY read_id, n)
SELECT read_id, substr(seq, CAST(l + 1 AS BIGINT), CAST(greatest(length(seq) - l - r, 0) AS BIGINT)) AS seq, substr(qual, CAST(l + 1 AS BIGINT), CAST(greatest(length(seq) - l - r, 0) AS BIGINT)) AS qual, l > 0 OR r > 0 AS edited
FROM reads JOIN l USING (read_id) JOIN r USING (read_id)""")
def fastq_trim(spark, d):
    return R.trim_reads(V.reads(spark, d), 10, (20, 100), 10, (20, 100))


@query("A01_adapter_trim", V.duck("reads") + """,
h AS (SELECT read_id, seq, k, length(seq) AS n, instr(seq, k) AS s FROM (SELECT *, 'ACGTA' AS k FROM reads)),
c AS (SELECT *, n // 3 AS t, CASE WHEN s > 0 THEN s + 4 END AS e FROM h)
SELECT read_id, CASE WHEN s = 0 THEN 'none' WHEN s - 1 > n - t OR e - 1 > n - t THEN 'right' WHEN s - 1 < t OR e - 1 < t THEN 'left' ELSE 'none' END AS adapter_cut,
  CASE WHEN s = 0 THEN seq WHEN s - 1 > n - t OR e - 1 > n - t THEN substr(seq, 1, s - 1) WHEN s - 1 < t OR e - 1 < t THEN substr(seq, e + 1) ELSE seq END AS seq
FROM (SELECT read_id, seq, n, t, CASE WHEN s > 0 THEN s ELSE s2 END AS s, CASE WHEN s > 0 THEN e ELSE CASE WHEN s2 > 0 THEN s2 + 4 END END AS e FROM (SELECT *, instr(seq, 'TACGT') AS s2 FROM c))""")
def adapter_trim(spark, d):
    return R.trim_adapter(V.reads(spark, d), "ACGTA").select("read_id", "adapter_cut", "seq")


@query("A02_seed_positions", V.duck("reads") + """,
s AS (SELECT read_id, seq, length(seq) - 18 AS last, greatest(length(seq) // 20, 9) AS step FROM reads WHERE length(seq) > 18),
p AS (SELECT read_id, seq, CAST(unnest(range(0, last, step)) AS BIGINT) AS read_pos FROM s UNION ALL SELECT read_id, seq, CAST(last AS BIGINT) FROM s WHERE last % step <> 0)
SELECT read_id, read_pos, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substr(seq, read_pos + 1, 18), ''), lambda b: CAST(CASE b WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 0 END AS BIGINT))), lambda x, y: x * 4 + y) AS kmer FROM p""")
def seed_positions(spark, d):
    return R.seeds(V.sequences(spark, d)).select("read_id", F.col("read_pos").cast("long").alias("read_pos"), "kmer")


@query("PJ1_revcomp", V.duck("reads") + " SELECT read_id, reverse(translate(seq, 'ACGTN', 'TGCAN')) AS seq FROM reads")
def revcomp(spark, d):
    return V.sequences(spark, d).select("read_id", S.revcomp("seq").alias("seq"))


@query("X03_hamming", V.duck("bases") + """ SELECT a.read_id, count(*) FILTER (a.base <> b.base) AS mism, CAST(coalesce(sum(a.a - 33) FILTER (a.base <> b.base), 0) AS BIGINT) AS weighted, min(a.pos) FILTER (a.base <> b.base) - 1 AS prefix
  FROM bases a LEFT JOIN bases b ON b.read_id = a.read_id AND b.pos = a.pos + 1 GROUP BY 1""")
def hamming(spark, d):
    r = V.reads(spark, d).withColumn("t", F.expr("substring(seq, 2)"))
    p = S.common_prefix("seq", "t")
    return r.select("read_id", S.mismatches("seq", "t").alias("mism"), S.mismatch_quality("seq", "t", "qual").alias("weighted"), F.when(p < F.length("t"), p).alias("prefix"))


@query("B03_dinucleotide", V.duck("bases") + """ SELECT dinuc, count(*) AS n FROM (SELECT CASE WHEN prev IN ('A','C','G','T') AND base IN ('A','C','G','T') THEN 4 * (instr('AGCT', prev) - 1) + instr('AGCT', base) - 1 ELSE 16 END AS dinuc FROM bases) GROUP BY 1""")
def dinucleotide(spark, d):
    return R.dinucleotides(V.sequences(spark, d))


@query("G01_fastq_scalar", V.duck("bases") + f""" SELECT count(*) AS num_reads, min(length(seq)) AS min_length, max(length(seq)) AS max_length, avg(length(seq)) AS mean_length, round((SELECT avg(mq) FROM {_MEAN}), 6) AS mean_quality,
 CAST(sum(length(seq) - length(replace(seq, 'A', ''))) AS BIGINT) AS num_a, CAST(sum(length(seq) - length(replace(seq, 'C', ''))) AS BIGINT) AS num_c, CAST(sum(length(seq) - length(replace(seq, 'G', ''))) AS BIGINT) AS num_g,
 CAST(sum(length(seq) - length(replace(seq, 'T', ''))) AS BIGINT) AS num_t, CAST(sum(length(seq) - length(replace(seq, 'N', ''))) AS BIGINT) AS num_n, round(100.0 * sum(length(seq) - length(replace(replace(seq, 'C', ''), 'G', ''))) / sum(length(seq)), 6) AS gc_percent FROM reads""")
def fastq_scalar(spark, d):
    out = R.scalar_profile(V.reads(spark, d))
    return out.withColumn("mean_quality", F.round("mean_quality", 6)).withColumn("gc_percent", F.round("gc_percent", 6))


@query("G02_length_histogram", V.duck("reads") + " SELECT l AS length, count(read_id) AS n FROM (SELECT unnest(range(1, (SELECT max(length(seq)) + 1 FROM reads))) AS l) LEFT JOIN reads ON length(seq) = l GROUP BY 1")
def length_histogram(spark, d):
    return R.length_histogram(V.sequences(spark, d))


@query("G03_quality_histogram", V.duck("bases") + f" SELECT CAST(round(mq) AS BIGINT) AS quality, count(*) AS n FROM {_MEAN} GROUP BY 1")
def quality_histogram(spark, d):
    return R.quality_histogram(V.reads(spark, d))


@query("G04_gc_histogram", V.duck("reads") + " SELECT 100 * (length(seq) - length(replace(replace(seq, 'C', ''), 'G', ''))) // length(seq) AS gc, count(*) AS n FROM reads GROUP BY 1")
def gc_histogram(spark, d):
    return R.gc_histogram(V.sequences(spark, d))


@query("G05_position_quality", V.duck("bases") + " SELECT pos, count(*) AS n, CAST(sum(a) AS BIGINT) AS sum_q, round(sum(a) / count(*) - 33, 6) AS mean_quality FROM bases GROUP BY 1")
def position_quality(spark, d):
    return R.position_quality(V.reads(spark, d)).withColumn("mean_quality", F.round("mean_quality", 6))


_NT = "SELECT pos, count(*) AS n, " + ", ".join(f"count(*) FILTER (base = '{b}') AS n_{b.lower()}" for b in "ATGCN")


@query("G06_position_bases", V.duck("bases") + " " + _NT + ", " + ", ".join(f"round(100.0 * count(*) FILTER (base = '{b}') / count(*), 6) AS pct_{b.lower()}" for b in "ATGCN") + " FROM bases GROUP BY 1")
def position_bases(spark, d):
    out = R.position_bases(V.sequences(spark, d))
    return out.select(*[F.round(c, 6).alias(c) if c.startswith("pct") else c for c in out.columns])


@query("G07_position_gc", V.duck("bases") + " SELECT pos, round(100.0 * count(*) FILTER (base IN ('G', 'C')) / count(*), 6) AS gc FROM bases GROUP BY 1 HAVING 100.0 * count(*) FILTER (base IN ('G', 'C')) / count(*) > 1")
def position_gc(spark, d):
    return R.position_gc(V.sequences(spark, d)).withColumn("gc", F.round("gc", 6))


_WORDS = V.duck("reads") + """,
w AS (SELECT pos, substr(seq, pos, 5) AS kmer FROM (SELECT seq, CAST(unnest(range(1, length(seq) - 3)) AS BIGINT) AS pos FROM reads) WHERE substr(seq, pos, 5) NOT LIKE '%N%'),
b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS b), a AS (SELECT b1.b || b2.b || b3.b || b4.b || b5.b AS kmer FROM b b1, b b2, b b3, b b4, b b5),
c AS (SELECT kmer, count(pos) AS n FROM a LEFT JOIN w USING (kmer) GROUP BY 1) """


@query("G08_kmer_counts", _WORDS + "SELECT * FROM c")
def kmer_counts(spark, d):
    return R.kmer_counts(V.sequences(spark, d))


@query("G08_top_kmers", _WORDS + "SELECT * FROM c ORDER BY n DESC, kmer LIMIT 20")
def top_kmers(spark, d):
    return R.top_kmers(V.sequences(spark, d))


@query("G09_kmer_positions", _WORDS + "SELECT kmer, pos, count(*) AS n FROM w WHERE kmer IN (SELECT kmer FROM c ORDER BY n DESC, kmer LIMIT 5) GROUP BY 1, 2")
def kmer_positions(spark, d):
    return R.kmer_positions(V.sequences(spark, d))


@query("G10_filtered_stats", _PASSED + ", b2 AS (SELECT b.* FROM bases b JOIN p USING (read_id) WHERE passed) SELECT pos, count(*) AS n, CAST(sum(a) AS BIGINT) AS sum_q FROM b2 GROUP BY 1")
def filtered_stats(spark, d):
    passed = R.filter_reads(V.reads(spark, d), _FILTER).where("passed")
    return R.position_quality(passed).select("pos", "n", "sum_q")
