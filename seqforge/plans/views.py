"""Sequencing views of the driver's tables, in Spark and as DuckDB text with the same rows.

Reads are consecutive pieces of READ characters of the whole text of every document; the reference has a contig for
each document, which is its whole text in bases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import batches
from ..operators import mapping

WIDTH = 256
CONTIG_LENGTH = 200_100
READ = 100
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def _duck_bases(text: str) -> str:
    return f"regexp_replace(translate(lower({text}), '{LETTERS}', '{BASES}'), '[^ACGT]', 'N', 'g')"


DUCK = {
    "reads": f"""reads AS (SELECT read_id, seq, array_to_string(list_transform(range(1, length(seq) + 1), lambda i: chr(CAST(35 + (ascii(substr(seq, i, 1)) * 31 + i * 17 + read_id * 13) % 40 AS INTEGER))), '') AS qual
  FROM (SELECT doc_id * 100000 + k AS read_id, {_duck_bases(f"substr(text, CAST(k * {READ} + 1 AS BIGINT), {READ})")} AS seq FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / {READ}.0) AS BIGINT))) AS k FROM documents)))""",
    "bases": """bases AS (SELECT read_id, pos, substr(seq, CAST(pos AS BIGINT), 1) AS base, ascii(substr(qual, CAST(pos AS BIGINT), 1)) AS a, CASE WHEN pos > 1 THEN substr(seq, CAST(pos - 1 AS BIGINT), 1) ELSE '' END AS prev
  FROM (SELECT read_id, seq, qual, unnest(range(1, length(seq) + 1)) AS pos FROM reads))""",
    "aln": """aln AS (SELECT *, CASE WHEN nm % 3 = 0 THEN len || 'M' WHEN nm % 3 = 1 THEN (len // 2) || 'M2D' || (len - len // 2) || 'M' ELSE (len // 2) || 'M2I' || (len - len // 2 - 2) || 'M' END AS cigar,
    substr(translate(md5(k || 'a') || md5(k || 'b') || md5(k || 'c') || md5(k || 'd'), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, len) AS seq
  FROM (SELECT l_orderkey AS frag, CAST(l_linenumber AS BIGINT) AS ln, l_partkey AS pk, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS k, 'f' || l_orderkey AS qname,
    l_suppkey % 5 AS contig, (l_suppkey + CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END) % 5 AS mcontig, (l_partkey * 37 + l_orderkey * 11) % 200000 AS pos, (l_partkey * 37 + l_orderkey * 11) % 200000 + l_partkey % 500 AS mpos,
    CAST(l_quantity AS BIGINT) + 50 AS len, (l_partkey * 7 + l_linenumber) % 61 AS mapq, CAST(round(l_discount * 100) AS BIGINT) AS nm, l_partkey % 900 - 450 AS tlen,
    1 + CASE WHEN l_partkey % 3 = 1 THEN 2 ELSE 0 END + CASE WHEN l_partkey % 7 = 0 THEN 4 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END + CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END
      + CASE WHEN l_partkey % 11 = 0 THEN 256 ELSE 0 END + CASE WHEN l_partkey % 13 = 0 THEN 1024 ELSE 0 END AS flag FROM lineitem))""",
    "contigs": f"contigs AS (SELECT CAST(i AS BIGINT) AS contig, 'chr' || i AS name, CAST({CONTIG_LENGTH} AS BIGINT) AS length, CASE WHEN i = 4 THEN 2 ELSE 0 END AS kind FROM range(5) t(i))",
    "intervals": 'intervals AS (SELECT event_id AS id, user_id AS contig, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + CAST(ceil("value") AS BIGINT) AS e FROM events)',
    "exons": "exons AS (SELECT DISTINCT frag AS transcript, frag % 5 AS contig, frag % 2 AS strand, pos + 1 AS s, pos + len - 50 AS e FROM aln)",
    "genome": f"genome AS (SELECT doc_id AS contig, {_duck_bases('text')} AS bases FROM documents WHERE text <> '')",
    "probes": """probes AS (SELECT read_id, CASE WHEN read_id % 2 = 0 OR length(seq) < 40 THEN seq ELSE substr(seq, 1, 39) || translate(substr(seq, 40, 1), 'ACGTN', 'CATGA') || substr(seq, 41) END AS seq FROM reads)""",
    "cals": """cals AS (SELECT frag AS read_id, ln AS mate, pk AS id, contig, flag // 16 % 2 AS strand, pos AS start, pos + len AS e, len AS length, len - 3 * nm AS score, len AS read_area, nm, len % 9 = 0 AS invalid FROM aln)""",
}
NEEDS = {"bases": ["reads"], "exons": ["aln"], "probes": ["reads"], "cals": ["aln"]}


def duck(*names: str) -> str:
    """WITH clause with these views."""
    done: list[str] = []

    def add(n: str) -> None:
        for x in NEEDS.get(n, []):
            add(x)
        if n not in done:
            done.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(DUCK[n] for n in done)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _as_bases(text) -> Column:
    return F.regexp_replace(F.translate(F.lower(text), LETTERS, BASES), "[^ACGT]", "N")


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """read_id and seq of the reads."""
    pieces = F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{READ}}}"), F.lit(0))).alias("k", "piece")
    cut = table(spark, d, "documents").select("doc_id", pieces)
    return cut.select((F.col("doc_id") * 100_000 + F.col("k")).alias("read_id"), _as_bases(F.col("piece")).alias("seq"))


def _with_qualities(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        data, at = batches.flat(b.column("seq"))
        i = batches.places(at) + 1
        q = 35 + (data * np.int64(31) + i * 17 + np.repeat(b.column("read_id").to_numpy(), np.diff(at)) * 13) % 40
        yield pa.RecordBatch.from_arrays([*b.columns, batches.strings(q, at)], names=["read_id", "seq", "qual"])


def reads(spark: SparkSession, d: str) -> DataFrame:
    return sequences(spark, d).mapInArrow(_with_qualities, "read_id long, seq string, qual string")


def alignments(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS frag", "bigint(l_linenumber) AS ln", "l_partkey AS pk", "concat(l_orderkey, '-', l_linenumber, '-', l_partkey) AS k", "concat('f', l_orderkey) AS qname",
        "l_suppkey % 5 AS contig", "(l_suppkey + if(l_partkey % 3 = 0, 1, 0)) % 5 AS mcontig", "(l_partkey * 37 + l_orderkey * 11) % 200000 AS pos", "(l_partkey * 37 + l_orderkey * 11) % 200000 + l_partkey % 500 AS mpos",
        "bigint(l_quantity) + 50 AS len", "(l_partkey * 7 + l_linenumber) % 61 AS mapq", "bigint(round(l_discount * 100)) AS nm", "l_partkey % 900 - 450 AS tlen",
        "bigint(1 + if(l_partkey % 3 = 1, 2, 0) + if(l_partkey % 7 = 0, 4, 0) + if(l_returnflag = 'R', 16, 0) + if(l_linenumber % 2 = 1, 64, 128) + if(l_partkey % 11 = 0, 256, 0) + if(l_partkey % 13 = 0, 1024, 0)) AS flag",
    )
    return rows.selectExpr(
        "*", "CASE WHEN nm % 3 = 0 THEN concat(len, 'M') WHEN nm % 3 = 1 THEN concat(len div 2, 'M2D', len - len div 2, 'M') ELSE concat(len div 2, 'M2I', len - len div 2 - 2, 'M') END AS cigar",
        "substring(translate(concat(md5(concat(k, 'a')), md5(concat(k, 'b')), md5(concat(k, 'c')), md5(concat(k, 'd'))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, int(len)) AS seq",
    )


def contigs(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(5).selectExpr("id AS contig", "concat('chr', id) AS name", f"bigint({CONTIG_LENGTH}) AS length", "if(id = 4, 2, 0) AS kind")


def intervals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("event_id AS id", "user_id AS contig", "bigint(unix_timestamp(ts)) AS start", "bigint(unix_timestamp(ts)) + bigint(ceil(value)) AS end")


def exons(spark: SparkSession, d: str) -> DataFrame:
    return alignments(spark, d).selectExpr("frag AS transcript", "frag % 5 AS contig", "frag % 2 AS strand", "pos + 1 AS start", "pos + len - 50 AS end").distinct()


def genome(spark: SparkSession, d: str) -> DataFrame:
    """A contig for each document."""
    return table(spark, d, "documents").where("text <> ''").select(F.col("doc_id").alias("contig"), _as_bases(F.col("text")).alias("bases"))


def reference(spark: SparkSession, d: str) -> DataFrame:
    return mapping.windows(genome(spark, d), WIDTH)


def index(spark: SparkSession, d: str) -> DataFrame:
    return mapping.kmer_index(mapping.windows(genome(spark, d), WIDTH, mapping.K - 1))


def probes(spark: SparkSession, d: str) -> DataFrame:
    """All reads, every other one with a substitution."""
    return reads(spark, d).select("read_id", _probed().alias("seq"), "qual")


def sequence_probes(spark: SparkSession, d: str) -> DataFrame:
    """probes without qualities, which are not made."""
    return sequences(spark, d).select("read_id", _probed().alias("seq"))


def _probed() -> Column:
    mutated = F.expr("concat(substring(seq, 1, 39), translate(substring(seq, 40, 1), 'ACGTN', 'CATGA'), substring(seq, 41))")
    return F.when((F.col("read_id") % 2 == 0) | (F.length("seq") < 40), F.col("seq")).otherwise(mutated)


def cals(spark: SparkSession, d: str) -> DataFrame:
    """Candidate regions; read_id is the fragment."""
    return alignments(spark, d).selectExpr("frag AS read_id", "ln AS mate", "pk AS id", "contig", "flag div 16 % 2 AS strand", "pos AS start", "pos + len AS end", "len AS length", "len - 3 * nm AS score", "len AS read_area", "nm", "len % 9 = 0 AS invalid")
