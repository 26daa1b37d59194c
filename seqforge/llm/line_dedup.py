"""Line dedup over a whole corpus, by range-partitioned line hashes.

Each line becomes a row of (128-bit hash of its key, document, position). The rows are dealt by ranges of
(hash, document) and sorted by (hash, document, position) in each partition, so a line that a third of all documents
have spreads over as many partitions as its rows need. One pass over each sorted partition counts the documents of
every hash and notes its first occurrence. Only the first and the last hash of a partition can go on in a neighbour;
their partial counts are added up in a small aggregation. Documents get back a compressed keep bitmap, not text.

A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased. Lines with an empty key are
always kept.

Defined cases: a null or empty text is one empty line; rows with one id count as one document (null is an id like
others); repeated rows and rows with one id and other texts each get the decisions of their own lines; texts of any
length are split whole; an empty table gives an empty result; other columns are neither read nor returned by keep_bitmaps, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, cut, free, hash128, map_batches, parts, table, text_or_empty

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), _UPPER, _LOWER)


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (h1, h2, id, th, pos) for each line with a non-empty key; th tells apart texts under one id."""
    lines = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_or_empty(text_col)).alias("th"),
        F.posexplode(F.split(text_or_empty(text_col), "\n", -1)).alias("pos", "line"),
    )
    keyed = lines.select("id", "th", "pos", line_key(F.col("line")).alias("key")).where("key <> ''")
    return keyed.select(*hash128(F.col("key")), "id", "th", "pos")


def _count_runs(batches: Iterator[pa.RecordBatch], at_least: int) -> Iterator[pa.RecordBatch]:
    """Of each hash in a sorted partition: the number of its documents and its first occurrence, if they are enough or
    the hash stands at an edge of the partition."""
    names = ["h1", "h2", "n_docs", "id", "th", "pos"]
    first, held = True, None  # held: the hash that is still running, and its last document

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        h1, h2, th, pos = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("h1", "h2", "th", "pos"))
        ids = b.column(b.schema.get_field_index("id"))
        null = np.asarray(ids.is_null())
        idv = ids.fill_null(0).to_numpy(zero_copy_only=False)
        new_h = np.ones(n, bool)
        new_h[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new_d = new_h.copy()
        new_d[1:] |= (idv[1:] != idv[:-1]) | (null[1:] != null[:-1])
        starts = np.flatnonzero(new_h)
        counts = np.add.reduceat(new_d.astype(np.int64), starts)
        one = lambda i: None if null[i] else int(idv[i])
        rows = []
        if held and (held[0], held[1]) == (h1[0], h2[0]):
            counts[0] -= held[6] == one(0)
            held[2] += int(counts[0])
            starts, counts = starts[1:], counts[1:]
            if len(starts):
                rows.append(held)
        elif held:
            rows.append(held)
        wanted = [r for r in rows if first or r[2] >= at_least]
        first = first and not rows
        if len(starts):
            inner = np.arange(len(starts) - 1)
            keep = inner[counts[:-1] >= at_least]
            if first and len(inner):
                keep, first = np.union1d(keep, [0]), False
            wanted += [(int(h1[s]), int(h2[s]), int(c), one(s), int(th[s]), int(pos[s])) for s, c in zip(starts[keep], counts[keep])]
            s = starts[-1]
            held = [int(h1[s]), int(h2[s]), int(counts[-1]), one(s), int(th[s]), int(pos[s]), one(n - 1)]
        else:
            held[6] = one(n - 1)
        if wanted:
            yield out([tuple(r[:6]) for r in wanted])
    if held:
        yield out([tuple(held[:6])])


def repeated_lines(rows: DataFrame, min_docs: int) -> DataFrame:
    """The hashes found in at least min_docs documents, with the number of documents and the first occurrence."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(parts(spark), "h1", "h2", "id").sortWithinPartitions("h1", "h2", "id", "pos", "th")
    runs = map_batches(dealt, lambda it: _count_runs(it, min_docs), "h1 long, h2 long, n_docs long, id long, th long, pos int")
    return (
        runs.groupBy("h1", "h2")
        .agg(F.sum("n_docs").alias("n_docs"), F.min(F.struct(F.coalesce(F.col("id"), F.lit(-(2**63))).alias("o"), "pos", "th")).alias("first"))
        .where(F.col("n_docs") >= min_docs)
    )


@F.pandas_udf(T.BinaryType())
def _bitmap(dropped: pd.Series) -> pd.Series:
    def packed(at: np.ndarray) -> bytes:
        keep = np.ones(-(-(at.max() + 1) // 8) * 8, bool)  # whole bytes; lines beyond them stay
        keep[at] = False
        return zlib.compress(np.packbits(keep).tobytes(), 1)

    return dropped.map(packed)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each document that loses lines: id, th, n_dropped, bitmap (zlib of packed bits, one for each line).

    keep: "none" drops all lines of a key found in min_docs documents, "first" spares its first occurrence.
    A document without a row keeps all its lines.
    """
    rows = cut(line_rows(docs, id_col, text_col), "lines")
    repeated = cut(repeated_lines(rows, min_docs), "repeated")
    hit = rows.join(repeated.select("h1", "h2", "first"), ["h1", "h2"])
    if keep == "first":
        hit = hit.where(~((F.coalesce(F.col("id"), F.lit(-(2**63))) == F.col("first.o")) & (F.col("pos") == F.col("first.pos")) & (F.col("th") == F.col("first.th"))))
    dropped = hit.groupBy("id", "th").agg(F.collect_set("pos").alias("dropped"))
    return dropped.select("id", "th", F.size("dropped").cast("long").alias("n_dropped"), _bitmap("dropped").alias("bitmap"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "kept") -> DataFrame:
    """docs with a column out_col, which replaces one of that name: a struct (text, n_lines, n_dropped) of what the bitmaps
    keep. A null text stays null."""

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def kept(text: pd.Series, bitmap: pd.Series) -> pd.DataFrame:
        out = []
        for t, b in zip(text, bitmap):
            n = (t or "").count("\n") + 1
            if b is None:
                out.append((t, n, 0))
                continue
            bits = np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8))[:n].astype(bool)
            lines = (t or "").split("\n")
            left = [x for x, k in zip(lines, bits) if k] + lines[len(bits) :]
            out.append(("\n".join(left), n, n - len(left)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    docs = docs.drop(out_col)
    own, bid, bth, bits = free(docs, "_th", "_bid", "_bth", "_bits")
    b = bitmaps.select(F.col("id").alias(bid), F.col("th").alias(bth), F.col("bitmap").alias(bits))
    at = F.xxhash64(text_or_empty(text_col))
    joined = docs.withColumn(own, at).join(b, F.col(id_col).eqNullSafe(F.col(bid)) & (F.col(own) == F.col(bth)), "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], kept(F.col(text_col), F.col(bits)).alias(out_col))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs, min_docs=10))
    sha = F.sha2(F.coalesce(F.col("kept.text"), F.lit("")), 256)
    return out.select("doc_id", F.col("kept.n_lines").alias("n_lines"), F.col("kept.n_dropped").alias("n_dropped"), sha.alias("kept_sha256"))


SQL = """
WITH l AS (
  SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
f AS (SELECT k.*, k.key IN (SELECT key FROM r) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLES = {"op9_line_dedup": SQL}
