"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination and tokenisation of documents.

Each stage takes (spark, docs, sf_dir), with docs in the columns of documents, and returns what it keeps in the same
columns; the last returns the digests of the encoded texts. A stage's output is written as Parquet and read again as
the input of the next.

Defined cases: rows with a null text have no language and go in the first stage; texts without words are never near
copies; rows that share one id, or have none, are told apart by their texts; of rows equal in id and text one stays;
texts of any length pass whole; an empty table passes through all stages; columns beyond those of documents, whatever
their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqforge.llm import bpe, decontamination, language_id, line_dedup, near_dedup
from seqforge.llm.common import cut, free, table, text_or_empty

#: Ids broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what language ID rejects: texts without letters, and those whose margin is too narrow."""
    prefix = "_lang_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    judged = language_id.classify(docs, language_id.fit(docs), prefix=prefix)
    return judged.where(~F.col(f"{prefix}rejected")).select(_columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that ten documents or more have, in all of them."""
    out = free(docs, "_kept")[0]
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_docs=10), out_col=out)
    changed = F.col(f"{out}.n_dropped") > 0
    new = {"text": F.when(changed, F.col(f"{out}.text")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length(f"{out}.text").cast("long")).otherwise(F.col("n_chars"))}
    return kept.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates, the one with the smallest id. Rows are told apart by id and
    text; of rows that are equal in both, one stays."""
    own, th, at, rank = free(docs, "_id", "_th", "_at", "_rank")
    found = cut(near_dedup.members(docs).select(F.col("id").alias(own), F.col("th").alias(th), "stays"), "members")
    marked = docs.withColumn(at, F.xxhash64(text_or_empty("text")))
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(at) == F.col(th))
    gone = found.where(~F.col("stays")).select(own, th).distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    kept = marked.join(gone, same, "left_anti")
    twice = found.groupBy(own, th).count().where("count > 1")
    if not twice.isEmpty():  # rows equal in id and text
        kept = kept.withColumn(rank, F.row_number().over(Window.partitionBy("doc_id", at).orderBy(F.lit(0)))).where((F.col(rank) == 1) | ~text_or_empty("text").rlike(r"[^ \t\n\x0B\f\r]")).drop(rank)
    return kept.select(_columns(docs))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes it again: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.round_trip(docs, bpe.tokenizer_path())


STAGES = [("language ID", languages), ("line dedup", lines), ("MinHash near-dedup", near_copies), ("benchmark decontamination", benchmarks), ("BPE encoding and decoding", tokens)]

#: The first, third and last stage have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage{k}")
    return docs
