"""Quality rules with thresholds that the data set.

Each document gets counts of its words, symbols and repetitions. Ratios of these counts go, by language and source,
into mergeable KLL quantile sketches, which are merged into those of their language, and these into one of all documents.
The distribution of a group is a mixture: its own with weight n / (n + PRIOR), n being its documents, its language's with
the like share of the rest, and that of all documents. So every (language, source) pair has thresholds of its own, a small
one close to those of its language, and none of them jumps at a size. A document fails a rule if its ratio lies beyond the
threshold of its group: upper quartile + SPREAD x interquartile range or, where the middle half of the group has one value
(most have no symbol at all), the quantile TAIL. No threshold is fixed. They are a row for each pair and join by it.

Defined cases: a null or empty text has no words and fails the base; null languages and sources form groups of their
own; a ratio equal to the threshold passes, so a group of equal ratios fails nowhere; repeated rows are judged alike;
texts of any length are counted whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cut, map_batches, table
from .quantiles import borrowed_weights, mixed_quantiles

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
#: Ratio, its numerator and denominator.
RULES = [
    ("symbol_ratio", "n_symbols", "word_chars"),
    ("dup_line_ratio", "n_dup_lines", "n_lines"),
    ("repeat_ratio", "n_repeat_words", "n_words"),
    ("upper_ratio", "n_upper", "word_chars"),
    ("word_length", "word_chars", "n_words"),
]
SPREAD, TAIL = 6.0, 0.99
#: A group of so many documents counts half by itself, and half by its language; a language likewise, and all documents.
#: Small, since the quantile TAIL is that of others as soon as they have more than 1 - TAIL of the mixture.
PRIOR = 5
#: Accuracy of the sketches: ranks err by about 0.003.
SKETCH_K = 1000


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words in windows of size words that the list has twice or more, the first included."""
    n = len(words)
    if n <= size:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    code = w[: n - size + 1]
    for k in range(1, size):  # number the windows exactly: (prefix, next word), compressed at each step
        code = code * len(ids) + w[k : n - size + 1 + k]
        if k < size - 1:
            code = np.unique(code, return_inverse=True)[1]
    _, where, count = np.unique(code, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[where] > 1)
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + size, -1)
    return int((np.cumsum(covered[:n]) > 0).sum())


def counts_of(text: str | None) -> list[int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    body = raw.translate(None, SPACES)
    lines = [x for x in raw.split(b"\n") if x.split()]
    chars = len((text or "").translate({c: None for c in SPACES}))
    return [
        len(words),
        chars,
        len(body) - len(body.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(map(str.isupper, text or "")),
    ]


def document_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without text, with COUNTS."""
    others = [f for f in docs.schema.fields if f.name != text_col]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, text_col):
            got = np.array([counts_of(t.as_py()) for t in b.column(text_col)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [b.column(f.name) for f in others] + [pa.array(got[:, i]) for i in range(len(COUNTS))],
                names=[f.name for f in others] + COUNTS,
            )

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + [f"{c} long" for c in COUNTS])
    return map_batches(docs, count, schema)


def ratio(n: str, d: str) -> Column:
    return F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(0.0)


def thresholds(counts: DataFrame, spread: float = SPREAD, tail: float = TAIL, prior: float = PRIOR) -> DataFrame:
    """A row for each (lang, source) with max_<ratio>, from its own distribution, its language's and that of all."""
    base = counts.where("n_words >= 10").select("lang", "source", *[ratio(n, d).alias(r) for r, n, d in RULES])
    names = [r for r, *_ in RULES]
    own = cut(base.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(r, SKETCH_K).alias(r) for r in names]), "sketches")
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(r, SKETCH_K).alias(r) for r in names]]
    by_lang = own.groupBy("lang").agg(*merged)
    whole = own.agg(*merged)
    a, b, c = own.alias("a"), by_lang.alias("b"), whole.alias("c")
    joined = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang"))).join(F.broadcast(c))  # c is one row
    weights = borrowed_weights(F.col("a.n"), F.col("b.n"), F.col("c.n"), prior=prior)
    points = joined.select(F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), *[mixed_quantiles([F.col(f"{t}.{r}") for t in "abc"], weights, [0.25, 0.75, tail]).alias(r) for r in names])
    limit = lambda r: F.when(F.col(r)[1] > F.col(r)[0], F.col(r)[1] + spread * (F.col(r)[1] - F.col(r)[0])).otherwise(F.col(r)[2])
    return points.select("lang", "source", *[limit(r).alias(f"max_{r}") for r in names])


def judged(docs: DataFrame, spread: float = SPREAD, tail: float = TAIL) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept and the first rule that failed (null: none)."""
    counts = cut(document_counts(docs.select("doc_id", "text", "lang", "source")), "counts")
    limits = cut(thresholds(counts, spread, tail), "limits").withColumnsRenamed({"lang": "_lang", "source": "_source"})
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    rule = F.coalesce(*[F.when(ratio(n, d) > F.col(f"max_{r}"), F.lit(r)) for r, n, d in RULES])
    return (
        counts.join(limits, same, "left")
        .withColumn("base_failed", failed)
        .withColumn("failed_rule", rule)
        .withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())
        .select("doc_id", *COUNTS, "base_failed", "kept", "failed_rule")
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES: dict[str, str] = {}
