"""Importance resampling of documents towards a target distribution.

Features are hashed n-grams: runs of n words, repeats counted, each in the bucket that its UTF-8 bytes' crc32 gives.
Counts by bucket of the corpus and of the target give every bucket an integer gain, a document's weight is the sum of
the gains of its features, and a seeded Gumbel noise makes the highest scores a draw without replacement.

Long texts are the skew of this job: one may hold as much as thousands of others. A text of more than LONG bytes is cut
at word boundaries into chunks of CHUNK_WORDS words. A chunk carries the next n - 1 words as well and owns the features
that start at its own words, so each feature of the text is in exactly one chunk. The chunks are dealt over all tasks;
counts add up over chunks, and weights are summed by document.

Counts leave a task as one row a bucket at most. What the driver holds is a number for each bucket, whatever the input's
size. Ranks come from rows dealt by ranges of (score, doc_id) and sorted in each range: a row's rank is its place in its
range after the sizes of the ranges before it, so no task sees all rows.

Words are what the class WORD matches after A-Z is lower-cased; n is a parameter (N = 1 in the query).

Defined cases: a null or empty text has no features, weight 0 and a score of its noise alone; a null doc_id draws its noise
from '<seed>:'; rows that share an id, or equal each other, are scored and ranked row by row, those with one id, score
and weight in any order; texts shorter than n words have no features; nulls rank last among ties; an empty corpus gives
an empty result, an empty target gains that depend on the corpus alone; columns other than the id and the text are
neither read nor returned, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cut, map_batches, parts, table, text_or_empty

#: Words are runs of digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N, BUCKETS, SEED = 1, 10_000, 2024
#: Words that a document needs to be drawn, and the percentage that is.
LEAST_WORDS, PERCENT = 20, 10
#: Bytes from which a text is cut, and words that a chunk owns.
LONG, CHUNK_WORDS = 1 << 17, 8192
#: Longer features are hashed one by one.
_SHORT = 64

_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c.astype(np.uint32)


_CRC = _crc_table()


def crc32s(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of each data[start : start + size], a byte of all of them at a time."""
    by = np.argsort(-size, kind="stable")
    s, n = start[by], size[by]
    c = np.full(len(by), 0xFFFFFFFF, np.uint32)
    first = int((n > _SHORT).sum())
    longer = len(n) - np.searchsorted(n[::-1], np.arange(min(_SHORT, int(n[0]) if len(n) else 0)), side="right")
    for k, upto in enumerate(longer):
        x = slice(first, upto)
        c[x] = _CRC[(c[x] ^ data[s[x] + k]) & np.uint32(255)] ^ (c[x] >> np.uint32(8))
    c ^= np.uint32(0xFFFFFFFF)
    for i in range(first):
        c[i] = zlib.crc32(data[s[i] : s[i] + n[i]].tobytes())
    out = np.empty_like(c)
    out[by] = c
    return out


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of all texts in a row, where words begin and end, and the text of each word."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], _IN_WORD[data].view(np.int8)])))
    start, end = edge[::2], edge[1::2]
    of = np.searchsorted(np.cumsum([len(x) + 1 for x in raw]), start, side="right")
    return data, start, end, of


def features(texts: list[str], owned: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all features that texts own: the text and the bucket; and each text's number of own words. owned: how many
    words each text owns, from its first on."""
    data, start, end, of = _words(texts)
    k = len(texts)
    words = np.bincount(of, minlength=k)[:k] if len(of) else np.zeros(k, np.int64)
    mine = np.minimum(words, owned)
    # all words in a row, with one space after each
    size = end - start
    at = np.cumsum(size + 1) - size - 1
    keep = _IN_WORD[data]
    keep[end] = True
    row = data[keep].copy()
    row[at + size] = 32
    place = np.arange(len(of)) - (np.cumsum(words) - words)[of]
    last = np.arange(len(of)) + n - 1
    ok = np.flatnonzero((place < mine[of]) & (place + n <= words[of]))
    bucket = crc32s(row, at[ok], at[last[ok]] + size[last[ok]] - at[ok]) % np.uint32(buckets)
    return of[ok], bucket.astype(np.int64), mine


def pieces(text: str, n: int, words: int) -> list[tuple[int, str]]:
    """The chunks of a text: how many words each owns, and its text from the first of them on, n - 1 words carried."""
    raw = text.encode("utf-8", "surrogatepass")
    _, start, end, _ = _words([text])
    cuts = range(0, len(start), words)
    return [(min(words, len(start) - a), raw[start[a] : end[min(a + words + n - 1, len(end)) - 1]].decode("utf-8", "surrogatepass")) for a in cuts] or [(0, "")]


def chunked(docs: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Short texts (id, text), and chunks of long ones (row, id, owned, text), dealt over all tasks; row names the text."""
    named = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    length = F.octet_length("text")
    words = CHUNK_WORDS

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, i, text in zip(b.column("row"), b.column("id"), b.column("text").to_pylist()):
                got = pieces(text, n, words)
                for k in range(0, len(got), 100):
                    some = got[k : k + 100]
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(some), pa.int64()), pa.array([i.as_py()] * len(some), b.column("id").type), pa.array([x[0] for x in some], pa.int32()), pa.array([x[1] for x in some], pa.string())], names=["row", "id", "owned", "text"])

    kind = named.schema["id"].dataType.simpleString()
    long = named.where(length > LONG).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    out = map_batches(long, split, f"row long, id {kind}, owned int, text string").repartition(parts(docs.sparkSession))
    return named.where(length <= LONG), cut(out, "chunks")


def counts(texts: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n: the features of all rows of texts (text, and owned where they are chunks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in chunks(batches, "text"):
            _, bucket, _ = features(b.column("text").to_pylist(), b.column("owned").to_numpy(), n, buckets)
            total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return map_batches(texts, run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's integer gain from the counts of both; a number for each bucket is all that the driver holds."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for into, df in ((s, corpus), (t, target)):
        for r in df.collect():
            into[r["bucket"]] = r["n"]
    total, wanted = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(y + 1) * total) / (float(x + 1) * wanted))) for x, y in zip(s, t)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, split: tuple[DataFrame, DataFrame], n: int = N) -> DataFrame:
    """id, n_words, n_features and weight of each row of docs. split: chunked(docs)."""
    short, long = split
    buckets = len(gain)
    kind = short.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            of, bucket, words = features(b.column("text").to_pylist(), b.column("owned").to_numpy(), n, buckets)
            sums, number = np.zeros(b.num_rows, np.int64), np.bincount(of, minlength=b.num_rows)
            np.add.at(sums, of, gain[bucket])
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), pa.array(words.astype(np.int64)), pa.array(number.astype(np.int64)), pa.array(sums)], names=["row", "id", "n_words", "n_features", "weight"])

    schema = f"row long, id {kind}, n_words long, n_features long, weight long"
    numbers = ["n_words", "n_features", "weight"]
    whole = map_batches(_owning_all(short).select(F.lit(None).cast("long").alias("row"), "id", "owned", "text"), run, schema).select("id", *numbers)
    summed = map_batches(long.select("row", "id", "owned", "text"), run, schema).groupBy("row", "id").agg(*[F.sum(c).alias(c) for c in numbers])
    return whole.unionByName(summed.select("id", *numbers))


def _owning_all(texts: DataFrame) -> DataFrame:
    return texts.withColumn("owned", F.lit(2**31 - 1))


def gumbel(id_col: str, seed: int):
    """floor(-1000 ln(-ln u)) with u from the first 8 hex digits of sha256('<seed>:<id>')."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """Rows of scored (id, score, ...), with rank by (score descending, id) up to drawn, null beyond."""
    spark = scored.sparkSession
    n = parts(spark)
    order = [F.desc("score"), F.asc_nulls_last("id")]
    dealt = cut(scored.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    sizes = {r["p"]: r["n"] for r in dealt.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}  # a row a partition
    before = dict(zip(sorted(sizes), accumulate((sizes[p] for p in sorted(sizes)), initial=0)))
    offsets = spark.createDataFrame(sorted(before.items()), "_p long, _before long") if before else spark.createDataFrame([], "_p long, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    joined = dealt.join(F.broadcast(offsets), F.shiftright("_at", 33) == F.col("_p"))
    return joined.withColumn("rank", F.when(place <= drawn, place)).drop("_at", "_p", "_before")


def resample(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """id, n_words, n_features, weight, score and rank of each row of docs; of the documents with at least least words
    the highest percent of a hundred are drawn."""
    split = chunked(docs, n, id_col, text_col)
    aim = chunked(target, n, target_col, target_col)
    of = lambda x: counts(_owning_all(x[0]).select("owned", "text").union(x[1].select("owned", "text")), n, buckets)
    gain = gains(of(split), of(aim), buckets)
    found = weights(docs, gain, split, n).withColumn("score", F.col("weight") + gumbel("id", seed))
    kept = cut(found, "scores")
    enough = kept.where(F.col("n_words") >= least)
    drawn = percent * enough.count() // 100
    return ranked(enough, drawn).unionByName(kept.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


SQL = f"""
WITH RECURSIVE bits AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
dw AS (SELECT doc_id, unnest(ws) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
b AS (SELECT w, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(0, length(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::BIGINT)), lambda x, y: xor(t[xor(x & 255, y) + 1], x >> 8))) % {BUCKETS} AS bucket FROM v, crc),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN b USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM bw JOIN b USING (w) GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS})::DOUBLE) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
x AS (SELECT doc_id, len(ws) AS n_features, ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT AS h FROM d),
y AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN b USING (w) JOIN g USING (bucket) GROUP BY 1),
z AS (SELECT doc_id, n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM x LEFT JOIN y USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (doc_id)
"""

QUERIES = {"op13_resampling": op13_resampling}
ORACLES = {"op13_resampling": SQL}
