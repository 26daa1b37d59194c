"""Benchmark decontamination in DataFrame functions only.

A window of a document is as long as a benchmark item, in words, and stands where the document shares a five-word
shingle with an item: any window with a shingle similarity above 0 does, so none is lost. A SimHash of its words, BITS
long, must lie within RADIUS of the fingerprint of an item of that length. The multi-index cuts fingerprints into BLOCKS
blocks of 16 bits; two fingerprints within the radius differ by NEAR bits at most in one block at least, so a join of a
window's blocks with all values that are as near to an item's blocks, by (length, block, value), finds all of them. An
unrelated pair meets in a given block with probability 697 / 65536. At a similarity of 0.8 words agree to a cosine of
0.89, so fingerprints differ in 38 bits of 256 on average with a deviation of 6; the radius is 4 deviations beyond.
Candidates are verified by the weighted Jaccard similarity of their shingles, at least 0.8.

Words are what stands between ASCII white space, lower-cased. The benchmark's shingles are broadcast up to
BROADCAST_ROWS rows (checked) and joined by a shuffle beyond.

Defined cases: null and empty texts have no window; items of fewer than five words have no shingle and match nothing;
windows are clipped at the ends of a text; rows with the same id and text give one result; of windows with the same
similarity the first is returned; texts of any length are searched whole; empty tables give an empty result; other
columns are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RE, cut, free, table, text_or_empty

SIZE = 5
BITS, RADIUS, THRESHOLD = 256, 63, 0.8
_LONGS, BLOCKS = BITS // 64, BITS // 16
#: Bits in which the nearest block of two fingerprints within the radius differs at most.
NEAR = RADIUS // BLOCKS
BROADCAST_ROWS = 1_000_000


def _words(text_col: str) -> Column:
    """Hashes of a text's words."""
    words = F.filter(F.split(F.lower(text_or_empty(text_col)), SPACE_RE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingles(words: Column) -> Column:
    """Hashes of all windows of SIZE words, in order."""
    at = F.sequence(F.lit(0), F.size(words) - SIZE)
    return F.when(F.size(words) >= SIZE, F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SIZE)]))).otherwise(F.array().cast("array<bigint>"))


def _simhash(words: Column) -> Column:
    """Longs of 64 bits each; a bit is set if most words' hashes have it set."""

    def one(hashes: Column) -> Column:
        bit = lambda b: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.when(F.expr("0L") == F.call_function("shiftright", h, b).bitwiseAND(F.lit(1)), -1).otherwise(1)) > 0
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda f, b: F.when(bit(b), f.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(f))

    return F.array(*[one(F.transform(words, lambda h: F.xxhash64(h, F.lit(k)))) for k in range(_LONGS)])


def _blocks(fingerprint: Column) -> Column:
    """(block, value) of each block of a fingerprint."""
    value = lambda k: F.shiftrightunsigned(F.get(fingerprint, k // 4), k % 4 * 16).bitwiseAND(F.lit(0xFFFF)).cast("int")
    return F.array(*[F.struct(F.lit(k).alias("block"), value(k).alias("value")) for k in range(BLOCKS)])


def _distance(a: str, b: str) -> Column:
    return sum((F.bit_count(F.get(F.col(a), k).bitwiseXOR(F.get(F.col(b), k))) for k in range(_LONGS)), F.lit(0))


def _numbered(shingles: Column) -> Column:
    """Hashes of each shingle with the number of equal ones before it: sets of these have the similarity of the
    multisets."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).alias("k"), F.array().cast("array<bigint>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        k = F.when(acc["last"] == s, acc["k"] + 1).otherwise(0)
        return F.struct(s.alias("last"), k.alias("k"), F.concat(acc["out"], F.array(F.xxhash64(s, k))).alias("out"))

    return F.aggregate(F.array_sort(shingles), start, add, lambda acc: acc["out"])


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th (hash of the text), item_id, start (word), n_words and similarity of each document's best window for
    each item that it has."""
    items = cut(benchmark.where("item_id IS NOT NULL").select("item_id", _words("text").alias("w")).where(F.size("w") >= SIZE), "items")
    keys = cut(items.select(F.size("w").alias("len"), F.posexplode(_shingles(F.col("w"))).alias("o", "s")).select("len", F.col("o"), "s").distinct(), "keys")
    prints = cut(items.select("item_id", F.size("w").alias("len"), _simhash(F.col("w")).alias("fp"), _numbered(_shingles(F.col("w"))).alias("shingles")), "prints")

    text = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("th"), text_or_empty(text_col).alias("text"))
    spread = text.select("id", "th", _words("text").alias("w")).select("id", "th", F.posexplode(_shingles(F.col("w"))).alias("p", "s"))
    anchored = spread.join(_small(keys), "s").select("id", "th", "len", F.greatest(F.col("p") - F.col("o"), F.lit(0)).alias("start")).distinct()
    starts = cut(anchored.groupBy("id", "th").agg(F.collect_list(F.struct("start", "len")).alias("at")), "starts")

    hit = _small(starts.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "at"))
    found = text.join(hit, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("id", "th", _words("text").alias("w"), "at")
    windows = found.select("id", "th", F.explode("at").alias("a"), "w").select("id", "th", "a.start", "a.len", F.slice("w", F.col("a.start") + 1, F.col("a.len")).alias("w"))
    marked = cut(windows.select("id", "th", "start", "len", F.size("w").alias("n_words"), _simhash(F.col("w")).alias("wfp"), _numbered(_shingles(F.col("w"))).alias("ws")), "windows")

    masks = F.lit([m for m in range(1 << 16) if m.bit_count() <= NEAR])  # a block's neighbours differ from it by these
    blocks = prints.select("item_id", "len", F.explode(_blocks(F.col("fp"))).alias("b"), masks.alias("masks"))
    index = blocks.select("item_id", "len", "b.block", F.col("b.value").alias("v"), F.explode("masks").alias("m")).select("item_id", "len", "block", F.col("v").bitwiseXOR(F.col("m")).alias("value"))
    probes = marked.select("id", "th", "start", "len", "wfp", F.explode(_blocks(F.col("wfp"))).alias("b")).select("id", "th", "start", "len", "wfp", "b.block", "b.value")
    met = probes.join(index.hint("merge"), ["len", "block", "value"]).drop("block", "value").distinct()  # the index is larger than its source tells
    near = (
        met.join(_small(prints.select("item_id", "fp")), "item_id")
        .where(_distance("fp", "wfp") <= RADIUS)
        .select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.col("start").alias("_start"), F.col("len").alias("_len"), "item_id").distinct()
    )
    on = F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")) & (F.col("start") == F.col("_start")) & (F.col("len") == F.col("_len"))
    pairs = marked.join(near, on).select("id", "th", "start", "n_words", "ws", "item_id").join(_small(prints.select("item_id", "shingles")), "item_id")
    similarity = F.size(F.array_intersect("ws", "shingles")) / F.greatest(F.size(F.array_union("ws", "shingles")), F.lit(1))
    best = F.max_by(F.struct("start", "n_words"), F.struct("sim", -F.col("start")))
    return (
        pairs.withColumn("sim", similarity).where(F.col("sim") >= threshold)
        .groupBy("id", "th", "item_id").agg(F.max("sim").alias("similarity"), best.alias("b"))
        .select("id", "th", "item_id", "b.start", "b.n_words", "similarity")
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that hold an item."""
    own, th = free(docs, "_id", "_th")
    bad = cut(matches(docs, benchmark, id_col=id_col, text_col=text_col).select(F.col("id").alias(own), F.col("th").alias(th)).distinct(), "leaks")
    at = F.xxhash64(text_or_empty(text_col))
    return docs.join(_small(bad), F.col(id_col).eqNullSafe(F.col(own)) & (at == F.col(th)), "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", F.col("start").cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words"), F.round("similarity", 6).alias("similarity"))


SQL = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\t\\n\\x0B\\f\\r ]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\t\\n\\x0B\\f\\r ]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + 5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS p FROM d)),
sh AS (SELECT item_id, len(w) AS len, p AS o, array_to_string(w[p + 1 : p + 5], ' ') AS s FROM (SELECT item_id, w, unnest(range(0, len(w) - 4)) AS p FROM i)),
win AS (SELECT DISTINCT doc_id, len, greatest(p - o, 0) AS start FROM ds JOIN (SELECT DISTINCT len, o, s FROM sh) USING (s)),
wc AS (SELECT doc_id, win.len, start, s, count(*) AS n FROM win JOIN ds USING (doc_id) WHERE p >= start AND p <= start + win.len - 5 GROUP BY ALL),
ic AS (SELECT item_id, len, s, count(*) AS m FROM sh GROUP BY ALL),
wt AS (SELECT doc_id, len, start, sum(n) AS nt FROM wc GROUP BY ALL),
common AS (SELECT doc_id, item_id, len, start, sum(least(n, m)) AS c FROM wc JOIN ic USING (len, s) GROUP BY ALL),
sim AS (SELECT doc_id, item_id, len, start, c / (nt + len - 4 - c) AS sim FROM common JOIN wt USING (doc_id, len, start) WHERE c / (nt + len - 4 - c) >= 0.8),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, start) AS r FROM sim)
SELECT doc_id, item_id, start, CAST(least(best.len, len(w) - start) AS BIGINT) AS n_words, round(sim, 6) AS similarity FROM best JOIN d USING (doc_id) WHERE r = 1
"""

QUERIES = {"op7_decontamination": op7_decontamination}
ORACLES = {"op7_decontamination": SQL}
