"""Near-duplicate documents by ProbMinHash, banding and verification.

Two texts are linked if the probability Jaccard of their weighted five-word shingles is at least 0.8; a class is a
connected component of links. Steps:

1. Each text gets a ProbMinHash signature and band keys. Equal word sequences (128-bit hash) become one node, numbered
   by a row of theirs.
2. Nodes with the same band key share a bucket. A bucket of up to SMALL nodes gives all its pairs, a larger one the
   pairs with its leader: the node with most company in large buckets, near the middle of a cloud of copies.
3. Pairs whose signatures agree too little are dropped (LEAST_AGREEMENT is five standard deviations below 0.8); the
   rest is verified exactly over whole texts.
4. In large buckets whose nodes aren't one class yet, the nodes outside of the bucket's main class are a query set: in
   blocks of bounded size they are compared with all nodes of the bucket, exactly, and only links are returned. A pair
   is compared in the first band that it shares. So no pair of a bucket is left out, none is emitted without being a
   link, and a bucket of real copies costs as much as it has nodes.

Work is done on ids, keys and signatures; only texts with a candidate are shuffled. Components are joins that run until
nothing changes. Hot keys are rows of skew joins, which Spark splits, or of aggregations with a map side.

Rows are told apart by id and text (th, the text's hash), so an id that several texts share, or a null one, is no case
of its own. A class is named by its smallest id, and its member with the smallest id (null last) and th is the one that
stays.

Defined cases: texts without words are in a class of their own each; rows with one id and other texts are documents of
their own; a class of null ids only has a null name; ties go to the smaller th; texts of any length are compared whole,
in batches cut by bytes; an empty table gives an empty result; other columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cut, map_batches, table, text_or_empty
from .shingles import mix, probability_jaccard, shingles, signatures

THRESHOLD = 0.8
#: Rows of a band and bands: at 0.8 a pair shares a band with probability 0.9998.
ROWS, BANDS = 4, 16
SMALL = 24
#: Distinct shingles of a block that asks and of one that is asked, about, and matches of shingles that are counted at a time.
ASKING, ASKED, MATCHES = 100_000, 400_000, 1 << 20
LEAST_AGREEMENT = 0.55
#: Rows broadcast at most to pick texts before they are shuffled.
BROADCAST_IDS = 2_000_000


def sketches(docs: DataFrame, rows: int, bands: int) -> DataFrame:
    """Of docs (id, th, text): id, th, c1, c2 (hash of the words), n (distinct shingles), sig (low 32 bits of each
    register), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            texts = b.column("text").to_pylist()
            sig, n = signatures(texts, rows * bands)
            key = np.zeros((len(texts), bands), np.uint64)
            for k in range(rows):
                key = mix(key * np.uint64(31) + sig[:, k::rows])
            digest = np.array([np.frombuffer(blake2b(b" ".join(t.lower().encode("utf-8", "surrogatepass").split()), digest_size=16).digest(), np.int64) for t in texts]).reshape(-1, 2)
            arrays = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel().astype(kind)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(n.astype(np.int32)), arrays(sig.view(np.int64), np.int32), arrays(key.view(np.int64), np.int64)], names=["id", "th", "c1", "c2", "n", "sig", "bands"])

    return map_batches(docs, run, "id long, th long, c1 long, c2 long, n int, sig array<int>, bands array<long>")


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts (id, text) are similar enough, with sim."""
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "ta", "tb", most=500):
            n = b.num_rows
            distinct: dict[str, int] = {}
            at = [distinct.setdefault(t, len(distinct)) for c in ("ta", "tb") for t in b.column(c).to_pylist()]
            t, e, w = shingles(list(distinct))
            cuts = np.searchsorted(t, np.arange(len(distinct) + 1))
            of = [(e[cuts[i] : cuts[i + 1]], w[cuts[i] : cuts[i + 1]]) for i in range(len(distinct))]
            sim = np.array([probability_jaccard(of[at[i]], of[at[n + i]]) for i in range(n)])
            ok = np.flatnonzero(sim >= threshold)
            yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(ok)), b.column("b").take(pa.array(ok)), pa.array(sim[ok])], names=["a", "b", "sim"])

    return map_batches(both, run, "a long, b long, sim double")


def components(links: DataFrame) -> DataFrame:
    """id, comp (the smallest id that links lead to) of all ids in links (a, b)."""
    edges = cut(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(links.select("b", "a")).distinct(), "edges")
    labels = cut(edges.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("comp")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("comp").alias("low"))
        step = labels.join(near, "id").select("id", "comp", F.least("comp", "low").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("comp").alias("far"))  # a label's own label
        new = cut(step.join(jump, "new").select("id", F.least("new", "far").alias("comp"), (F.least("new", "far") < F.col("comp")).alias("moved")), "labels")
        labels = new.select("id", "comp")
        if new.where("moved").isEmpty():
            return labels


def _texts_of(docs: DataFrame, rows: DataFrame, ids: DataFrame) -> DataFrame:
    """id and text of nodes; rows: node (a row's number), id and th of the rows that nodes are named by."""
    ids = cut(rows.join(ids.distinct(), rows["node"] == ids["id"], "left_semi"), "ids")
    wanted = ids.select("node", F.col("id").alias("_id"), F.col("th").alias("_th"))
    if ids.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    found = docs.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    return found.groupBy(F.col("node").alias("id")).agg(F.min("text").alias("text"))


def _pairs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a < b), and the nodes of large buckets: band, key, id, n."""
    band_rows = nodes.select("id", "n", F.posexplode("bands").alias("band", "key"))
    sizes = band_rows.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    members = cut(band_rows.join(sizes, ["band", "key"]), "members")
    small = members.where(F.col("size") <= SMALL).groupBy("band", "key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    pair = small.select(F.posexplode("ids").alias("i", "a"), "ids").select("a", F.explode(F.expr("slice(ids, i + 2, size(ids))")).alias("b"))
    large = members.where(F.col("size") > SMALL)
    company = large.groupBy("id").agg(F.sum("size").alias("company"))
    leaders = large.join(company, "id").groupBy("band", "key").agg(F.max(F.struct("company", F.xxhash64("id").alias("o"), "id"))["id"].alias("leader"))
    star = large.join(leaders, ["band", "key"]).where("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"))
    return pair.union(star).distinct(), large.select("band", "key", "id", "n")


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose signatures agree in enough registers."""
    s = nodes.select("id", "sig")
    joined = pairs.join(s.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(s.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    return joined.where(same >= F.size("sa") * LEAST_AGREEMENT).select("a", "b")


def _open(large: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of large buckets whose nodes aren't all in one class, with comp and the bucket's main class and sizes in
    shingles, whole and without that class."""
    got = large.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    by_comp = got.groupBy("band", "key", "comp").agg(F.sum("n").alias("k"))
    mixed = by_comp.groupBy("band", "key").agg(F.sum("k").alias("size"), F.count("*").alias("comps"), F.max(F.struct("k", "comp"))["comp"].alias("main"), F.max("k").alias("k")).where("comps > 1")
    return cut(got.join(mixed.select("band", "key", "size", "main", (F.col("size") - F.col("k")).alias("asking")), ["band", "key"]), "open")


def _first_common(x: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """The first band in which x has the key of each of ys."""
    return (ys == x).argmax(axis=1)


def _matches(e: np.ndarray, h: np.ndarray, w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Where each of h begins in the sorted e, how often it is there, and its weight, in pieces of about MATCHES."""
    low = np.searchsorted(e, h, "left")
    size = np.searchsorted(e, h, "right") - low
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // MATCHES)) + 1
    yield from zip(np.split(low, cuts), np.split(size, cuts), np.split(w, cuts))


def block_links(band: int, asking: pd.DataFrame, asked: pd.DataFrame, threshold: float) -> list[tuple[int, int, float]]:
    """Links (a, b, sim) between nodes of two blocks (id, comp, bands, text) of a bucket."""
    of = [s for df in (asking, asked) for s in _shingled(df["text"].tolist())]
    mine, theirs = of[: len(asking)], of[len(asking) :]
    e = np.concatenate([x[0] for x in theirs])
    node = np.repeat(np.arange(len(theirs)), [len(x[0]) for x in theirs])
    weight = np.concatenate([x[1] for x in theirs])
    by = np.argsort(e, kind="stable")
    e, node, weight = e[by], node[by], weight[by]
    total = np.array([x[1].sum() for x in theirs])
    plain = np.array([x[1].max() == 1 for x in theirs])
    comps, ids, bands = asked["comp"].to_numpy(), asked["id"].to_numpy(), np.stack(asked["bands"].to_list())
    out = []
    for row, (h, w) in zip(asking.itertuples(index=False), mine):
        ok = (comps != row.comp) & (_first_common(np.asarray(row.bands), bands) == band)
        if not ok.any():
            continue
        common, share, back = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))
        for low, size, times in _matches(e, h, w):
            at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
            common += np.bincount(node[at], minlength=len(ids))
            share += np.bincount(node[at], np.repeat(times, size), minlength=len(ids)) / w.sum()  # of the one's weight
            back += np.bincount(node[at], weight[at], minlength=len(ids)) / total
        # the similarity is at most the share of either's weight that the other has; of sets it is common / union
        near = ok & (share >= threshold - 1e-9) & (back >= threshold - 1e-9)  # sums of pieces may be a rounding apart
        if w.max() == 1:
            near &= ~plain | (common / (len(h) + total - common) >= threshold)
        for k in np.flatnonzero(near):
            sim = probability_jaccard((h, w), theirs[k])
            if sim >= threshold:
                out.append((min(row.id, ids[k]), max(row.id, ids[k]), sim))
    return out


def _shingled(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for part in chunks(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])]), "text"):
        t, e, w = shingles(part.column("text").to_pylist())
        cuts = np.searchsorted(t, np.arange(part.num_rows + 1))
        out += [(e[cuts[k] : cuts[k + 1]], w[cuts[k] : cuts[k + 1]]) for k in range(part.num_rows)]
    return out


def _links_in_blocks(undecided: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links of the nodes outside of each bucket's main class with all nodes of the bucket."""
    rows = undecided.join(nodes.select("id", "bands"), "id").join(texts, "id")
    x, y = F.ceil(F.col("asking") / ASKING), F.ceil(F.col("size") / ASKED)
    keys = ["band", "key", "bx", "by"]
    spread = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    asking = rows.where("comp <> main").select("band", "key", "id", "comp", "bands", "text", F.pmod(F.xxhash64("id"), x).cast("int").alias("bx"), spread(y).alias("by"))
    asked = rows.select("band", "key", "id", "comp", "bands", "text", F.pmod(F.xxhash64("id", F.lit(1)), y).cast("int").alias("by"), spread(x).alias("bx"))
    asked = asked.select(*[F.col(c).alias(f"{c}_") for c in asking.columns])  # a cogroup wants other columns

    def compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right.columns = left.columns
        found = block_links(key[0], left, right, threshold) if len(left) and len(right) else []
        return pd.DataFrame(found, columns=["a", "b", "sim"]).astype({"a": "int64", "b": "int64", "sim": "float64"})

    return asking.groupBy(*keys).cogroup(asked.groupBy(*[f"{k}_" for k in keys])).applyInPandas(compare, "a long, b long, sim double")


def members(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th, class_id and stays (the one row of its class, by id and th, that stays) of each row of docs."""
    text = text_or_empty(text_col)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    sketched = cut(sketches(docs, ROWS, BANDS).withColumn("node", F.monotonically_increasing_id()), "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "th")).alias("first")
    own = sketched.where("n > 0").groupBy("c1", "c2")
    named = F.min(F.struct("node", "id", "th")).alias("named")
    reps = cut(own.agg(named, first, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")).select("c1", "c2", "named.node", "named.id", "named.th", "first", "copies", "n", "sig", "bands"), "nodes")
    nodes = reps.select(F.col("node").alias("id"), "n", "sig", "bands")
    rows = reps.select("node", "id", "th")
    pairs, large = _pairs(nodes)
    likely = cut(_likely(pairs, nodes), "likely")
    texts = cut(_texts_of(docs, rows, likely.select(F.col("a").alias("id")).union(likely.select("b"))), "texts")
    links = cut(verify(likely, texts, threshold), "links")
    labels = components(links)
    undecided = _open(large, labels)
    if not undecided.isEmpty():
        more = cut(_links_in_blocks(undecided, nodes, cut(_texts_of(docs, rows, undecided.select("id")), "texts"), threshold), "links")
        if not more.isEmpty():
            labels = components(links.union(more))
    linked = reps.select("c1", "c2", "node", "first").join(labels.select(F.col("id").alias("node"), "comp"), "node")
    firsts = linked.groupBy("comp").agg(F.min("first").alias("low"))
    by_link = linked.join(firsts, "comp").select("c1", "c2", "low")
    alone = reps.where("copies > 1").join(labels, reps["node"] == labels["id"], "left_anti").select("c1", "c2", F.col("first").alias("low"))
    out = sketched.select("id", "th", "c1", "c2", "n").join(by_link.union(alone), ["c1", "c2"], "left")
    shared = (F.col("n") > 0) & F.col("low").isNotNull()
    stays = ~shared | (F.col("id").eqNullSafe(F.col("low.id")) & (F.col("th") == F.col("low.th")))
    return out.select("id", "th", F.when(shared, F.col("low.id")).otherwise(F.col("id")).alias("class_id"), stays.alias("stays"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and class_id of each row of docs."""
    return members(docs, threshold, id_col, text_col).select("id", "class_id")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id")


QUERIES = {"op6_near_dedup": op6_near_dedup}
ORACLES: dict[str, str] = {}
