"""Similarity join of documents on sets of word n-grams, by prefix trees.

Two texts link if the Jaccard similarity of their sets of SIZE-word shingles is at least PERCENT / 100. Steps:

1. Equal sets (128-bit hash) become one node, numbered by a row of theirs.
2. Shingles have one global order: those whose hash is in the lowest share LOW of the hashes first, by the number of nodes
   that have them, the others after them by hash. A set of n can only link with another if they share one of its first
   n - ceil(PERCENT n / 100) + 1 shingles (its prefix). Only shingles of the low share are counted, so the counting has
   LOW of all shingles as rows; a set with fewer of them than its prefix is long counts its next ones as well. A set
   whose prefix has a shingle that nobody shares in every place is out: most texts end here. What travels to be counted
   are the first BITS bits of the hashes, sorted and packed by ranges with the numbers of their nodes, about five bytes
   each; shingles of equal bits count as one, which only adds candidates.
3. Nodes that share a prefix shingle are a group; of shingles with the same nodes one stays. Groups with common nodes are a
   cluster, and a cluster of up to WHOLE shingles is one lot, joined by its trie: its sets travel once.
4. In larger clusters every node first goes to its largest group only, in lots of bounded size that all hold the group's
   leader (the node with most company), so that most of a cloud of copies becomes one component. Then groups whose nodes
   aren't one component yet (or a cluster as a whole, if so fewer shingles travel) are joined by bands of sizes, so wide that sets of other than neighbouring bands can't link:
   the nodes outside of the group's main component are a query set, compared in blocks of bounded size with the nodes of
   each band near theirs, unless all of these are one component. So no pair of a group that may link is left out, and
   none is emitted without being a link that merges two components.

A lot's trie stores its sets as paths of shingles, those that most of its sets have first, so that copies share long
paths; an edge holds a run of shingles without a fork. A set that asks goes down from the root, all edges of a depth at
a time, and takes along the overlap of each path, which all sets below share. A subtree is left as soon as its overlap
and what remains (of the shorter of the asking set's rest and the subtree's longest path of a size that may link)
can't reach the threshold, or when all its sets are of the asking set's component.

Texts travel to lots, not shingles to the driver; labels are joins that run until nothing changes. Hot keys are rows of
skew joins, which Spark splits, of aggregations with a map side, or of lots.

Rows are told apart by id and text. Defined cases: a text that is null or has no words has an empty set and links with
nothing; one with fewer words than SIZE has its whole sequence as its only shingle; rows of one id are documents of their
own; a component of null ids has a null name, others the smallest id in them; repeated rows are all returned; texts of
any length are taken whole; an empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cut, map_batches, parts, table, text_or_empty
from .near_dedup import components
from .shingles import mix, word_spans

SIZE, PERCENT = 4, 85
#: Share of the hashes whose shingles are counted.
LOW = 0.3
#: Shingles of a cluster that is one lot at most; of a lot, of a block that asks and of one that is asked, about.
WHOLE, LOT, ASKING, ASKED = 1 << 20, 1 << 16, 1 << 19, 1 << 19
#: Bits of a shingle's hash that are counted; hashes that a task sorts and packs, and those of a range, at a time, about.
BITS, PACKED, RANGE = 44, 1 << 20, 1 << 21
#: Of the hashes of the low share, by these bits.
BOUND = int(LOW * 2**BITS)
#: Rows broadcast at most to pick texts before they are shuffled.
BROADCAST_IDS = 2_000_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], np.uint64)


def shingle_sets(texts: list[str], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """text and hash (63 bits) of each distinct shingle of each text, in order of both."""
    h, of, *_ = word_spans([t.encode("utf-8", "surrogatepass").lower() for t in texts])
    n = len(h)
    counts = np.bincount(of, minlength=len(texts)) if n else np.zeros(len(texts), np.int64)
    many = max(0, n - size + 1)
    whole = np.zeros(many, np.uint64)
    for k in range(size):
        whole = whole * _FACTORS[0] + mix(h[k : k + many] ^ _FACTORS[k % 8])
    inside = of[:many] == of[n - many :]
    t, s = of[:many][inside], mix(whole[inside])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.cumsum(counts) - counts
        more = []
        for i in short:
            x = np.array([counts[i]], np.uint64)
            for k in range(counts[i]):
                x = x * _FACTORS[0] + mix(h[first[i] + k : first[i] + k + 1] ^ _FACTORS[(k + 1) % 8])
            more.append(mix(x))
        t, s = np.concatenate([t, short]), np.concatenate([s, *more])
    s = (s >> np.uint64(1)).astype(np.int64)
    by = np.lexsort((s, t))
    t, s = t[by], s[by]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
    return t[new], s[new]


def prefix_length(n, percent: int = PERCENT):
    return n - (percent * n + 99) // 100 + 1


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def sketches(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of docs (id, th, text): id, th, c1, c2 (hash of the set), n, low (how many shingles are of the low share) and
    tokens (these, and the next ones that the prefix needs)."""
    bound = BOUND << (63 - BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            k = b.num_rows
            t, s = shingle_sets(b.column("text").to_pylist(), size)
            n = np.bincount(t, minlength=k) if len(t) else np.zeros(k, np.int64)
            low = np.bincount(t[s < bound], minlength=k) if len(t) else np.zeros(k, np.int64)
            codes = []
            for salt in (1, 2):
                mixed = np.zeros(len(s) + 1, np.uint64)
                np.cumsum(mix(s.astype(np.uint64) * _FACTORS[salt]), out=mixed[1:])
                ends = np.cumsum(n)
                codes.append((mixed[ends] - mixed[ends - n]).view(np.int64))
            taken = np.maximum(low, np.minimum(n, prefix_length(n, percent)))
            place = np.arange(len(t)) - (np.cumsum(n) - n)[t]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(codes[0]), pa.array(codes[1]), pa.array(n.astype(np.int32)), pa.array(low.astype(np.int32)), _lists(s[place < taken[t]], taken)], names=["id", "th", "c1", "c2", "n", "low", "tokens"])

    return map_batches(docs, run, "id long, th long, c1 long, c2 long, n int, low int, tokens array<long>")


# -- the trie


class Trie:
    """Sets (sorted arrays of hashes) as a compressed prefix tree. Node k has the shingles d0 to d1 of the paths below it,
    the sets lo to hi (in the tree's order), and the set that ends at it, if any (term)."""

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(x) for x in sets], np.int64)
        self.vocabulary, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.rank = np.empty(len(count), np.int64)
        self.rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
        of = np.repeat(np.arange(len(sets)), size)
        ranks = np.sort(of * len(count) + self.rank[inverse]) - of * len(count)
        begin = np.cumsum(size) - size
        raw = ranks.astype(">u4").tobytes()
        self.order = sorted(range(len(sets)), key=lambda i: raw[4 * begin[i] : 4 * (begin[i] + size[i])])
        self.size, self.begin, self.ranks = size[self.order], begin[self.order], ranks
        self._grow()

    def _grow(self) -> None:
        depth, lo, hi, parent, term = [0], [0], [len(self.order)], [-1], [-1]
        open_ = [0]
        for i in range(len(self.order)):
            shared = self._common(i - 1, i) if i else 0
            while depth[open_[-1]] > shared:
                k = open_.pop()
                hi[k] = i
                if depth[open_[-1]] < shared:
                    for values, v in ((depth, shared), (lo, lo[k]), (hi, 0), (parent, -1), (term, -1)):
                        values.append(v)
                    open_.append(len(depth) - 1)
                parent[k] = open_[-1]
            for values, v in ((depth, int(self.size[i])), (lo, i), (hi, 0), (parent, -1), (term, i)):
                values.append(v)
            open_.append(len(depth) - 1)
        while len(open_) > 1:
            k = open_.pop()
            hi[k], parent[k] = len(self.order), open_[-1]
        self.d1, self.lo, self.hi, self.term, parent = (np.array(x, np.int64) for x in (depth, lo, hi, term, parent))
        self.d0 = np.where(parent >= 0, self.d1[parent], 0)
        self.least = np.array([self.size[a:b].min() for a, b in zip(self.lo, self.hi)])
        self.most = np.array([self.size[a:b].max() for a, b in zip(self.lo, self.hi)])
        self.children = np.argsort(parent, kind="stable")
        self.first = np.searchsorted(parent[self.children], np.arange(len(parent) + 1))

    def _common(self, i: int, j: int) -> int:
        m = int(min(self.size[i], self.size[j]))
        differ = self.ranks[self.begin[i] : self.begin[i] + m] != self.ranks[self.begin[j] : self.begin[j] + m]
        k = int(differ.argmax()) if m else 0
        return k if m and differ[k] else m

    def links(self, asks: np.ndarray, other: np.ndarray, percent: int, larger: bool) -> np.ndarray:
        """The sets (in the tree's order) that link with asks (sorted hashes) among those that other marks; with larger
        only those with as many shingles at least."""
        n = len(asks)
        at = np.searchsorted(self.vocabulary, asks)
        at[at == len(self.vocabulary)] = 0
        mine = np.sort(self.rank[at[self.vocabulary[at] == asks]])
        member = np.zeros(len(self.vocabulary), bool)
        member[mine] = True
        among = np.concatenate([[0], np.cumsum(other)])
        fewest = n if larger else 0
        found, nodes, overlap = [], np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(nodes):
            # children of all nodes that are left, with their parents' overlaps
            number = self.first[nodes + 1] - self.first[nodes]
            kids = self.children[np.repeat(self.first[nodes] - (np.cumsum(number) - number), number) + np.arange(number.sum())]
            overlap = np.repeat(overlap, number)
            open_ = (among[self.hi[kids]] > among[self.lo[kids]]) & (self.most[kids] >= fewest) & (100 * self.most[kids] >= percent * n) & (percent * self.least[kids] <= 100 * n)
            kids, overlap = kids[open_], overlap[open_]
            length = self.d1[kids] - self.d0[kids]
            begin = self.begin[self.lo[kids]] + self.d0[kids]
            hits = member[self.ranks[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())]]
            sums = np.concatenate([[0], np.cumsum(hits)])
            ends = np.cumsum(length)
            overlap = overlap + sums[ends] - sums[ends - length]
            term = self.term[kids]
            full = (term >= 0) & ((100 + percent) * overlap >= percent * (n + self.d1[kids])) & (self.d1[kids] >= fewest)
            found.append(term[full])
            last = self.ranks[self.begin[self.lo[kids]] + np.maximum(self.d1[kids] - 1, 0)]
            rest = len(mine) - np.searchsorted(mine, last, side="right")
            size = np.clip(self.d1[kids] + rest, np.maximum(self.least[kids], fewest), self.most[kids])
            may = (100 + percent) * (overlap + np.minimum(size - self.d1[kids], rest)) >= percent * (n + size)
            nodes, overlap = kids[may], overlap[may]
        out = np.concatenate(found)
        return out[other[out]]


def merging_links(asked: list[tuple], asking: list[tuple] | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (a, b) that connect all linked nodes of rows (node, component, set): between asking and asked rows, or among
    asked rows where asking is None. A link between nodes of one component, or that the others imply, is left out."""
    if len({c for _, c, _ in asked} | {c for _, c, _ in asking or []}) < 2:
        return []
    tree = Trie([s for *_, s in asked])
    node, comp = [asked[i][0] for i in tree.order], np.array([asked[i][1] for i in tree.order])
    rows = [asked[i] for i in tree.order] if asking is None else asking
    own = np.array([c for _, c, _ in rows])
    out = []
    for k, (a, _, s) in enumerate(rows):
        if (comp == own[k]).all():
            continue
        for j in tree.links(s, comp != own[k], percent, asking is None):
            if comp[j] == own[k]:
                continue
            old = comp[j]
            out.append((min(a, node[j]), max(a, node[j])))
            comp[comp == old] = own[k]
            own[own == old] = own[k]
    return out


# -- counting


def _bytes_of(values: np.ndarray) -> bytes:
    """Integers from 0 on, in as many bytes each as the largest needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _values_of(packed: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8).reshape(n, -1)
    out = np.zeros((n, 8), np.uint8)
    out[:, : raw.shape[1]] = raw
    return out.view("<u8").ravel().astype(np.int64)


def _packer(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (node, tokens) to rows of ranges of width: part, base (of the nodes), n, tokens and nodes (packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, tokens = [], []

        def flush() -> pa.RecordBatch:
            node, token = np.concatenate(nodes), np.concatenate(tokens)
            by = np.argsort(token, kind="stable")
            node, token, base = node[by], token[by], int(node.min())
            part = token // width
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            ends = np.append(at[1:], len(token))
            gaps = [_bytes_of(np.diff(token[i:j], prepend=part[i] * width)) for i, j in zip(at, ends)]
            whose = [_bytes_of(node[i:j] - base) for i, j in zip(at, ends)]
            nodes.clear()
            tokens.clear()
            return pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array(np.full(len(at), base)), pa.array(ends - at), pa.array(gaps, pa.binary()), pa.array(whose, pa.binary())], names=["part", "base", "n", "tokens", "nodes"])

        for b in batches:
            at = b.column("tokens").offsets.to_numpy()
            tokens.append(b.column("tokens").values.to_numpy()[at[0] : at[-1]] >> (63 - BITS))
            nodes.append(np.repeat(b.column("node").to_numpy(), np.diff(at)))
            if sum(map(len, tokens)) > PACKED:
                yield flush()
        if sum(map(len, tokens)):
            yield flush()

    return run


def _counter(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows of _packer, sorted by part, to node, token and df of the tokens that are there more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        for part, packed in groupby(rows, lambda r: r[0]):
            tokens, nodes = [], []
            for _, base, n, gaps, whose in packed:
                tokens.append(part * width + np.cumsum(_values_of(gaps, n)))
                nodes.append(base + _values_of(whose, n))
            token, node = np.concatenate(tokens), np.concatenate(nodes)
            del tokens, nodes
            by = np.argsort(token, kind="stable")
            token, node = token[by], node[by]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            df = np.diff(np.append(first, len(token)))
            df = np.repeat(df, df)
            some = np.flatnonzero(df > 1)
            for i in range(0, len(some), 1 << 16):
                k = some[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(node[k]), pa.array(token[k]), pa.array(df[k])], names=["node", "token", "df"])

    return run


def _shared(reps: DataFrame) -> DataFrame:
    """node, token (its first BITS bits) and df of the tokens that are in the table more than once; reps: node, low, tokens."""
    n = parts(reps.sparkSession)
    total = reps.agg(F.coalesce(F.sum("low"), F.lit(0))).first()[0]
    width = BOUND // max(n, total // RANGE + 1) + 1
    packed = map_batches(reps.select("node", "tokens"), _packer(width), "part long, base long, n long, tokens binary, nodes binary")
    return map_batches(packed.repartition(n, "part").sortWithinPartitions("part"), _counter(width), "node long, token long, df long")


# -- groups and lots


def _groups(reps: DataFrame, percent: int) -> DataFrame:
    """Members (gid, node, n, size, total) of the groups of nodes that share a prefix shingle; reps: node, n, low, tokens."""
    high = F.when(F.col("token") < BOUND, F.col("df")).otherwise(F.lit(2**62))  # high ones after all others, by hash
    listed = _shared(reps).groupBy("node").agg(F.array_sort(F.collect_list(F.struct(high.alias("df"), "token"))).alias("have"))
    sized = listed.join(reps.select("node", "n", "low"), "node")
    alone = F.col("low") - F.size(F.filter("have", lambda x: x["token"] < BOUND))  # of the low share, and of one node only: first in order
    length = F.col("n") - F.floor((F.col("n") * percent + 99) / 100).cast("int") + 1
    take = F.when(F.col("low") < length, F.size("have")).otherwise(F.greatest(F.lit(0), length - alone)).cast("int")
    prefixes = cut(sized.select("node", "n", F.explode(F.array_distinct(F.slice("have", F.lit(1), take))).alias("x")).select(F.col("x.token").alias("token"), "node", "n"), "prefixes")
    groups = prefixes.groupBy("token").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("size > 1")
    groups = cut(groups.groupBy("size", "total", "x", "y").agg(F.min("token").alias("token")).select("token", "size", "total"), "groups")
    return cut(prefixes.join(groups, "token").select(F.col("token").alias("gid"), "node", "n", "size", "total"), "members")


def _clusters(members: DataFrame) -> DataFrame:
    """node, n, cluster and whole (if the cluster is one lot) of all nodes of members."""
    lowest = members.groupBy("gid").agg(F.min("node").alias("a"))
    star = members.join(cut(lowest, "lowest"), "gid").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    of = cut(components(star).select(F.col("id").alias("node"), F.col("comp").alias("cluster")), "clusters")
    sized = of.join(members.select("node", "n").distinct(), "node")
    totals = cut(sized.groupBy("cluster").agg((F.sum("n") <= WHOLE).alias("whole")), "totals")
    return cut(sized.join(totals, "cluster").select("node", "n", "cluster", "whole"), "clusters")


def _first_lots(members: DataFrame) -> DataFrame:
    """Rows (gid, zone, bx, by, asks, node, comp) of the lots in which each node is in its largest group, with that group's leader."""
    mine = members.groupBy("node").agg(F.max(F.struct("size", "gid"))["gid"].alias("gid"), F.first("n").alias("n"), F.sum("size").alias("company"))
    mine = cut(mine, "mine")
    leaders = members.join(mine.select("node", "company"), "node").groupBy("gid").agg(F.max(F.struct("company", F.xxhash64("node").alias("o"), "node"))["node"].alias("leader"))
    sums = mine.groupBy("gid").agg(F.count("*").alias("rows"), F.ceil(F.sum("n") / LOT).cast("int").alias("lots")).join(leaders, "gid")
    sums = cut(sums, "lots")
    rows = mine.join(sums.select("gid", "lots"), "gid").select("gid", F.pmod(F.xxhash64("node"), F.col("lots")).cast("int").alias("bx"), "node")
    led = sums.select("gid", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("bx"), F.col("leader").alias("node"))
    return rows.union(led).distinct().select("gid", F.lit(0).cast("long").alias("zone"), "bx", F.lit(0).alias("by"), F.lit(False).alias("asks"), "node", F.col("node").alias("comp"))


def _zones(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (cluster, gid, node, n, comp) those of groups that aren't one component, with main (the largest one) and band
    (of sizes); and the bands to compare (cluster, gid, zone): x blocks that ask, y that are asked, shingles that travel."""
    # a little wider than the sizes of two sets that link may differ, so that rounding can't put them two bands apart
    width = max(math.log(100 / percent), 1e-4) * (1 + 1e-9)
    by_comp = rows.groupBy("gid", "comp").agg(F.sum("n").alias("k"))
    mixed = by_comp.groupBy("gid").agg(F.count("*").alias("comps"), F.max(F.struct("k", "comp"))["comp"].alias("main")).where("comps > 1")
    rows = cut(rows.join(mixed.select("gid", "main"), "gid").withColumn("band", F.floor(F.log("n") / width)), "rows")
    zones = _near(rows).groupBy("cluster", "gid", "zone").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.sum(F.when(F.col("comp") != F.col("main"), F.col("n"))).alias("asking"), F.sum(F.when(F.col("zone") == F.col("band"), F.col("n"))).alias("asked"))
    zones = zones.where("least <> most AND asking > 0 AND asked > 0")
    x, y = F.ceil(F.col("asking") / ASKING).cast("int").alias("x"), F.ceil(F.col("asked") / ASKED).cast("int").alias("y")
    return rows, cut(zones.select("cluster", "gid", "zone", x, y, (F.col("asking") * y + F.col("asked") * x).cast("double").alias("travels")), "zones")


def _near(rows: DataFrame) -> DataFrame:
    return rows.withColumn("zone", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])))


def _blocks(rows: DataFrame, zones: DataFrame) -> DataFrame:
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    zones = zones.select("gid", "zone", "x", "y")
    asking = _near(rows.where("comp <> main")).join(zones, ["gid", "zone"]).select("gid", "zone", F.pmod(F.xxhash64("node"), F.col("x")).cast("int").alias("bx"), spread("y").alias("by"), F.lit(True).alias("asks"), "node", "comp")
    asked = rows.withColumnRenamed("band", "zone").join(zones, ["gid", "zone"]).select("gid", "zone", spread("x").alias("bx"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("y")).cast("int").alias("by"), F.lit(False).alias("asks"), "node", "comp")
    return asking.union(asked)


def _open_lots(members: DataFrame, clusters: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Rows (gid, zone, bx, by, asks, node, comp) of the blocks of the groups whose nodes aren't one component, or of a whole
    cluster (gid below 0) where this makes fewer shingles travel; clusters: node, n, cluster. zone is a band of sizes, whose
    nodes are asked by those of this and the neighbouring bands."""
    got = clusters.join(labels.select(F.col("id").alias("node"), "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    got = cut(got.select("node", "n", "cluster", "comp"), "got")
    by_group, group_zones = _zones(members.select("gid", "node").join(got, "node").select("cluster", "gid", "node", "n", "comp"), percent)
    by_cluster, cluster_zones = _zones(got.select("cluster", (-1 - F.col("cluster")).alias("gid"), "node", "n", "comp"), percent)
    sums = [z.groupBy("cluster").agg(F.sum("travels").alias(name)) for z, name in ((group_zones, "g"), (cluster_zones, "c"))]
    whole = cut(sums[0].join(sums[1], "cluster").where("c < g").select("cluster"), "whole")
    parts_of = [_blocks(by_group, group_zones.join(whole, "cluster", "left_anti")), _blocks(by_cluster, cluster_zones.join(whole, "cluster", "left_semi"))]
    return parts_of[0].union(parts_of[1])


def _joined(lots: DataFrame, docs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) of all lots; docs: id, th, text; rows: node, id, th."""
    spark = docs.sparkSession
    wanted = cut(lots.join(rows, "node").select("gid", "zone", "bx", "by", "asks", "node", "comp", F.col("id").alias("_id"), F.col("th").alias("_th")), "wanted")
    small = wanted.count() <= BROADCAST_IDS
    found = docs.join(F.broadcast(wanted) if small else wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("gid", "zone", "bx", "by", "asks", "node", "comp", "text")

    def joins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of() -> Iterator[tuple]:
            for b in chunks(batches, "text"):
                t, s = shingle_sets(b.column("text").to_pylist(), size)
                at = np.searchsorted(t, np.arange(b.num_rows + 1))
                for k, r in enumerate(zip(*[c.to_pylist() for c in b.columns[:7]])):
                    yield (*r, s[at[k] : at[k + 1]].copy())

        for _, lot in groupby(rows_of(), lambda r: r[:4]):
            asked, asking = {}, {}
            for *_, asks, node, comp, s in lot:  # rows that share id and text come once
                (asking if asks else asked)[node] = (node, comp, s)
            got = merging_links([*asked.values()], [*asking.values()] or None, percent)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)], names=["a", "b"])

    dealt = found.repartition(parts(spark), "gid", "zone", "bx", "by").sortWithinPartitions("gid", "zone", "bx", "by")
    return cut(map_batches(dealt, joins, "a long, b long"), "links")


def _firsts(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of nodes. Up to BROADCAST_IDS nodes, or rows that aren't nodes, are broadcast, so that no tokens travel."""
    n = nodes.count()
    if n <= BROADCAST_IDS:
        return rows.join(F.broadcast(nodes), "node", "left_semi")
    if rows.count() - n <= BROADCAST_IDS:
        return rows.join(F.broadcast(cut(rows.select("node").join(nodes, "node", "left_anti"), "copies")), "node", "left_anti")
    return rows.join(nodes, "node", "left_semi")


def linked(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id of each row of docs."""
    text = text_or_empty(text_col)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    sketched = cut(sketches(docs, size, percent).withColumn("node", F.monotonically_increasing_id()), "sketches")
    named = F.min(F.struct("node", "id", "th")).alias("named")
    reps = sketched.where("n > 0").groupBy("c1", "c2").agg(named, F.min("id").alias("first"), F.count("*").alias("copies"))
    reps = cut(reps.select("c1", "c2", "named.node", "named.id", "named.th", "first", "copies"), "nodes")
    members = _groups(_firsts(sketched.where("n > 0").select("node", "n", "low", "tokens"), reps.select("node")), percent)
    rows = reps.select("node", "id", "th")
    clusters = _clusters(members)
    lots = clusters.where("whole").select((-1 - F.col("cluster")).alias("gid"), F.lit(0).cast("long").alias("zone"), F.lit(0).alias("bx"), F.lit(0).alias("by"), F.lit(False).alias("asks"), "node", F.col("node").alias("comp"))
    large = clusters.where("NOT whole")
    more = not large.isEmpty()
    if more:
        members = cut(members.join(large.select("node"), "node", "left_semi"), "large")
        lots = lots.union(_first_lots(members))
    links = _joined(lots, docs, rows, size, percent)
    labels = components(links)
    if more:
        undecided = cut(_open_lots(members, large, labels, percent), "open")
        if not undecided.isEmpty():
            labels = components(links.union(_joined(undecided, docs, rows, size, percent)))
    by_link = reps.select("c1", "c2", "node", "first").join(labels.select(F.col("id").alias("node"), "comp"), "node")
    firsts = by_link.groupBy("comp").agg(F.min("first").alias("low_id"))
    by_link = by_link.join(firsts, "comp").select("c1", "c2", "low_id")
    alone = reps.where("copies > 1").join(labels, reps["node"] == labels["id"], "left_anti").select("c1", "c2", F.col("first").alias("low_id"))
    named = cut(by_link.union(alone).withColumn("shared", F.lit(True)), "classes")
    out = sketched.select("id", "c1", "c2", "n").join(named, ["c1", "c2"], "left")
    return out.select("id", F.col("n").cast("long").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("shared"), F.col("low_id")).otherwise(F.col("id")).alias("component_id"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linked(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SIZE} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {SIZE} + 2), lambda i: array_to_string(w[i : i + {SIZE - 1}], ' ')) END) AS s FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT x AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(y) AS component_id FROM r LEFT JOIN n ON n.doc_id = x GROUP BY x
"""

QUERIES = {"op11_ngram_join": op11_ngram_join}
ORACLES = {"op11_ngram_join": SQL}
