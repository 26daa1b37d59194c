"""Sharding by vector bin packing.

A document is a vector of bytes, tokens (words between white space) and rows. Equal texts form a group that goes to one
shard as a whole; only a group with more bytes than a balanced shard, which none can hold, is cut into equal pieces of
documents. The law that holds is `bytes`.

Groups of more than 1 / FINE of a shard's bytes, of which there are fewer than FINE x shards, are placed first, all
together: the largest first, each where the dot product of its vector with the capacity left is highest. What the
shards then hold is summed up. The other groups are dealt by hash over partitions, and each partition places its own in
the same way into its part of the capacity left, so no task sees more than its partition.

Slots count on from the documents that earlier partitions put into the shard: a table of partitions x shards.

Defined cases: a null text has no bytes and size 16; rows with one doc_id are placed each for itself; groups of equal
size are placed in order of their hash, and ties of shards go to another shard first in each partition; a text of any
length is one document; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_RE, cut, hash128, map_batches, parts, table, text_or_empty

SHARDS = 40
#: Rows of a shard that a partition places, on average: many enough to make up for a few large documents.
LOT_ROWS = 500
FINE = 64
#: Of bytes, tokens and rows in the dot product; the law is on bytes.
WEIGHTS = (4.0, 1.0, 1.0)


def vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, tokens, the group's hash (h1, h2) and a number of each document's own (row)."""
    text = text_or_empty(text_col)
    words = F.size(F.split(text, SPACE_RE))
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        words.cast("long").alias("tokens"),
        *hash128(text),
        F.monotonically_increasing_id().alias("row"),
    )


class Capacity:
    """What the shards have left: an array of shards x (bytes, tokens, rows)."""

    def __init__(self, left: np.ndarray, total: np.ndarray, turn: int = 0):
        self.left, self.turn = left.astype(float), turn
        self.scale = np.where(total > 0, 1 / np.maximum(total, 1e-9), 0) * np.sqrt(WEIGHTS)

    def best(self, vector: np.ndarray) -> int:
        score = (self.left * self.scale) @ (vector * self.scale)
        return (int(np.roll(score, -self.turn).argmax()) + self.turn) % len(self.left)

    def take(self, shard: int, vector: np.ndarray) -> None:
        self.left[shard] -= vector


def _place_large(groups: list[tuple], shards: int, total: np.ndarray) -> list[tuple]:
    """(h1, h2, shards of its pieces) of each large group (h1, h2, bytes, tokens, rows)."""
    room = Capacity(np.tile(total / shards, (shards, 1)), total)
    out = []
    for h1, h2, *v in sorted(groups, key=lambda g: (-g[2], g[0], g[1])):
        pieces = min(int(v[2]), max(1, -int(-v[0] * shards // total[0])))
        part, at = np.array(v, float) / pieces, []
        for _ in range(pieces):
            at.append(room.best(part))
            room.take(at[-1], part)
        out.append((h1, h2, at))
    return out


def _numbered(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Rows of a partition with their slot among those of their shard."""
    counts = np.zeros(shards, np.int64)
    for b in batches:
        s = b.column("shard").to_numpy()
        order = np.argsort(s, kind="stable")
        here = np.bincount(s, minlength=shards)
        slot = np.empty(len(s), np.int64)
        slot[order] = np.arange(len(s)) - np.repeat(np.cumsum(here) - here, here) + np.repeat(counts, here)
        counts += here
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(slot)], names=[*b.schema.names, "slot"])


def _pack(batches: Iterator[pa.RecordBatch], left: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a partition in order of their groups, with shard and slot; left: capacities of this partition."""
    counts = np.zeros(len(left), np.int64)
    room, key, at = None, None, 0
    for b in batches:
        col = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "size", "tokens", "rows")}
        shard, slot = np.empty(b.num_rows, np.int32), np.empty(b.num_rows, np.int64)
        for i in range(b.num_rows):
            k = (col["h1"][i], col["h2"][i])
            v = np.array([col["size"][i], col["tokens"][i], 1.0])
            if room is None:
                room = Capacity(left, total, int(k[0]) % len(left))
            if k != key:
                key, at = k, room.best(v * col["rows"][i])
            room.take(at, v)
            shard[i], slot[i] = at, counts[at]
            counts[at] += 1
        yield pa.RecordBatch.from_arrays([b.column(c) for c in _KEPT] + [pa.array(shard), pa.array(slot)], names=[*_KEPT, "shard", "slot"])


_KEPT = ["id", "size", "text_crc32", "tokens", "part"]
_PLACED = "id long, size long, text_crc32 long, tokens long, part int, shard int, slot long"


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot of each document."""
    spark = docs.sparkSession
    v = cut(vectors(docs, id_col, text_col), "vectors")
    whole = v.agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    total = np.array([int(x or 0) for x in whole], float)
    n = int(total[2])
    lots = max(1, min(parts(spark), n // (shards * LOT_ROWS) + 1))

    groups = v.groupBy("h1", "h2").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n"))
    found = [tuple(r) for r in groups.where(F.col("b") > total[0] / shards / FINE).collect()]  # fewer than FINE x shards
    large = F.broadcast(spark.createDataFrame(_place_large(found, shards, total), "h1 long, h2 long, shards array<int>"))
    one = F.get("shards", F.pmod(F.xxhash64("row"), F.size("shards")).cast("int"))
    theirs = v.join(large, ["h1", "h2"]).select("id", "size", "text_crc32", "tokens", (F.spark_partition_id() + lots).alias("part"), one.alias("shard"))
    first = cut(map_batches(theirs, lambda it: _numbered(it, shards), _PLACED), "large")
    left = np.tile(total / shards, (shards, 1))
    for r in first.groupBy("shard").agg(F.sum("size"), F.sum("tokens"), F.count("*")).collect():  # a row a shard
        left[r[0]] -= r[1:]
    left /= lots

    rest = v.join(large, ["h1", "h2"], "left_anti").repartition(lots, "h1", "h2")
    dealt = (
        rest.withColumn("rows", F.count("*").over(Window.partitionBy("h1", "h2"))).withColumn("part", F.spark_partition_id())
        .sortWithinPartitions((F.col("size") * F.col("rows")).desc(), "h1", "h2", "row").drop("row")
    )
    second = cut(map_batches(dealt, lambda it: _pack(it, left, total / lots), _PLACED), "rest")
    placed = first.unionByName(second)
    before = placed.groupBy("part", "shard").agg(F.count("*").alias("here"))  # a row for each partition and shard
    w = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = before.select(F.col("part").alias("p"), F.col("shard").alias("s"), F.coalesce(F.sum("here").over(w), F.lit(0)).alias("base"))
    return placed.join(offsets, (F.col("part") == F.col("p")) & (F.col("shard") == F.col("s"))).select(
        "id", "size", "text_crc32", "shard", (F.col("base") + F.col("slot")).cast("long").alias("slot")
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op5_sharding": op5_sharding}
ORACLES: dict[str, str] = {}
