"""Pairing of mates. Candidates and alignments carry fragment, mate (1, 2), contig, start/pos, ...

Mates meet in equi-joins on (fragment, contig); a fragment has a bounded number of candidates (see mapping)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import batches, scores

MIN_DISTANCE, MAX_DISTANCE = 200, 800


def region_distance(variant: str = "pair") -> Column:
    """Distance of regions 1 and 2 (start1, end1, start2, end2)."""
    after = F.expr("start2 > end1") if variant == "pair" else F.expr("start1 <= end2")
    return F.when(after, F.expr("end2 - start1 + 1")).otherwise(F.expr("end1 - start2 + 1"))


def alignment_distance() -> Column:
    return F.when(F.expr("pos2 > pos1"), F.expr("pos2 + len2 - pos1")).otherwise(F.expr("pos1 + len1 - pos2"))


def template_length() -> tuple[Column, Column]:
    """TLEN of mates 1 and 2."""
    first = F.when(F.expr("pos1 > pos2"), F.expr("pos2 - (pos1 + len1)")).otherwise(F.expr("pos2 + len2 - pos1"))
    second = F.when(F.expr("pos1 > pos2"), F.expr("pos1 + len1 - pos2")).otherwise(F.expr("pos1 - (pos2 + len2)"))
    return first, second


def _mates(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows of mate 1 joined with those of mate 2 on fragment and contig; columns: name -> prefix of the new names."""
    side = lambda m: rows.where(F.col("mate") == m).select("fragment", "contig", *[F.col(c).alias(f"{p}{m}") for c, p in columns.items()])
    return side(1).join(side(2), ["fragment", "contig"])


def valid_pairs(regions: DataFrame, low: int = MIN_DISTANCE, high: int = MAX_DISTANCE) -> DataFrame:
    """Pairs of regions (fragment, mate, contig, id, start, end) within the distance."""
    return _mates(regions, {"id": "id", "start": "start", "end": "end"}).withColumn("distance", region_distance()).where(F.col("distance").between(low, high))


def filter_by_pairs(regions: DataFrame, low: int = MIN_DISTANCE, high: int = MAX_DISTANCE) -> DataFrame:
    """Of fragments with a valid pair only members of valid pairs, of others everything."""
    pairs = valid_pairs(regions, low, high)
    members = pairs.select("fragment", F.explode(F.array(F.struct(F.lit(1).alias("mate"), F.col("id1").alias("id")), F.struct(F.lit(2).alias("mate"), F.col("id2").alias("id")))).alias("m")).select("fragment", "m.mate", "m.id").distinct().withColumn("_in", F.lit(1))
    marked = regions.join(members, ["fragment", "mate", "id"], "left")
    some = F.max("_in").over(Window.partitionBy("fragment"))
    return marked.withColumn("_some", some).where("_in = 1 OR _some IS NULL").drop("_in", "_some")


def insert_size(regions: DataFrame, spread: int = 300, far: int = 10_000, least: int = 10) -> DataFrame:
    """One row low, high: the upper median distance of fragments with one region a mate, minus and plus spread; 200 and
    800 with too few. The median is the exact one, by rank, over all fragments."""
    n = F.count("*").over(Window.partitionBy("fragment", "mate"))
    alone = _mates(regions.withColumn("_n", n).where("_n = 1"), {"start": "start", "end": "end"}).withColumn("distance", region_distance()).where(F.col("distance") < far)
    # distances are below far, so a table of counts by distance is bounded
    counts = alone.groupBy("distance").agg(F.count("*").alias("k"))
    w = Window.orderBy("distance").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("k").over(w)).withColumn("all", F.sum("k").over(Window.partitionBy()))
    middle = ranked.where(F.col("upto") > F.floor(F.col("all") * 0.5)).agg(F.min("distance").alias("median"), F.max("all").alias("n"))
    enough = F.coalesce(F.col("n"), F.lit(0)) > least
    return middle.select(F.when(enough, F.greatest(F.col("median") - spread, F.lit(1))).otherwise(MIN_DISTANCE).cast("long").alias("low"), F.when(enough, F.col("median") + spread).otherwise(MAX_DISTANCE).cast("long").alias("high"))


def enumerate_pairs(alignments: DataFrame, low: int = MIN_DISTANCE, high: int = MAX_DISTANCE) -> DataFrame:
    """All pairs of alignments (fragment, mate, contig, id, pos, len, mapq) within the distance, with score (mean mapq)
    and rank; of pairs with equal scores and ids the nearer one comes first."""
    more = {c: c for c in ("strand", "points") if c in alignments.columns}
    pairs = _mates(alignments, {"id": "id", "pos": "pos", "len": "len", "mapq": "mapq"} | more).withColumn("distance", alignment_distance()).where(F.col("distance").between(low, high))
    w = Window.partitionBy("fragment").orderBy(F.desc("score"), "id1", "id2", "distance")
    return pairs.withColumn("score", 0.5 * (F.col("mapq1") + F.col("mapq2"))).withColumn("rank", F.row_number().over(w))


def greedy_pairs(pairs: DataFrame, most: int = 10_000) -> DataFrame:
    """Pairs in order of rank, each if neither member is taken. Rows are dealt and sorted by fragment; a task goes through
    its batches once."""
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)

    def take(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, group in batches.whole_groups(it, ["fragment"]):
            keep, last, one, two, n = [], -1, set(), set(), 0
            for i, (g, x, y) in enumerate(zip(group.tolist(), b.column("id1").to_pylist(), b.column("id2").to_pylist())):
                if g != last:
                    last, one, two, n = g, set(), set(), 0
                if n < most and x not in one and y not in two:
                    one.add(x)
                    two.add(y)
                    n += 1
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    return pairs.repartition("fragment").sortWithinPartitions("fragment", "rank").mapInArrow(take, ddl)


def rescue_quality(pairs: DataFrame) -> DataFrame:
    """A fragment's only best pair: a mate of quality 0 takes the other's."""
    n = F.count("*").over(Window.partitionBy("fragment", "score"))
    only = (F.col("rank") == 1) & (F.col("_n") == 1)
    new = lambda a, b: F.when(only & (F.col(a) == 0), F.col(b)).otherwise(F.col(a))
    out = pairs.withColumn("_n", n).withColumn("_1", new("mapq1", "mapq2")).withColumn("_2", new("mapq2", "mapq1"))
    return out.withColumn("mapq1", F.col("_1")).withColumn("mapq2", F.col("_2")).drop("_n", "_1", "_2")


def paired_rows(pairs: DataFrame) -> DataFrame:
    """Both mates' rows of each pair: fragment, mate, contig, id, pos, mapq, mpos, tlen."""
    t1, t2 = template_length()
    row = lambda m, o, t: F.struct(F.lit(m).alias("mate"), F.col(f"id{m}").alias("id"), F.col(f"pos{m}").alias("pos"), F.col(f"mapq{m}").alias("mapq"), F.col(f"pos{o}").alias("mpos"), t.alias("tlen"))
    return pairs.select("fragment", "contig", F.explode(F.array(row(1, 2, t1), row(2, 1, t2))).alias("r")).select("fragment", "contig", "r.*")


def report(alignments: DataFrame, best: bool = False, n_best: int = 0, n_hits: int = 0, every: bool = False) -> DataFrame:
    """Alignments (read_id, map_quality, arrival) by mode: best, else n_best, else n_hits, else all; best is the
    default. A row secondary becomes primary if the read's primary one is gone."""
    by_quality = Window.partitionBy("read_id").orderBy(F.desc("map_quality"), "arrival")
    by_arrival = Window.partitionBy("read_id").orderBy("arrival")
    if best or not (n_best or n_hits or every):
        out = alignments.withColumn("_r", F.rank().over(Window.partitionBy("read_id").orderBy(F.desc("map_quality")))).where("_r = 1")
    elif n_best:
        out = alignments.withColumn("_r", F.row_number().over(by_quality)).where(F.col("_r") <= n_best)
    elif n_hits:
        out = alignments.withColumn("_r", F.row_number().over(by_arrival)).where(F.col("_r") <= n_hits)
    else:
        out = alignments.withColumn("_r", F.lit(1))
    first = F.row_number().over(by_quality if n_best else by_arrival) == 1
    return out.drop("_r").withColumn("primary", first)


def mispaired(alignments: DataFrame) -> DataFrame:
    """Fragments mapped at both ends without a proper pair: quality by the number of hits, mate columns from the first
    alignment (by id, contig and pos) of the other end."""
    w = Window.partitionBy("fragment", "mate")
    first = alignments.groupBy("fragment", "mate").agg(F.min(F.struct("id", "contig", "pos")).alias("_m")).select("fragment", (3 - F.col("mate")).alias("mate"), F.col("_m.contig").alias("mcontig"), F.col("_m.pos").alias("mpos"))
    counted = alignments.withColumn("map_quality", scores.mispaired_quality(F.count("*").over(w)))
    return counted.join(first, ["fragment", "mate"], "left")


def fallback(alignments: DataFrame, pairs: DataFrame, only_paired: bool = False) -> DataFrame:
    """Alignments of fragments without a pair: none if only pairs are reported, else as mispaired."""
    left = alignments.join(pairs.select("fragment").distinct(), "fragment", "left_anti")
    out = mispaired(left)
    return out.where(F.lit(False)) if only_paired else out


def check_pairs(regions: DataFrame, low: int = MIN_DISTANCE, high: int = MAX_DISTANCE) -> DataFrame:
    """A row for each fragment: status none, one (the mapped mate) or both, and of fragments with both the pair with
    the largest common read_area. cleared: both ends have several regions and no pair is valid."""
    n = regions.groupBy("fragment").agg(F.count_if(F.col("mate") == 1).alias("n1"), F.count_if(F.col("mate") == 2).alias("n2"))
    pairs = _mates(regions, {"id": "id", "start": "start", "end": "end", "read_area": "area"}).withColumn("distance", region_distance()).where(F.col("distance").between(low, high))
    best = pairs.groupBy("fragment").agg(F.max_by(F.struct("id1", "id2"), F.struct(F.col("area1") + F.col("area2"), -F.col("id1"), -F.col("id2"))).alias("b"))
    joined = n.join(best, "fragment", "left")
    status = F.when((F.col("n1") > 0) & (F.col("n2") > 0), "both").when(F.col("n1") + F.col("n2") > 0, "one").otherwise("none")
    cleared = (F.col("n1") > 1) & (F.col("n2") > 1) & F.col("b").isNull()
    return joined.select("fragment", "n1", "n2", status.alias("status"), F.col("b.id1").alias("id1"), F.col("b.id2").alias("id2"), cleared.alias("cleared"))


def rescue_window(anchors: DataFrame, high: int = MAX_DISTANCE) -> DataFrame:
    """Where the missing mate may be: opposite strand, within high and a read's length of the anchor."""
    return anchors.select("fragment", "contig", (1 - F.col("strand")).alias("strand"), F.greatest(F.col("start") - high - F.col("length"), F.lit(0)).alias("r_start"), (F.col("end") + high + F.col("length")).alias("r_end"))


def rescue_hits(hits: DataFrame, anchors: DataFrame, high: int = MAX_DISTANCE) -> DataFrame:
    """Seed hits (fragment, strand, contig, pos, ...) of missing mates inside their windows."""
    return hits.join(rescue_window(anchors, high), ["fragment", "contig", "strand"]).where("pos >= r_start AND pos < r_end").drop("r_start", "r_end")


def anchor_pairs(anchors: DataFrame, far: int = 500_000, least: int = 25, alone: int = 40) -> DataFrame:
    """Forward and backward anchors (read_id, strand, contig, dir F/B, start, end) at most far apart, the longest pair
    of each read; single anchors longer than alone where no pair is."""
    long = anchors.withColumn("size", F.col("end") - F.col("start") + 1).where(F.col("size") >= least)
    f = long.where("dir = 'F'").select("read_id", "strand", "contig", F.col("start").alias("start1"), F.col("end").alias("end1"), F.col("size").alias("size1"))
    b = long.where("dir = 'B'").select("read_id", "strand", "contig", F.col("start").alias("start2"), F.col("end").alias("end2"), F.col("size").alias("size2"))
    pairs = f.join(b, ["read_id", "strand", "contig"]).where((F.col("start2") >= F.col("start1")) & (F.col("start2") - F.col("end1") <= far))
    w = Window.partitionBy("read_id").orderBy(F.desc(F.col("size1") + F.col("size2")), "contig", "strand", "start1", "start2")
    best = pairs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    single = long.where(F.col("size") > alone).join(best.select("read_id"), "read_id", "left_anti")
    one = single.withColumn("_r", F.row_number().over(Window.partitionBy("read_id").orderBy(F.desc("size"), "contig", "strand", "start"))).where("_r = 1")
    return best.unionByName(one.select("read_id", "strand", "contig", F.col("start").alias("start1"), F.col("end").alias("end1"), F.col("size").alias("size1")), allowMissingColumns=True)
