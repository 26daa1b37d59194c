"""Interval operators: merging, overlap and containment joins, depth and coverage.

Overlap joins are equi-joins on (keys, bucket) with a residual test, so they shuffle by bucket instead of comparing all
pairs; merging and depth are window sums. A hot contig is cut into tiles, of which only one number each is passed on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1 << 10


def islands(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", distance: Column | int = 0, out: str = "island") -> DataFrame:
    """df with the number of its merged interval: a row joins if start <= the furthest end so far + distance."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    d = F.lit(distance) if isinstance(distance, int) else distance
    fresh = F.when(before.isNull() | (F.col(start) > before + d), 1).otherwise(0)
    return df.withColumn("_fresh", fresh).withColumn(out, F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def tile_islands(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", distance: Column | int = 0, out: str = "island", tile: int = 1 << 16) -> DataFrame:
    """islands for keys with many rows, such as contigs: windows run over the rows of a tile, and over a table of a row
    for each tile, which tells how far earlier tiles reach and how many islands begin there."""
    names = [*keys, "_tile"]
    rows = df.withColumn("_tile", F.floor(F.col(start) / tile))
    before = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(*names).orderBy(start, end)

    def with_earlier(rows: DataFrame, of_tile: Column, earlier: Column, name: str) -> DataFrame:
        tiles = rows.groupBy(*names).agg(of_tile.alias("_x")).withColumn(name, earlier)
        tiles = tiles.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(names)], name)
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(names)]
        return rows.join(tiles, same).drop(*[f"_k{i}" for i in range(len(names))])

    d = F.lit(distance) if isinstance(distance, int) else distance
    far = with_earlier(rows, F.max(end), F.max("_x").over(before), "_far")
    reach = F.greatest("_far", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)))  # the one that isn't null
    fresh = far.withColumn("_reach", reach).withColumn("_fresh", F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + d), 1).otherwise(0))
    counted = with_earlier(fresh, F.sum("_fresh"), F.coalesce(F.sum("_x").over(before), F.lit(0)), "_past")
    number = F.col("_past") + F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn(out, number).drop("_tile", "_far", "_reach", "_fresh", "_past")


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", distance: Column | int = 0, aggregates: Sequence[Column] = ()) -> DataFrame:
    """keys, start, end, n and aggregates of the merged intervals."""
    own = [F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"), *aggregates]
    return tile_islands(df, keys, start, end, distance).groupBy(*keys, "island").agg(*own).drop("island")


def tiled(df: DataFrame, start: str, end: str, bucket: int, out: str = "tile") -> DataFrame:
    """A row for each tile of width bucket that [start, end] touches."""
    first, last = (F.floor(F.col(x) / bucket) for x in (start, end))
    return df.withColumn(out, F.explode(F.sequence(first, F.greatest(first, last))))


def _by_span(rows: DataFrame, hit: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Rows whose keys, start and end are among those of hit, or not (left_anti). The values decide: row numbers would differ
    between the two computations of rows wherever a shuffle comes before."""
    names = [*keys, "start", "end"]
    found = hit.select(*names).distinct()
    return rows.join(found, names, how).select(*rows.columns)


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], bucket: int = BUCKET, how: str = "inner") -> DataFrame:
    """Rows of left with start, end and rows of right with r_start, r_end that overlap (ends included), each pair once.

    how: inner, left_semi or left_anti. left must not have a column tile."""
    l, r = tiled(left, "start", "end", bucket), tiled(right, "r_start", "r_end", bucket)
    touch = (F.col("start") <= F.col("r_end")) & (F.col("end") >= F.col("r_start"))
    if how == "inner":
        once = F.col("tile") == F.floor(F.greatest("start", "r_start") / bucket)  # the pair's first common tile
        return l.join(r, [*keys, "tile"]).where(touch & once).drop("tile")
    spans = left.select(*keys, "start", "end").distinct()
    return _by_span(left, overlap_join(spans, right.select(*keys, "r_start", "r_end"), keys, bucket), keys, how)


def containment_join(inner: DataFrame, outer: DataFrame, keys: Sequence[str], bucket: int = BUCKET, how: str = "inner") -> DataFrame:
    """Rows of inner (start, end) inside rows of outer (r_start, r_end)."""
    point = inner.withColumn("tile", F.floor(F.col("start") / bucket))
    cover = tiled(outer, "r_start", "r_end", bucket)
    inside = (F.col("start") >= F.col("r_start")) & (F.col("end") <= F.col("r_end"))
    if how == "inner":
        return point.join(cover, [*keys, "tile"]).where(inside).drop("tile")
    spans = inner.select(*keys, "start", "end").distinct()
    return _by_span(inner, containment_join(spans, outer.select(*keys, "r_start", "r_end"), keys, bucket), keys, how)


def last_overlap(queries: DataFrame, targets: DataFrame, keys: Sequence[str], id_col: str, bucket: int = BUCKET) -> DataFrame:
    """id_col and the overlapping target with the largest r_start."""
    pairs = overlap_join(queries, targets, keys, bucket)
    best = F.max_by(F.struct("r_start", "r_end"), F.struct("r_start", "r_end"))
    return pairs.groupBy(id_col, *keys, "start", "end").agg(best.alias("b")).select(id_col, *keys, "start", "end", "b.r_start", "b.r_end")


def depth_segments(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", tile: int = 1 << 16) -> DataFrame:
    """keys, seg_start, seg_end, depth: runs of equal depth > 0 over half-open [start, end), cut at tile borders.

    A sweep of +1 and -1 by (keys, tile): no base is exploded, and a hot contig is spread over its tiles."""
    cut = tiled(df.where(F.col(end) > F.col(start)).withColumn("_last", F.col(end) - 1), start, "_last", tile, "_tile")
    lo, hi = F.greatest(F.col(start), F.col("_tile") * tile), F.least(F.col(end), (F.col("_tile") + 1) * tile)
    marks = cut.select(*keys, "_tile", F.explode(F.array(F.struct(lo.alias("pos"), F.lit(1).alias("d")), F.struct(hi.alias("pos"), F.lit(-1).alias("d")))).alias("m"))
    sums = marks.groupBy(*keys, "_tile", F.col("m.pos").alias("seg_start")).agg(F.sum("m.d").alias("d"))
    w = Window.partitionBy(*keys, "_tile").orderBy("seg_start")
    run = sums.withColumn("depth", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("seg_end", F.lead("seg_start").over(w))
    return run.where("depth > 0 AND seg_end IS NOT NULL").select(*keys, "seg_start", "seg_end", F.col("depth").cast("long").alias("depth"))


def coverage_summary(segments: DataFrame, contigs: DataFrame) -> DataFrame:
    """Of each contig (contig, length): bases, mapped positions, mean depth over all and over mapped positions."""
    width = F.col("seg_end") - F.col("seg_start")
    got = segments.groupBy("contig").agg(F.sum(width * F.col("depth")).alias("bases"), F.sum(width).alias("mapped"))
    joined = contigs.join(got, "contig", "left").na.fill(0, ["bases", "mapped"])
    return joined.select("contig", "length", "bases", "mapped", (F.col("length") - F.col("mapped")).alias("unmapped"), (F.col("bases") / F.col("length")).alias("depth"), F.when(F.col("mapped") > 0, F.col("bases") / F.col("mapped")).otherwise(0.0).alias("mapped_depth"))


def coverage_histogram(segments: DataFrame, contigs: DataFrame, top: int = 99) -> DataFrame:
    """depth 0 to top (top: that or more) and the number of positions, uncovered ones included."""
    width = (F.col("seg_end") - F.col("seg_start")).cast("long")
    covered = segments.groupBy(F.least("depth", F.lit(top)).alias("depth")).agg(F.sum(width).alias("n"))
    rest = contigs.agg(F.sum("length").alias("all")).crossJoin(covered.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("some")))  # one row each
    zero = rest.select(F.lit(0).cast("long").alias("depth"), (F.col("all") - F.col("some")).alias("n"))
    domain = contigs.sparkSession.range(top + 1).withColumnRenamed("id", "depth")
    return domain.join(covered.unionByName(zero), "depth", "left").groupBy("depth").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def coverage_fraction(histogram: DataFrame) -> DataFrame:
    """Percentage of positions with at least depth, from 1 on. histogram has some hundred rows at most."""
    whole = Window.partitionBy()
    down = Window.orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    return histogram.select("depth", (100 * F.sum("n").over(down) / F.sum("n").over(whole)).alias("percent")).where("depth >= 1")


def chunk_counts(df: DataFrame, keys: Sequence[str], chunk: int, start: str = "start", end: str = "end") -> DataFrame:
    """Rows that touch each chunk."""
    return tiled(df, start, end, chunk, "chunk").groupBy(*keys, "chunk").agg(F.count("*").alias("n"))
