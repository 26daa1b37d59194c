"""Interval operators on rows that come out of a shuffle and on many equal rows, against plain Python."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seqforge.operators import intervals as I


@pytest.mark.parametrize("join", [I.overlap_join, I.containment_join])
def test_semi_and_anti_joins_after_a_shuffle(spark, join):
    """Both computations of the left side are dealt anew, one without the long column."""
    rows = spark.range(40_000).selectExpr("id", "id % 3 AS contig", "id * 7 % 9000 AS start", "id * 7 % 9000 + id % 40 AS end", "concat_ws('', transform(sequence(1, 8), i -> md5(concat(id, '-', i)))) AS text")
    left = rows.withColumn("n", F.count("*").over(Window.partitionBy((F.col("id") % 20_000).alias("x")))).where("n = 2").select("id", "contig", "start", "end", "text")
    right = spark.createDataFrame([(1, 3000, 4500), (1, 4100, 7000), (2, 50, 60)], "contig long, r_start long, r_end long")
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        kept = {how: sorted(r["id"] for r in join(left, right, ["contig"], how=how).collect()) for how in ("left_semi", "left_anti")}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    regions = [tuple(r) for r in right.collect()]
    hits = lambda c, s, e: any(c == k and (s <= b and e >= a if join is I.overlap_join else s >= a and e <= b) for k, a, b in regions)
    want = {i: hits(i % 3, i * 7 % 9000, i * 7 % 9000 + i % 40) for i in range(40_000)}
    assert kept == {"left_semi": [i for i in want if want[i]], "left_anti": [i for i in want if not want[i]]}
