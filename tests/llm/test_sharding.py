import random
import zlib
from collections import Counter, defaultdict

from seqforge.llm import sharding as S


def check(rows, got, shards):
    assert len(got) == len(rows)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return slots


def test_sizes_are_near_equal_and_groups_stay_together(spark):
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice("abcé ") for _ in range(rnd.randrange(20, 400)))) for i in range(6000)]
    rows += [(10_000 + i, f"copy {i % 300} of a text") for i in range(1200)]
    got = S.sharded(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    check(rows, got, 8)
    size, count = Counter(), Counter()
    for r in got:
        size[r["shard"]] += r["size"]
        count[r["shard"]] += 1
    assert max(size.values()) / min(size.values()) < 1.05
    assert max(count.values()) / min(count.values()) < 1.1
    where = defaultdict(set)
    for r in got:
        if r["id"] >= 10_000:
            where[(r["id"] - 10_000) % 300].add(r["shard"])
    assert all(len(x) == 1 for x in where.values())


def test_a_group_of_a_third_of_all_rows_is_cut(spark):
    rows = [(i, "the same text") for i in range(2000)] + [(5000 + i, f"another {i:08d}") for i in range(4000)]
    got = S.sharded(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    slots = check(rows, got, 10)
    assert max(map(len, slots.values())) < 1.15 * 600


def test_edges(spark):
    rows = [(1, None), (1, None), (None, "x"), (2, ""), (3, "long " * 20_000)]
    df = spark.createDataFrame([(i, t, 0, "p") for i, t in rows], "doc_id long, text string, shard int, part string")
    check(rows, S.sharded(df, 4).collect(), 4)
    assert S.sharded(df.limit(0), 4).count() == 0


def test_groups_that_fit_stay_whole_and_ties_are_placed(spark):
    """Groups of a third of a shard, all of one size; only what no shard can hold is cut."""
    rows = [(g * 100 + i, f"group {g:03d} " + "x" * 90) for g in range(24) for i in range(20)]
    rows += [(90_000 + i, "the largest group of all " * 4) for i in range(400)]
    shards = 8
    got = S.sharded(spark.createDataFrame(rows, "doc_id long, text string"), shards).collect()
    check(rows, got, shards)
    where, size = defaultdict(set), Counter()
    for r in got:
        size[r["shard"]] += r["size"]
        if r["id"] < 90_000:
            where[r["id"] // 100].add(r["shard"])
    assert all(len(x) == 1 for x in where.values())
    assert len({r["shard"] for r in got if r["id"] >= 90_000}) > 1
    mean = sum(size.values()) / shards
    assert max(size.values()) < 1.3 * mean and min(size.values()) > 0.7 * mean
