import math
import random
import struct
from collections import defaultdict

import numpy as np

from seqforge.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, codes string"


def f32(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def brute(rows, parts, entries, rounds):
    kept = [(i, [math.floor(4096 * f32(x)) if abs(x) < 2**40 else 4096 * int(f32(x)) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    seeds = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1]))[:entries]
    books = [[cut(r[1], p) for r in seeds] for p in range(parts)]

    def best(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            sums = defaultdict(list)
            for _, v, _ in kept:
                sums[best(cut(v, p), books[p])[0]].append(cut(v, p))
            books[p] = [[sum(c) // len(sums[e]) for c in zip(*sums[e])] if e in sums else old for e, old in enumerate(books[p])]
    out, errors = [], defaultdict(int)
    for i, v, label in kept:
        got = [best(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, [g[0] for g in got], sum(g[1] for g in got), label))
        errors[label] += out[-1][2]
    most = 2**63 - 1
    return [(i, c, min(e, most), min(errors[label], most) if errors[label] < most else most) for i, c, e, label in out], books


def check(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    coded, books = V.compress(df, **how)
    want, wanted = brute(rows, how.get("parts", V.PARTS), how.get("entries", V.ENTRIES), how.get("rounds", V.ROUNDS))
    assert [[list(map(int, e)) for e in b] for b in books] == wanted
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r["id"], r["codes"], r["error"], r["label_error"]) for r in coded.collect()), key=key) == sorted(want, key=key)


def test_against_brute_force(spark):
    rnd = random.Random(4)
    vector = lambda s=1.0: [rnd.gauss(0, s) for _ in range(24)]
    rows = [(i * 7 % 400, vector(), rnd.choice([0, 1, None])) for i in range(300)]
    rows += [(1000, None, 1), (1001, [1.0] * 23 + [None], 1), (1002, [float("nan")] * 24, 1), (1003, [float("inf")] * 24, 1), (1004, [], 1), (1005, [0.5] * 16, 1)]
    rows += [(None, vector(), 5), rows[0], rows[0], (rows[1][0], vector(), 1), (2000, [0.0] * 24, None), (2001, [-0.0] * 24, 3)]
    kept = [r for r in rows if r[0] != 1005]  # another length than the others
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert V.compress(df)[0].count() == V.compress(spark.createDataFrame([(*r, "x") for r in kept], SCHEMA))[0].count()
    check(spark, kept)


def test_ties_and_few_vectors(spark):
    grid = [(i, [float(i % 3), float(i % 2)] * 4, i % 2) for i in range(60)]
    check(spark, grid, parts=4)
    check(spark, grid[:5], parts=2)
    check(spark, [(i, [1.0] * 8, None) for i in range(40)])


def test_large_components(spark):
    rnd = random.Random(9)
    check(spark, [(i, [rnd.uniform(-1, 1) * 10.0 ** rnd.randrange(37) for _ in range(8)], i % 3) for i in range(60)], parts=4, entries=4, rounds=3)


def test_empty(spark):
    coded, books = V.compress(spark.createDataFrame([], SCHEMA))
    assert coded.count() == 0 and books.size == 0
    assert [r["codes"] for r in V.compress(spark.createDataFrame([(None, [1.0] * 8, 1, "x")], SCHEMA))[0].collect()] == [None]


def test_partial_distances_are_complete_searches():
    rnd = np.random.default_rng(2)
    for width in (1, 3, 8):
        x, book = rnd.integers(-6, 6, (500, width)), rnd.integers(-6, 6, (16, width))
        full = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        at, d = V.nearest(x, book)
        assert (at == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
