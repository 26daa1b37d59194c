import random
from collections import defaultdict

import pytest

from seqforge.llm import near_dedup as N
from seqforge.llm.shingles import probability_jaccard, shingles

SCHEMA = "doc_id long, text string, lang string"


def brute(rows):
    """Components of all pairs at 0.8."""
    texts = [t or "" for _, t, *_ in rows]
    t, e, w = shingles(texts)
    of = [(e[t == i], w[t == i]) for i in range(len(texts))]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] == rows[j][0]
            if same or (len(of[i][0]) and probability_jaccard(of[i], of[j]) >= 0.8):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r[0])
    return {x: min(g) for g in groups.values() for x in g}


def cloud(n, words, edits, seed):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = base[:]
        for _ in range(rnd.randrange(edits + 1)):
            copy[rnd.randrange(words)] = f"e{rnd.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("small", [24, 3])
def test_clouds_of_copies_match_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(N, "SMALL", small)
    monkeypatch.setattr(N, "ASKING", 500)
    monkeypatch.setattr(N, "ASKED", 800)
    monkeypatch.setattr(N, "MATCHES", 64)
    texts = cloud(60, 120, 5, 1) + cloud(30, 80, 3, 2) + cloud(10, 200, 2, 3)
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    got = {r["id"]: r["class_id"] for r in N.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "a b c", None), (4, "A  b\nc", "x"), (5, " ".join(map(str, range(50))), None), (5, " ".join(map(str, range(50))), None), (6, " ".join(map(str, range(50))), None), (None, "a b c", None), (None, "alone here", None), (7, "word " * 5000, None), (8, "word " * 5000, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "class_id")
    got = sorted(((r["id"], r["class_id"]) for r in N.classes(df).collect()), key=str)
    assert got == sorted([(1, 1), (2, 2), (3, 3), (4, 3), (5, 5), (5, 5), (6, 5), (None, 3), (None, None), (7, 7), (8, 7)], key=str)
    assert N.classes(spark.createDataFrame([], SCHEMA)).count() == 0
