import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from seqforge.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def runs(t, n):
    w = WORD.findall(lower(t))
    return len(w), [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]


def bucket(f):
    return zlib.crc32(f.encode("utf-8", "surrogatepass")) % R.BUCKETS


def brute(docs, target, n):
    s, t = (Counter(bucket(f) for x in texts for f in runs(x, n)[1]) for texts in ([d[1] for d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + R.BUCKETS) / ((s[b] + 1) * (T + R.BUCKETS))))
    rows = []
    for i, text in docs:
        words, fs = runs(text, n)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        rows.append([i, words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    enough = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough):
        r.append(k + 1 if k < 10 * len(enough) // 100 else None)
    return [r if len(r) == 6 else [*r, None] for r in rows]


def corpus():
    rnd = random.Random(3)
    vocabulary = ["a", "B7", "été", "x-y", "don't", "漢字", "q" * 70, "Zed", "n\tm", "1,000"]
    text = lambda k: " ".join(rnd.choice(vocabulary) + str(rnd.randrange(50)) for _ in range(k))
    docs = [(i, text(rnd.randrange(60))) for i in range(150)] + [(200, None), (201, ""), (202, "... --- !"), (203, text(9000)), (204, text(3000)), (205, "w" * 5000)]
    return docs + [(206, docs[3][1]), (206, docs[3][1]), (206, text(40)), (None, text(40))], [text(30) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("n", [1, 3])
def test_against_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(R, "LONG", 4000)
    monkeypatch.setattr(R, "CHUNK_WORDS", 701)
    docs, target = corpus()
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in docs], "doc_id long, text string, weight string, owned int").repartition(5)
    got = R.resample(df, spark.createDataFrame([(t, 1) for t in target], "text string, id int"), n)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    rows = sorted(([r["id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]] for r in got.collect()), key=key)
    assert rows == sorted(brute(docs, target, n), key=key)


def test_chunks_own_every_start_once():
    text = " ".join(f"w{i}" for i in range(1003)) + " é"
    for n in (1, 2, 5):
        for words in (1, 7, 500, 2000):
            got = [f for owned, t in R.pieces(text, n, words) for f in runs(t, n)[1][: owned]]
            assert got == runs(text, n)[1]


def test_crc32():
    rnd = random.Random(1)
    items = [bytes(rnd.randrange(256) for _ in range(rnd.randrange(90))) for _ in range(500)] + [b"", b"123456789"]
    size = np.array([len(x) for x in items])
    assert R.crc32s(np.frombuffer(b"".join(items), np.uint8), np.cumsum(size) - size, size).tolist() == [zlib.crc32(x) for x in items]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert R.resample(empty, empty.select("text")).count() == 0
    one = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    assert [(r["n_features"], r["rank"]) for r in R.resample(one, empty.select("text")).collect()] == [(30, None)]
