import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqforge.llm import ngram_join as J

SCHEMA = "doc_id long, text string, node string, n int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_set(text, size=4):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def brute(rows, percent=85):
    """(id, n, component) of rows (id, text)."""
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def cloud(n, words, edits, seed, vocabulary=10**6):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(vocabulary)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = base[:]
        for _ in range(rnd.randrange(edits + 1)):
            copy[rnd.randrange(len(copy))] = f"e{rnd.randrange(10**9)}"
        if rnd.random() < 0.3:
            del copy[: rnd.randrange(4)]
        out.append(" ".join(copy))
    return out


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], SCHEMA).repartition(3)
    return sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in J.linked(df, **how).collect()), key=str)


@pytest.mark.parametrize("whole, lot", [(1 << 20, 1 << 16), (1000, 300)])
def test_clouds_match_brute_force(spark, monkeypatch, whole, lot):
    """Near copies on both sides of the threshold, a passage that all of some texts share, and lots of a few sets each."""
    monkeypatch.setattr(J, "WHOLE", whole)
    for name in ("LOT", "ASKING"):
        monkeypatch.setattr(J, name, lot)
    monkeypatch.setattr(J, "ASKED", 2 * lot)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = cloud(60, 120, 4, 1) + cloud(40, 90, 6, 2) + cloud(12, 200, 3, 3) + cloud(20, 9, 1, 4) + [f"{passage} {t}" for t in cloud(30, 30, 3, 5)]
    texts += [passage + " " + cloud(1, k, 0, k)[0] for k in range(1, 30, 2)] + ["a b c", "A  b\nc", "a b c d", "a b", "x " * 300, "x " * 4]
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("travels", [1, 0])
def test_sets_of_large_clusters_travel_a_few_times(spark, monkeypatch, travels):
    """A cloud that isn't one component, and short texts of one passage: its groups have most nodes in common. Comparing by
    clusters (1) and by groups (0: what travels counts for nothing) gives the same classes."""
    monkeypatch.setattr(J, "WHOLE", 1000)
    if not travels:
        monkeypatch.setattr(J, "_zones", lambda rows, percent, f=J._zones: (x := f(rows, percent)) and (x[0], x[1].withColumn("travels", F.lit(0.0))))
    sent, joined = [], J._joined
    monkeypatch.setattr(J, "_joined", lambda lots, *a: sent.append(lots.count()) or joined(lots, *a))
    texts = cloud(80, 200, 16, 11) + [f"all rights are reserved by the {t}" for t in cloud(60, 12, 2, 12)]
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows)
    assert not travels or len(sent) == 2 and sent[1] <= 6 * len(texts)


def test_counted_shingles_are_packed():
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.integers(0, J.BOUND << (63 - J.BITS), 200)) for _ in range(3000)]
    sets[7] = sets[5]
    nodes = np.arange(3000) + (5 << 33)
    sets[9][:2] = sets[9][0]
    batch = pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([x.tolist() for x in sets], pa.list_(pa.int64()))], names=["node", "tokens"])
    width = J.BOUND // 5 + 1
    packed = list(J._packer(width)(iter([batch.slice(0, 1000), batch.slice(1000)])))
    size = sum(len(t.as_py()) + len(n.as_py()) for b in packed for t, n in zip(b.column("tokens"), b.column("nodes")))
    assert size <= 6 * 600_000
    got = sorted(r for b in J._counter(width)(iter(packed)) for r in zip(*[c.to_pylist() for c in b.columns]))
    bits = [(x >> (63 - J.BITS)).tolist() for x in sets]
    df = Counter(t for x in bits for t in x)
    assert got == sorted((int(n), t, df[t]) for n, x in zip(nodes, bits) for t in x if df[t] > 1)
    assert {n for n, *_ in got} >= {nodes[5], nodes[7], nodes[9]}


def test_edges(spark):
    text = " ".join(map(str, range(50)))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c"), (5, "A b c"), (6, text), (6, text), (6, "other words of one id"), (7, text), (None, "a b c"), (None, "alone here"), (None, "two of"), (None, "two of"), (8, "é É é É é"), (9, "é é é é é"), (10, text + " " + text), (11, "word " * 20000), (12, "word " * 5)]
    assert run(spark, rows) == brute(rows)
    assert J.linked(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tries_find_all_links():
    rnd = random.Random(7)
    for trial in range(60):
        vocabulary = [rnd.getrandbits(60) for _ in range(rnd.choice([5, 30, 80]))]
        base = rnd.sample(vocabulary, rnd.randrange(1, len(vocabulary)))
        sets = []
        for _ in range(rnd.randrange(2, 25)):
            s = set(base)
            for _ in range(rnd.randrange(6)):
                s.symmetric_difference_update([rnd.choice(vocabulary)])
            sets.append(np.array(sorted(s or {1}), np.int64))
        percent = rnd.choice([50, 85, 100])
        tree = J.Trie(sets)
        link = lambda a, b: 100 * len({*a} & {*b}) >= percent * len({*a} | {*b})
        other = np.array([rnd.random() < 0.7 for _ in sets])
        for a in [*sets, np.array([3, 7], np.int64)]:
            for larger in (False, True):
                got = tree.links(a, other, percent, larger)
                want = [k for k, i in enumerate(tree.order) if other[k] and link(a, sets[i]) and (not larger or len(sets[i]) >= len(a))]
                assert sorted(got) == want


def test_prefix_lengths():
    for n in range(1, 500):
        least = -(-85 * n // 100)
        assert J.prefix_length(n) == n - least + 1


def test_shingles_by_definition():
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["a", "B", "b", "é", "c\n"]) for _ in range(rnd.randrange(40))) for _ in range(200)] + ["", " "]
    t, s = J.shingle_sets(texts)
    assert [Counter(t.tolist())[i] for i in range(len(texts))] == [len(plain_set(x)) for x in texts]
    assert len({*s.tolist()}) == len(frozenset().union(*map(plain_set, texts)))


def test_sql_twin(spark):
    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got = J.op11_ngram_join(spark, str(data)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(J.SQL + " ORDER BY doc_id").fetchall())
