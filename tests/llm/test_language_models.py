import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqforge.llm import kneser_ney as K
from seqforge.llm import quality_lm, toxicity

DATA = Path("/root/testdata/sf0.01")
SCHEMA = "doc_id long, text string, lang string"


def brute_model(texts, order):
    """log p(word) of an interpolated modified Kneser-Ney model of characters, by plain counting."""
    top = Counter()
    for t in texts:
        for w in (t or "").split():
            s = f"\x02{w}\x03"
            for end in range(2, len(s) + 1):
                top[s[max(0, end - order) : end]] += 1
    vocabulary = 1 + len({g[-1] for g in top})
    shared, kinds = {}, {g for g in top if len(g) == order}
    for n in range(order - 1, 0, -1):
        shared[n] = Counter(g[1:] for g in kinds)
        kinds = set(shared[n]) | {g for g in top if len(g) == n}

    def level(counts):
        d = K._discounts(Counter(c for c in counts.values() if c <= 4))
        total, taken = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            taken[g[:-1]] += d[min(c, 3) - 1]
        return counts, d, total, taken

    levels, own = {n: level(c) for n, c in shared.items()}, level(top)

    def p(g, lv):
        counts, d, total, taken = lv
        below = p(g[1:], levels[len(g) - 1]) if len(g) > 1 else 1 / vocabulary
        if not total[g[:-1]]:
            return below
        c = counts.get(g, 0)
        return (c - (d[min(c, 3) - 1] if c else 0)) / total[g[:-1]] + taken[g[:-1]] / total[g[:-1]] * below

    def word(w):
        s = f"\x02{w}\x03"
        return sum(math.log(p(s[max(0, e - order) : e], own)) for e in range(2, len(s) + 1))

    return word


def corpus(n, seed=1):
    rnd = random.Random(seed)
    words = ["banana", "band", "bandana", "cab", "abba", "dad", "a", "nab"]
    return [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 30))) for _ in range(n)]


def test_scores_as_by_plain_counting(spark):
    texts = corpus(80)
    df = spark.createDataFrame([(t, 0) for t in texts], "text string, klass int")
    model = K.fit(df, 4)
    want = brute_model(texts, 4)
    asked = ["banana", "bandit", "zzz", "a", "nana", "dadcab", "banana" * 3000 + "bandit" * 50]
    whole = K.Measures(["l"], lambda s, n: [float(s.sum())], lambda: [F.sum(F.col("times") * F.col("l0"))], [0.0])
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(asked)], "doc_id long, text string")
    for sharded in (False, True):
        got = {r["doc_id"]: r["l"] for r in K.score_documents(docs, model, whole, sharded=sharded).collect()}
        for i, w in enumerate(asked):
            assert got[i] == pytest.approx(want(w), rel=1e-4), (w, sharded)


def test_models_are_gathered_by_partitions(spark, monkeypatch):
    """The driver never holds all packed rows beside the arrays that it makes of them."""
    from pyspark.sql.classic.dataframe import DataFrame

    model = K.fit(spark.createDataFrame([(t, 0) for t in corpus(60, 2)], "text string, klass int"), 4)
    rows = [(K.gram_keys([r["g"]]).tobytes(), np.array([r["p0"], r["b0"]], np.float32).tobytes()) for r in model.rows.select("g", F.coalesce("p0", F.lit(0.0)).alias("p0"), F.coalesce("b0", F.lit(0.0)).alias("b0")).collect()]
    packed = spark.createDataFrame(rows, "k binary, v binary").repartition(3)

    def whole(self):
        raise AssertionError("collected")

    monkeypatch.setattr(DataFrame, "collect", whole)
    key, values = K.gathered(packed, len(rows), 2)
    assert sorted((k.tobytes(), v.tobytes()) for k, v in zip(key, values)) == sorted(rows)
    empty = K.gathered(packed.limit(0), 0, 2)
    assert empty[0].shape == (0,) and empty[1].shape == (0, 2)


def test_both_ways_of_scoring_agree(spark, monkeypatch):
    rows = [(t, k) for k in (0, 1) for t in corpus(60, k)] + [(None, 0), ("", 1)]
    model = K.fit(spark.createDataFrame(rows, "text string, klass int"), 5, 2, toxicity.words_of)
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "banana bandit banana", "k"), (3, "banana bandit banana", None), (None, "qqq " * 300, "k"), (5, "x" * 5000, "k")], "doc_id long, text string, _row string")
    rounded = [F.round(n, 3).alias(n) for n in toxicity.NAMES]
    monkeypatch.setattr(K, "FREQUENT", 4)
    a, b = (sorted(map(str, K.score_documents(docs, model, toxicity.MEASURES, toxicity.words_of, sharded=s).select("doc_id", "_row", *rounded).collect())) for s in (False, True))
    assert a == b and len(a) == 6


def test_toxicity_edges(spark):
    calm = [(i, t, 0) for i, t in enumerate(corpus(100, 3))]
    rude = [(1000 + i, t + " zorgrot vilespit", 1) for i, t in enumerate(corpus(100, 4))]
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in calm + rude], SCHEMA)
    labels = spark.createDataFrame([(i, k) for i, _, k in calm + rude] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.with_labels(docs, labels))
    asked = spark.createDataFrame([(1, None, "p"), (2, "", "p"), (3, "vilespit zorgrot", "p"), (4, "banana band cab", "p"), (4, "banana band cab", None)], "doc_id long, text string, klass string")
    got = {(r["doc_id"], r["text_"]): r for r in model.score(asked.withColumn("text_", F.col("text"))).collect()}
    assert got[(3, "vilespit zorgrot")]["predicted"] == 1 and got[(4, "banana band cab")]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 4
    assert model.score(asked.limit(0)).count() == 0
    only = toxicity.fit(toxicity.with_labels(docs, labels.where("toxic = 0")))
    assert all(r["score"] <= 0.5 for r in only.score(asked).collect())


def test_toxicity_counts_all_labelled_rows(spark):
    """The model that scores knows each labelled text, those of the calibration sample included."""
    rows = [(i, f"{t} only{'abcdefghij'[i % 10] * (1 + i // 10)}", i % 2) for i, t in enumerate(corpus(60, 8))]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, klass int")
    want = K.fit(labelled, toxicity.ORDER, 2, toxicity.words_of)
    out = [m.rows.select("g", *[F.round(c, 6) for c in ("p0", "p1", "b0", "b1")]).collect() for m in (toxicity.fit(labelled).model, want)]
    assert sorted(map(str, out[0])) == sorted(map(str, out[1]))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select(F.col("doc_id").alias("_id"), "toxic").where("toxic IS NOT NULL")
    rows = toxicity.op10_toxicity(spark, str(DATA)).where("held_out").join(labels, F.col("doc_id") == F.col("_id")).select("predicted", "toxic").collect()
    assert len(rows) > 30 and np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.9


def test_quality_keeps_what_resembles_trusted_text(spark):
    good = [(i, t, "en") for i, t in enumerate(corpus(200, 6))]
    more = [(1000, "banana band abba dad", "en"), (1001, "xqzj kwvq zzqk jjxw", "en"), (1002, None, "en"), (1003, "", None), (1004, "banana cab", None), (1004, "banana cab", None)]
    docs = spark.createDataFrame(good + more, SCHEMA).withColumn("klass", F.lit("x")).withColumn("threshold", F.lit(1))
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(None, 1), (1001, 0)], "doc_id long, quality int")
    rows = quality_lm.judged(docs, labels).collect()
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
    assert len(rows) == len(good) + len(more)
    assert got[1000][0]["kept"] and not got[1001][0]["kept"] and not got[1002][0]["kept"] and not got[1003][0]["kept"]
    assert [r["kept"] for r in got[1004]] == [True, True] and got[1002][0]["perplexity"] is None
    assert sum(got[i][0]["kept"] for i, *_ in good) >= 190  # the threshold knows a fifth of them, some of one word
    assert quality_lm.judged(docs.limit(0), labels).count() == 0
    assert quality_lm.judged(docs, labels.limit(0)).where("kept").count() == len(good) + 4


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_quality_held_out(spark):
    """Labels of every fourth document are hidden; those documents are judged by what the others teach."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where("quality IS NOT NULL")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    hidden = labels.where("doc_id % 4 = 0").select(F.col("doc_id").alias("_id"), "quality")
    rows = quality_lm.judged(docs, labels.where("doc_id % 4 <> 0")).join(hidden, F.col("doc_id") == F.col("_id")).select("kept", "quality").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(good) > 40 and np.mean(good) > 0.9 and np.mean(bad) < 0.6


def test_quality_against_plain_counting(spark):
    """Perplexities, thresholds and verdicts, from the plain model and sorted perplexities."""
    docs = [(i, t, "en") for i, t in enumerate(corpus(400, 21))] + [(1000, "xqzj kwvq", "en"), (1001, "banana dad", None)]
    frame = spark.createDataFrame(docs, SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i in range(400)], "doc_id long, quality int")
    apart = {r["doc_id"] for r in quality_lm.trusted(frame, labels).where("apart").collect()}
    word = brute_model([t for i, t, _ in docs if i < 400 and i not in apart], 3)
    perplexity = {i: math.exp(-sum(map(word, t.split())) / sum(len(w) + 1 for w in t.split())) for i, t, _ in docs}
    held = sorted(p for i, p in perplexity.items() if i in apart and i < 400)
    assert len(held) >= 50
    limit = held[-int(-quality_lm.QUANTILE * len(held) // 1) - 1] * quality_lm.SLACK
    for r in quality_lm.judged(frame, labels, 3).collect():
        assert r["perplexity"] == pytest.approx(perplexity[r["doc_id"]], rel=1e-4) and r["threshold"] == pytest.approx(limit, rel=1e-4)
        assert r["kept"] == (perplexity[r["doc_id"]] <= limit)


def test_thresholds_are_quantiles_of_mixtures(spark):
    """Of each language with all others: its held-out perplexities weigh n / (n + PRIOR)."""
    docs = [(i, t, ("en", "fr", None)[i % 3] if i % 7 else "rare") for i, t in enumerate(corpus(400, 25))]
    frame = spark.createDataFrame(docs, SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i in range(400)], "doc_id long, quality int")
    apart = {r["doc_id"] for r in quality_lm.trusted(frame, labels).where("apart").collect()}
    rows = quality_lm.judged(frame, labels, 3).collect()
    held = {}
    for r in rows:
        if r["doc_id"] in apart:
            held.setdefault(r["lang"], []).append(r["perplexity"])
    every = [p for x in held.values() for p in x]
    for lang, own in held.items():
        w = len(own) / (len(own) + quality_lm.PRIOR)
        share = lambda x: w * np.mean(np.array(own) <= x) + (1 - w) * np.mean(np.array(every) <= x)  # noqa: B023, E731
        want = min(x for x in every if share(x) >= quality_lm.QUANTILE - 1e-9) * quality_lm.SLACK
        assert all(r["threshold"] == pytest.approx(want, rel=1e-9) for r in rows if r["lang"] == lang)
    assert len({r["threshold"] for r in rows}) >= 3


def test_toxicity_against_plain_counting(spark):
    """Features of texts and their score, from two plain models with shared lower orders."""
    rows = [(i, t + (" zorg vile" if i % 2 else ""), i % 2) for i, t in enumerate(corpus(80, 31))]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, klass int"), 3)
    asked = ["zorg", "banana zorg", "cab dad", "xyz vile vile", ""]
    got = {r["doc_id"]: r for r in model.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")).collect()}
    table = {r["g"]: r for r in model.model.rows.collect()}

    def logp(g, k):
        """Interpolated probabilities are in the table; what isn't backs off."""
        top, weight = True, 0.0
        while True:
            r = table.get(g)
            if r is not None and r[f"p{k}"] is not None:
                return weight + r[f"p{k}"]
            ctx = table.get(g[:-1])
            b = ctx and ctx[f"b{k}" if top else f"s{k}"]
            weight, top = weight + (b or 0.0), False
            if len(g) == 1:
                return weight - math.log(model.model.vocabulary)
            g = g[1:]

    for i, t in enumerate(asked):
        ratios = []
        for w in t.split():
            s = f"\x02{w}\x03"
            ratios.append((sum(logp(s[max(0, e - 3) : e], 1) - logp(s[max(0, e - 3) : e], 0) for e in range(2, len(s) + 1)), len(w) + 1))
        n = sum(x for _, x in ratios)
        want = [sum(r for r, _ in ratios) / n, max(r / max(x, 4) for r, x in ratios), sum(x for r, x in ratios if r / x > 0.5) / n] if ratios else [0.0] * 3
        assert [got[i][name] for name in toxicity.NAMES] == pytest.approx(want, abs=1e-4)
        z = sum(a * b for a, b in zip(model.weights, [*want, 1.0]))
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-3)
