import random
import re
from bisect import bisect_right

from seqforge.llm import quality_rules as Q
from seqforge.llm.quantiles import STEPS

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    """The base counts by their definitions."""
    t = text or ""
    words = WORD.findall(t)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    inside = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    lines, seen, twice = t.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            twice += x in seen
            seen.add(x)
    return [len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), twice, len(inside)]


def texts():
    rnd = random.Random(5)
    out = [None, "", " \n\t", "one", "a b c d e", "a b c d e a b c d e", "a " * 500, "#*$%&|<>\n#*$%&|<>\n", "é ü x\x0by\x1cz", "x\n x\nx\n\n\n", "q" * 100_000]
    return out + [" ".join(rnd.choice(["a", "b", "c\n", "d", "#"]) for _ in range(rnd.randrange(60))) for _ in range(300)]


def test_counts_by_definition(spark):
    for t in texts():
        assert Q.counts_of(t)[:5] == plain(t), repr(t)[:80]


def test_judged(spark):
    rows = [(i, t, None if i % 3 else "en", "s", "extra") for i, t in enumerate(texts())] + [(None, "word " * 3, None, None, "e"), (7, "same id", "fr", None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")
    got = Q.judged(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t, *_ in rows[: len(texts())]:
        n, chars, symbols, lines, repeated = plain(t)
        r = next(r for r in by[i] if (r["n_words"], r["word_chars"]) == (n, chars))
        assert (r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (symbols, lines, repeated)
        assert r["base_failed"] == (n < 10 or 100 * repeated > 20 * n)
        assert not (r["base_failed"] and r["kept"])
    assert Q.judged(df.limit(0)).count() == 0


def test_thresholds_follow_the_data(spark):
    """A ratio that is usual in one source is odd in another."""
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    calm = lambda k: " ".join(rnd.choice(words) + "#" * (i < k) for i in range(60))
    rows = [(i, calm(0), "en", "web") for i in range(400)] + [(1000 + i, calm(20), "en", "code") for i in range(400)] + [(5000, calm(20), "en", "web")]
    got = {r["doc_id"]: r for r in Q.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i]["kept"] for i in range(400))
    assert sum(got[1000 + i]["kept"] for i in range(400)) >= 395
    assert not got[5000]["kept"] and got[5000]["failed_rule"] == "symbol_ratio"


def test_against_plain_quantiles(spark):
    """Thresholds and verdicts of every rule, from sorted values; groups this small have exact sketches."""
    rnd = random.Random(11)
    vocabulary = [rnd.choice(["", "X", "#"]) * (rnd.random() < 0.1) + "ab" * rnd.randrange(1, 5) + str(k) for k in range(300)]
    rows = []
    for lang, source, n in (("en", "web", 400), ("en", "code", 300), ("en", "rare", 30), ("fr", "web", 250), ("de", "web", 20), (None, None, 15)):
        for _ in range(n):
            lines = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(4, 12))) for _ in range(rnd.randrange(2, 9))]
            if rnd.random() < 0.1:
                lines += lines[:1] * rnd.randrange(1, 3)
            rows.append((len(rows), "\n".join(lines), lang, source))
    ratios, groups = {}, {}
    for i, t, lang, source in rows:
        c = dict(zip(Q.COUNTS, Q.counts_of(t)))
        failed = c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]
        ratios[i] = (failed, {r: c[n] / c[d] if c[d] else 0.0 for r, n, d in Q.RULES})
        if c["n_words"] >= 10:
            for key in ((lang, source), (lang, "any"), "all"):
                groups.setdefault(key, []).append(i)

    def at(parts, q):
        """The smallest value at which the mixture of (weight, sorted values), each at the middles of equal steps, reaches q."""
        steps = [(w, [v[max(0, -int(-(k + 0.5) * len(v) // STEPS) - 1)] for k in range(STEPS)]) for w, v in parts if v]
        return next(x for x in sorted({x for _, v in parts for x in v}) if sum(w * bisect_right(v, x) / STEPS for w, v in steps) >= q - 1e-9)

    want = {}
    for i, _, lang, source in rows:
        nested = [groups.get(key, []) for key in ((lang, source), (lang, "any"), "all")]
        left, weights = 1.0, []
        for g in nested[:2]:
            weights.append(left * len(g) / (len(g) + Q.PRIOR))
            left *= Q.PRIOR / (len(g) + Q.PRIOR)
        first = None
        for r, *_ in Q.RULES:
            parts = [(w, sorted(ratios[k][1][r] for k in g)) for w, g in zip([*weights, left], nested)]
            q1, q3 = at(parts, 0.25), at(parts, 0.75)
            limit = q3 + Q.SPREAD * (q3 - q1) if q3 > q1 else at(parts, Q.TAIL)
            first = first or (r if ratios[i][1][r] > limit else None)
        want[i] = (not ratios[i][0] and first is None, first)
    got = {r["doc_id"]: (r["kept"], r["failed_rule"]) for r in Q.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got == want
    assert len({rule for _, rule in want.values()}) >= 3


def test_ties_at_the_threshold_pass(spark):
    """A group whose ratios are all equal fails no rule."""
    rows = [(i, "one two three four five six seven eight nine ten eleven #", "en", "s") for i in range(250)]
    assert all(r["kept"] for r in Q.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect())


def test_every_group_has_its_own_thresholds(spark):
    """Groups of a few documents differ as well, and a group's weight grows with it."""
    rnd = random.Random(3)
    rows = []
    for k, source in enumerate("abcdef"):
        for _ in range(12 + 40 * k):
            rows.append((len(rows), " ".join("x" * rnd.randrange(2 + k, 9 + k) for _ in range(20)), "en", source))
    counts = Q.document_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    got = {r["source"]: r["max_word_length"] for r in Q.thresholds(counts).collect()}
    assert len({*got.values()}) == 6
