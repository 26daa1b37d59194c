"""Interpolated modified Kneser-Ney models of characters within words, for one or more classes of texts.

Events. A word w is the sequence ^w$. Each of its characters after ^ is predicted from up to order - 1 characters
before it, not beyond ^. The longest n-gram of an event counts with its class; all shorter ones have continuation
counts (distinct characters to their left) that the classes share, so what a class has rarely seen backs off to what
all texts say.

Fitting is Spark aggregation: tasks count words and turn them into n-gram counts, which are summed by n-gram; one
aggregation and one join by suffix for each order give continuation counts, discounts and interpolated probabilities.
Nothing is sampled or capped, and what is shuffled grows with the input.

Scoring needs, of each word, the probabilities of its n-grams. A table of up to BROADCAST_ROWS n-grams (checked) is
broadcast; a larger one is joined: distinct words are dealt into shards, each shard asks for its distinct n-grams by a
shuffle join and scores its words, and the words of the documents meet their scores in a join; words that make up more
than 1 / FREQUENT of these rows, of which there are fewer than FREQUENT, are broadcast for it. Both ways give the same
scores.

Defined cases: words of any length count and are scored whole (a long one in pieces that overlap by a context, which
gives the same sums); null and empty texts have no event; equal n-grams, repeated texts and ties need no rule, since
all is sums; an empty table gives a model in which all characters are equally likely.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, free, map_batches, parts

BROADCAST_ROWS = 2_000_000
CACHED_WORDS = 500_000
#: Characters of all words whose scores are kept, at most.
CACHED_CHARS = 16 << 20
#: Characters of a word that are scored at a time.
PIECE = 1 << 14
FREQUENT = 1000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LEFT, _RIGHT = "\x02", "\x03"


def raw_words(text: str | None) -> list[str]:
    """Words between white space."""
    return (text or "").split()


@dataclass(frozen=True)
class Measures:
    """What is made of the scores of a text's words.

    names: of the figures. of: from arrays of scores (words x classes) and numbers of events. columns: the same as
    aggregates of rows with times, l0, l1, ... and events, one for each distinct word. empty: of a text without words."""

    names: list[str]
    of: Callable[[np.ndarray, np.ndarray], list[float]]
    columns: Callable[[], list[Column]]
    empty: list[float]


def longest_events(words: dict[str, np.ndarray], order: int, classes: int) -> dict[str, list[int]]:
    """Counts of the longest n-gram of each event; words: counts by class."""
    out: dict[str, list[int]] = {}
    for word, count in words.items():
        s = f"{_LEFT}{word}{_RIGHT}"
        for end in range(2, len(s) + 1):
            g = s[max(0, end - order) : end]
            have = out.get(g)
            if have is None:
                out[g] = list(count)
            else:
                for k in range(classes):
                    have[k] += count[k]
    return out


def count_events(texts: DataFrame, order: int, classes: int, words_of: Callable[[str | None], list[str]] = raw_words) -> DataFrame:
    """g, c0, c1, ...: how often each class has the n-gram as an event's longest. texts: text, klass (0, 1, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[Counter] = [Counter() for _ in range(classes)]
        counts: dict[str, list[int]] = {}

        def flush() -> None:
            words: dict[str, list[int]] = {}
            for k, c in enumerate(found):
                for w, n in c.items():
                    words.setdefault(w, [0] * classes)[k] = n
                c.clear()
            for g, n in longest_events(words, order, classes).items():
                have = counts.setdefault(g, [0] * classes)
                for k in range(classes):
                    have[k] += n[k]

        def rows() -> pa.RecordBatch:
            got = np.array(list(counts.values()), np.int64).reshape(-1, classes)
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array(got[:, k]) for k in range(classes))], names=["g", *(f"c{k}" for k in range(classes))])
            counts.clear()
            return out

        for b in batches:
            for text, k in zip(b.column("text"), b.column("klass")):
                found[k.as_py()].update(words_of(text.as_py()))
                if sum(map(len, found)) > 300_000:
                    flush()
            if len(counts) > 1_000_000:
                yield rows()
        flush()
        if counts:
            yield rows()

    names = [f"c{k}" for k in range(classes)]
    partial = map_batches(texts.select("text", "klass"), run, ", ".join(["g string", *(f"{c} long" for c in names)]))
    return partial.groupBy("g").agg(*[F.sum(c).alias(c) for c in names])


def _discounts(counts: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more."""
    n1, n2, n3, n4 = (counts.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))


def _level(table: DataFrame, count: str, lower: DataFrame | None, vocabulary: int, tag: str) -> tuple[DataFrame, DataFrame]:
    """Interpolated p of each n-gram in table (g, count) and back-off weight b of each context.

    lower: (g, p) of the n-grams without their first character."""
    # Counts of counts are four numbers, whatever the table's size.
    found = {int(r[0]): r[1] for r in table.where(F.col(count).between(1, 4)).groupBy(count).count().collect()}
    d1, d2, d3 = _discounts(found)
    c = F.col(count)
    d = F.when(c == 0, 0.0).when(c == 1, d1).when(c == 2, d2).otherwise(d3)
    rows = table.select("g", c.alias("c"), d.alias("d"), F.expr("left(g, length(g) - 1)").alias("ctx"))
    contexts = rows.groupBy("ctx").agg(F.sum("c").alias("n"), F.sum("d").alias("taken"), F.sum(F.when(F.col("c") > 0, 1)).alias("types")).where("n > 0")
    weights = contexts.select("ctx", "n", (F.col("taken") / F.col("n")).alias("b"))
    joined = rows.join(weights, "ctx", "left").withColumn("suffix", F.expr("substring(g, 2)"))
    if lower is None:
        below = joined.withColumn("pl", F.lit(1.0 / vocabulary))
    else:
        low = lower.select(F.col("g").alias("suffix"), F.col("p").alias("pl"))
        below = joined.join(low, "suffix", "left").fillna({"pl": 1.0 / vocabulary})
    own = F.when(F.col("n").isNull(), F.col("pl")).otherwise((F.col("c") - F.col("d")) / F.col("n") + F.col("b") * F.col("pl"))
    return below.select("g", own.alias(f"p{tag}")), weights.select(F.col("ctx").alias("g"), F.log("b").alias(f"b{tag}"))


@dataclass
class Model:
    """rows: g, p0.. (log probability of g by class), b0.. (log back-off weight of g as context); null: none."""

    rows: DataFrame
    order: int
    classes: int
    vocabulary: int


def fit(texts: DataFrame, order: int, classes: int = 1, words_of: Callable[[str | None], list[str]] = raw_words) -> Model:
    """texts: text, klass (int from 0). An empty table gives a model in which all characters are equally likely."""
    return of_events(cut(count_events(texts, order, classes, words_of), "events"), order, classes)


def of_events(events: DataFrame, order: int, classes: int = 1) -> Model:
    """The model of counted events (g, c0, c1, ...); each row has a count above 0 in one of the classes at least."""
    names = [f"c{k}" for k in range(classes)]
    events = events.withColumn("n", F.length("g"))
    vocabulary = 1 + events.select(F.expr("right(g, 1)").alias("x")).distinct().count()
    # kinds[n]: the distinct n-grams of n characters; shared[n]: continuation counts of those that don't begin a word
    kinds = events.where(F.col("n") == order).select("g")
    shared: dict[int, DataFrame] = {}
    for n in range(order - 1, 0, -1):
        shared[n] = cut(kinds.groupBy(F.expr("substring(g, 2)").alias("g")).agg(F.count("*").alias("c")), f"shared{n}")
        kinds = shared[n].select("g").union(events.where(F.col("n") == n).select("g"))
    lower, pieces = None, []
    for n in range(1, order):
        p, b = _level(shared[n], "c", lower, vocabulary, "")
        p = cut(p, f"p{n}")
        pieces += [p.select("g", *[F.log("p").alias(f"p{k}") for k in range(classes)]), b.select("g", *[F.col("b").alias(f"s{k}") for k in range(classes)])]
        lower = p if lower is None else lower.union(p)
    for k in range(classes):  # the longest n-grams, with the classes' own counts
        p, b = _level(events.withColumnRenamed(names[k], "ck").select("g", "ck"), "ck", lower, vocabulary, "")
        pieces += [p.select("g", F.log("p").alias(f"p{k}")), b.select("g", F.col("b").alias(f"b{k}"))]
    whole = pieces[0]
    for x in pieces[1:]:
        whole = whole.unionByName(x, allowMissingColumns=True)
    # A context has back-off weights of its own order (s) or, as context of a longest n-gram, of the class (b): tell them apart.
    values = [f"{x}{k}" for x in "pbs" for k in range(classes)]
    for v in values:
        if v not in whole.columns:
            whole = whole.withColumn(v, F.lit(None).cast("double"))
    return Model(cut(whole.groupBy("g").agg(*[F.max(v).alias(v) for v in values]), "model"), order, classes, vocabulary)


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings in a row, and their lengths."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64), lengths


def _finish(h: np.ndarray, n: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29)) ^ np.uint64(n)) * _MIX
    return h ^ (h >> np.uint64(32))


def hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Of the n codes that end at each place (the first n - 1 places mean nothing)."""
    h = np.zeros(len(codes), np.uint64)
    for back in range(n - 1, -1, -1):
        h = h * _BASE
        h[back:] += codes[: max(0, len(codes) - back)] + np.uint64(1)
    return _finish(h, n)


def gram_keys(grams: list[str]) -> np.ndarray:
    codes, lengths = _codes(grams)
    ends = np.cumsum(lengths) - 1
    key = np.zeros(len(grams), np.uint64)  # the empty one has 0
    for n in np.unique(lengths[lengths > 0]):
        at = lengths == n
        key[at] = hashes(codes, int(n))[ends[at]]
    return key


class Scorer:
    """Log-likelihoods of words from arrays of n-gram keys and values (columns p0.. b0.. s0..)."""

    def __init__(self, key: np.ndarray, values: np.ndarray, order: int, classes: int, vocabulary: int):
        if not len(key):  # a model of nothing: one row that no n-gram finds
            key, values = np.full(1, np.uint64(2**64 - 1)), np.full((1, 3 * classes), np.nan)
        by = np.argsort(key)
        self.key, self.values = key[by], values[by].astype(np.float32)
        self.order, self.classes = order, classes
        weight = self.values[self.find(gram_keys([""]))][:, 2 * classes :]  # of the empty context
        self.floor = np.nan_to_num(weight, nan=0.0)[0] * (self.find(gram_keys([""]))[0] >= 0) - np.log(vocabulary)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Places in the table; -1: not there."""
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each word by class, and its number of events."""
        sums, events = self._pieces([f"{_LEFT}{w}{_RIGHT}" if len(w) <= PIECE else "" for w in words], np.ones(len(words), np.int64))
        for i, w in enumerate(words):
            if len(w) <= PIECE:
                continue
            s = f"{_LEFT}{w}{_RIGHT}"
            for at in range(0, len(s), PIECE):  # a piece begins with the context of its first event
                got, n = self._pieces([s[max(0, at - self.order) : at + PIECE]], np.array([min(at, self.order) or 1]))
                sums[i] += got[0]
                events[i] += n[0]
        return sums, events

    def _pieces(self, pieces: list[str], skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the events of each piece, without those of its first skip characters."""
        m = self.classes
        codes, lengths = _codes(pieces)
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(codes)) - np.repeat(starts, lengths)
        left = np.minimum(place + 1, self.order)  # length of the event's n-gram that is being tried
        score = np.zeros((len(codes), m))
        todo = np.flatnonzero(place >= np.repeat(skip, lengths))
        top = left.copy()
        h = {0: None}
        for n in range(1, self.order + 1):
            h[n] = hashes(codes, n)
        for n in range(self.order, 0, -1):
            now = todo[left[todo] == n]
            if not len(now):
                continue
            at = self.find(h[n][now])
            p = self.values[at][:, :m]
            known = (at >= 0)[:, None] & ~np.isnan(p)
            # a class that has the n-gram not in its counts still has its interpolated probability, so all know it or none
            hit = known.all(axis=1)
            score[now[hit]] += p[hit]
            miss = now[~hit]
            if not len(miss):
                continue
            if n > 1:
                ctx = self.find(h[n - 1][miss - 1])
                is_top = top[miss] == n
                b = np.where(is_top[:, None], self.values[ctx][:, m : 2 * m], self.values[ctx][:, 2 * m : 3 * m])
                score[miss] += np.where((ctx >= 0)[:, None] & ~np.isnan(b), b, 0)
                left[miss] = n - 1
            else:
                score[miss] += self.floor
        sums = np.zeros((len(pieces), m))
        some = lengths > 0
        if some.any():
            sums[some] = np.add.reduceat(score, starts[some], axis=0)
        return sums, np.maximum(lengths - skip, 0)


class WordScores:
    """Scores of words that a worker has met, until there are too many."""

    def __init__(self, scorer: Scorer):
        self.scorer = scorer
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.chars = 0
        self.scores, self.events = np.zeros((0, self.scorer.classes)), np.zeros(0, np.int64)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros((0, self.scorer.classes)), np.zeros(0, np.int64)
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        if new:
            if len(self.at) + len(new) > CACHED_WORDS:
                self.clear()
                new = list(dict.fromkeys(words))
            s, n = self.scorer(new)
            base = len(self.at)
            self.at.update(zip(new, range(base, base + len(new))))
            if base + len(new) > len(self.scores):
                more = max(len(new), len(self.scores), 1024)
                self.scores = np.concatenate([self.scores, np.zeros((more, s.shape[1]))])
                self.events = np.concatenate([self.events, np.zeros(more, np.int64)])
            self.scores[base : base + len(new)], self.events[base : base + len(new)] = s, n
        i = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        out = self.scores[i], self.events[i]
        self.chars += sum(map(len, new))
        if self.chars > CACHED_CHARS:  # few long words
            self.clear()
        return out


def gathered(rows: DataFrame, grams: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values (width columns) of all rows (k, v), a partition at a time: the driver holds each n-gram once."""
    key, values, at = np.empty(grams, np.uint64), np.empty((grams, width), np.float32), 0
    for k, v in rows.toLocalIterator():
        end = at + len(k) // 8
        key[at:end] = np.frombuffer(k, np.uint64)
        values[at:end] = np.frombuffer(v, np.float32).reshape(-1, width)
        at = end
    return key, values


#: A worker's scores, by the name of the model that it scores with.
_scorers: dict[str, WordScores] = {}


def score_documents(docs: DataFrame, model: Model, measures: Measures, words_of: Callable[[str | None], list[str]] = raw_words, text_col: str = "text", sharded: bool | None = None) -> DataFrame:
    """docs without the text, with the measures of each text's words, which replace columns of their names. sharded:
    None decides by the model's size."""
    docs = docs.drop(*measures.names)
    grams = model.rows.count()
    if grams > BROADCAST_ROWS if sharded is None else sharded:
        return _score_sharded(docs, model, measures, words_of, text_col)
    others = [f for f in docs.schema.fields if f.name != text_col]
    names, m, order, vocabulary = measures.names, model.classes, model.order, model.vocabulary
    values = [f"{x}{k}" for x in "pbs" for k in range(m)]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.float32) for c in values])
            yield pa.RecordBatch.from_arrays([pa.array([gram_keys(b.column("g").to_pylist()).tobytes()]), pa.array([v.tobytes()])], names=["k", "v"])

    rows = map_batches(model.rows.select("g", *values), packed, "k binary, v binary")  # BROADCAST_ROWS n-grams at most
    shipped = docs.sparkSession.sparkContext.broadcast(gathered(rows, grams, 3 * m))
    key, of = uuid.uuid4().hex, measures.of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = WordScores(Scorer(*shipped.value, order, m, vocabulary))
        score = _scorers[key]
        for b in chunks(batches, text_col):  # new words of many texts are scored together
            words = [words_of(t.as_py()) for t in b.column(text_col)]
            scores, events = score([w for x in words for w in x])
            ends = np.cumsum([0, *map(len, words)])
            got = np.array([of(scores[i:j], events[i:j]) for i, j in zip(ends, ends[1:])], float).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in others), *(pa.array(got[:, i]) for i in range(len(names)))], names=[*(f.name for f in others), *names])

    return map_batches(docs, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), *(f"{n} double" for n in names)]))


def _score_sharded(docs: DataFrame, model: Model, measures: Measures, words_of: Callable[[str | None], list[str]], text_col: str) -> DataFrame:
    m, order, vocabulary = model.classes, model.order, model.vocabulary
    row_col, key_col = free(docs, "_row", "_key")
    keyed = cut(docs.withColumn(row_col, F.monotonically_increasing_id()), "docs")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, found, times = [], [], []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, pa.string()), pa.array(times, pa.int64())], names=["_row", "word", "times"])
            for x in (rows, found, times):
                x.clear()
            return out

        for b in batches:
            for r, t in zip(b.column("_row"), b.column("text")):
                c = Counter(words_of(t.as_py()))
                rows += [r.as_py()] * len(c)
                found += c
                times += c.values()
                if len(rows) > 50_000:
                    yield flush()
        yield flush()

    used = cut(map_batches(keyed.select(F.col(row_col).alias("_row"), F.col(text_col).alias("text")), words, "_row long, word string, times long"), "words")
    distinct = cut(used.groupBy("word").agg(F.count("*").alias("n")), "distinct")
    total, kinds = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shards = max(parts(docs.sparkSession), kinds // 100_000 + 1)
    sharded = distinct.select("word", F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int").alias("shard"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            need = {(s.as_py(), g) for w, s in zip(b.column("word"), b.column("shard")) for t in [f"{_LEFT}{w.as_py()}{_RIGHT}"] for end in range(1, len(t) + 1) for g in {"", *(t[i:end] for i in range(max(0, end - order), end))}}
            got = list(need)
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in got], pa.int32()), pa.array([g for _, g in got], pa.string())], names=["shard", "g"])

    need = map_batches(sharded, asked, "shard int, g string").distinct().join(model.rows, "g")
    values = [f"{x}{k}" for x in "pbs" for k in range(m)]

    def scored(words: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(words):
            return pd.DataFrame({"word": [], **{f"l{k}": [] for k in range(m)}, "events": []})
        s, n = Scorer(gram_keys(rows["g"].tolist()), rows[values].to_numpy(np.float32).reshape(-1, 3 * m), order, m, vocabulary)(words["word"].tolist())
        return pd.DataFrame({"word": words["word"], **{f"l{k}": s[:, k] for k in range(m)}, "events": n})

    schema = ", ".join(["word string", *(f"l{k} double" for k in range(m)), "events long"])
    by_word = cut(sharded.groupBy("shard").cogroup(need.groupBy("shard")).applyInPandas(scored, schema), "scores")
    often = F.broadcast(distinct.where(F.col("n") * FREQUENT > total).select("word"))  # fewer than FREQUENT
    met = used.join(F.broadcast(by_word.join(often, "word")), "word").unionByName(used.join(often, "word", "left_anti").join(by_word, "word"))
    found = met.groupBy(F.col("_row").alias(key_col)).agg(*[c.alias(n) for n, c in zip(measures.names, measures.columns())])
    back = keyed.drop(text_col).join(found, F.col(row_col) == F.col(key_col), "left").drop(row_col, key_col)
    return back.fillna(dict(zip(measures.names, measures.empty)))
