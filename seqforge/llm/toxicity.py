"""Toxicity by class-conditional Kneser-Ney models.

Two models of characters within lower-cased words, of toxic and of ordinary documents, share the continuation counts
of all shorter n-grams (kneser_ney). A document's log-likelihood ratio is divided by its number of events; so is that
of its most suspicious words, which a long document would else dilute. A logistic function of these figures makes the
score. It is fitted on a bounded sample of labelled documents, by a model whose counts leave that sample out; the counts
of the model that scores are those of all labelled documents. Texts are counted once, with the sample as further classes.

Defined cases: a null or empty text has ratio 0 and the score that the logistic function gives it; texts of any length
are counted and scored whole; documents without a label, and null ids, are not learned from; several labels of one
document count as its highest; with labels of one class only, all scores are 0.5 at most; a score of 0.5 is predicted
as toxic; repeated rows are scored alike; an empty table gives an empty result; columns named as what score adds are
replaced, others pass through it.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kneser_ney
from .common import cut, table
from .language_id import fold

ORDER = 6
#: 0.8 of it is about how many labelled documents fit the logistic function: a hash of the id picks them, a fifth at most.
CALIBRATION_ROWS = 20_000
#: Labels broadcast at most; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
_LETTERS = regex.compile(r"[\p{L}\p{M}\p{N}']+")
NAMES = ["mean_llr", "top_llr", "suspect_share"]


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


def features(scores: np.ndarray, events: np.ndarray) -> list[float]:
    """Length-normalised log-likelihood ratio of the text, that of its most suspicious word, and the share of events in
    words whose own ratio is beyond 0.5."""
    if not len(events):
        return [0.0, 0.0, 0.0]
    ratio = scores[:, 1] - scores[:, 0]
    own = ratio / events
    return [float(ratio.sum() / events.sum()), float((ratio / np.maximum(events, 4)).max()), float(events[own > 0.5].sum() / events.sum())]


def feature_columns() -> list[Column]:
    ratio, events, all_of = F.col("l1") - F.col("l0"), F.col("events"), F.sum(F.col("times") * F.col("events"))
    suspect = F.sum(F.when(ratio / events > 0.5, F.col("times") * events).otherwise(0))
    return [F.sum(F.col("times") * ratio) / all_of, F.max(ratio / F.greatest(events, F.lit(4))), suspect / all_of]


MEASURES = kneser_ney.Measures(NAMES, features, feature_columns, [0.0, 0.0, 0.0])


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and klass (1: toxic) of the documents that have a label."""
    docs = docs.select("doc_id", "text")
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("klass"))
    own = own.where("klass IN (0, 1)").withColumnRenamed("doc_id", "_id")
    if labels.count() <= BROADCAST_LABELS:
        own = F.broadcast(own)
    return docs.join(own, F.col("doc_id") == F.col("_id")).drop("_id")


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Weights, the last one constant, by Newton steps on standardised features folded back."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) / len(y) + ridge * w
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


class ToxicityModel:
    def __init__(self, model: kneser_ney.Model, weights: np.ndarray):
        self.model, self.weights = model, weights

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs without the text, with NAMES, score and predicted, which replace columns of these names."""
        rows = kneser_ney.score_documents(docs.drop("score", "predicted"), self.model, MEASURES, words_of, text_col)
        z = sum((F.col(n) * float(w) for n, w in zip(NAMES, self.weights)), F.lit(float(self.weights[-1])))
        score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
        return rows.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def fit(labelled: DataFrame, order: int = ORDER) -> ToxicityModel:
    """labelled: doc_id, text, klass."""
    apart = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(10)) < 2
    n = labelled.count()
    if n > 4 * CALIBRATION_ROWS:  # about 0.8 * CALIBRATION_ROWS of them, by another hash
        apart &= F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) < int((1 << 20) * 4 * CALIBRATION_ROWS / n)
    parts = labelled.select("text", (F.col("klass") + F.when(apart, 2).otherwise(0)).cast("int").alias("klass"))
    events = cut(kneser_ney.count_events(parts, order, 4, words_of), "events")
    others = kneser_ney.of_events(events.where("c0 + c1 > 0").select("g", "c0", "c1"), order, 2)
    model = kneser_ney.of_events(events.select("g", F.expr("c0 + c2").alias("c0"), F.expr("c1 + c3").alias("c1")), order, 2)
    rest = labelled.where(apart).select("doc_id", "klass", "text")
    rows = kneser_ney.score_documents(rest, others, MEASURES, words_of).select("klass", *NAMES).toPandas()  # about 0.8 * CALIBRATION_ROWS
    x, y = rows[NAMES].to_numpy(float), rows["klass"].to_numpy(float)
    if len(set(y)) < 2:
        return ToxicityModel(model, np.array([0.0] * len(NAMES) + [-1.0]))
    return ToxicityModel(model, logistic(x, y))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    learned = with_labels(docs.where(fold("doc_id", 5) != 0), labels)
    out = fit(learned).score(docs)
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", *NAMES)


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
