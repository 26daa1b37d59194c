"""Quality classifier: perplexity under a Kneser-Ney model of trusted text.

The model (kneser_ney) learns from four fifths of the documents labelled as good, picked by a hash of their ids. Every
document gets the perplexity of its characters within words; it is kept if that isn't beyond its language's threshold,
a high quantile of the perplexities of the last fifth, which the model hasn't seen, with some slack. The distribution of a
language is a mixture, its own with weight n / (n + PRIOR) and that of all languages with the rest, so each language has a
threshold of its own, and none jumps at a size. Quantiles are exact to the rank error of KLL sketches, merged over tasks.

Defined cases: a null or empty text has no perplexity (null) and isn't kept; texts of any length are scored whole; a
language without trusted documents in the last fifth takes the threshold of all languages, null is a language like
others; documents without labels, and null ids, aren't trusted; a perplexity equal to the threshold is kept; repeated rows are
scored alike; with nothing trusted every text with a word is kept; an empty table gives an empty result; further
columns of the tables, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kneser_ney
from .common import cut, table
from .quantiles import borrowed_weights, mixed_quantiles
from .toxicity import BROADCAST_LABELS

ORDER = 5
QUANTILE, SLACK = 0.995, 1.05
#: A language with so many trusted documents in the last fifth counts half by itself, and half by all languages.
PRIOR = 5
#: Accuracy of the sketches: ranks err by about 0.002.
SKETCH_K = 2000
MEASURES = kneser_ney.Measures(
    ["events", "loglik"],
    lambda scores, events: [float(events.sum()), float(scores.sum())],
    lambda: [F.sum(F.col("times") * F.col("events")).cast("double"), F.sum(F.col("times") * F.col("l0"))],
    [0.0, 0.0],
)


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with klass 0 if labelled good, null else, and apart: whether thresholds learn from it, not the model."""
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select(F.col("doc_id").alias("_id"), F.lit(0).alias("klass"))
    if labels.count() <= BROADCAST_LABELS:
        good = F.broadcast(good)
    apart = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(5)) == 0
    return docs.join(good, F.col("doc_id") == F.col("_id"), "left").drop("_id").withColumn("apart", apart)


def judged(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, lang, n_events, perplexity, threshold, kept."""
    marked = trusted(docs.select("doc_id", "text", "lang"), labels)
    model = kneser_ney.fit(marked.where("klass = 0 AND NOT apart"), order)
    scored = cut(kneser_ney.score_documents(marked, model, MEASURES), "scored")
    scored = scored.withColumn("perplexity", F.when(F.col("events") > 0, F.exp(-F.col("loglik") / F.col("events"))))
    good = scored.where("klass = 0 AND apart AND perplexity IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("perplexity", SKETCH_K).alias("sketch"))
    whole = good.agg(F.sum("n").alias("all_n"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("all_sketch"))
    good = cut(good, "sketches")
    whole = cut(whole.where("all_n > 0"), "whole")
    langs = scored.select("lang").distinct().join(good.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")), "left").join(F.broadcast(whole))  # whole is one row
    mixed = mixed_quantiles([F.col("sketch"), F.col("all_sketch")], borrowed_weights(F.col("n"), F.col("all_n"), prior=PRIOR), [QUANTILE])[0]
    limits = cut(langs.select(F.col("lang").alias("_lang"), (mixed * SLACK).alias("threshold")), "limits")
    joined = scored.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    threshold = F.col("threshold")
    kept = F.col("perplexity").isNotNull() & (threshold.isNull() | (F.col("perplexity") <= threshold))
    return joined.select("doc_id", "lang", F.col("events").cast("long").alias("n_events"), "perplexity", threshold.alias("threshold"), kept.alias("kept"))


def op2_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_quality_lm": op2_quality_lm}
ORACLES: dict[str, str] = {}
