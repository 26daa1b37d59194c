from pathlib import Path

import pytest
import zstandard
from pyspark.sql import functions as F

from seqforge.llm import language_id as L

DATA = Path("/root/testdata/sf0.01")
EN = "the river was high and they walked along the bank until it was dark "
FR = "la rivière était haute et ils marchaient le long de la rive jusqu'à la nuit "


def labelled(spark):
    rows = [(i, (EN if i % 2 else FR) * 4 + f" {i}", "en" if i % 2 else "fr") for i in range(60)]
    return spark.createDataFrame(rows + [(None, EN, "xx"), (99, EN, None), (98, None, "en")], "doc_id long, text string, lang string")


def test_edges(spark):
    known = L.fit(labelled(spark))
    assert set(known) == {"en", "fr"}
    rows = [(1, None, "a"), (2, "", "a"), (3, "123 !?\n", None), (4, EN, "a"), (4, EN, "a"), (None, FR.upper(), "a"), (6, EN * 3000, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {(r["doc_id"], r["text"]): r for r in L.classify(df, known).collect()}
    assert {k: r["lang_pred"] for k, r in got.items()} == {(1, None): "und", (2, ""): "und", (3, "123 !?\n"): "und", (4, EN): "en", (None, FR.upper()): "fr", (6, EN * 3000): "en"}
    assert all(0 <= r["lang_score"] <= 1 for r in got.values())
    assert all(r["lang_rejected"] for k, r in got.items() if r["lang_pred"] == "und")
    assert L.classify(df.limit(0), known).count() == 0
    nothing = L.fit(df.limit(0).withColumn("lang", F.lit("en")))
    assert nothing == {} and {r["lang_pred"] for r in L.classify(df, nothing).collect()} == {"und"}


def test_narrow_margins_are_rejected(spark):
    known = L.fit(labelled(spark))
    df = spark.createDataFrame([(1, EN * 3)], "doc_id long, text string")
    assert L.classify(df, known, min_margin=0.0).first()["lang_rejected"] is False
    assert L.classify(df, known, min_margin=0.99).first()["lang_rejected"] is True


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    out = L.op8_language_id(spark, str(DATA)).where("held_out").join(docs, "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'")
    n, right = out.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 200 and right / n > 0.97


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_against_plain_compression(spark):
    """Every text with every dictionary, block by block, by zstandard alone."""
    docs = spark.read.parquet(str(DATA.parent / "sf0.001" / "documents.parquet"))
    known = L.fit(docs)
    rows = docs.select("doc_id", "text").collect() + [(9001, "Ja"), (9002, EN + FR), (9003, None)]
    want = {}
    for i, text in rows:
        if not text or not any(c.isalpha() for c in text):
            want[i] = ("und", True)
            continue
        raw = text.lower().encode().translate(None, bytes(c for c in range(128) if not chr(c).isalpha() and c not in b" \n"))
        sizes = []
        for lang, content in known.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            size = 0
            for at in range(0, max(1, len(raw)), L.BLOCK):
                size += len(zstandard.ZstdCompressor(level=L.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw[at : at + L.BLOCK]))
            sizes.append((size, len(sizes), lang))
        (best, _, lang), (second, *_), *_ = sorted(sizes)
        want[i] = (lang, second - best < L.MIN_MARGIN * second - L.ROUNDING)
    frame = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string")
    assert {r["doc_id"]: (r["lang_pred"], r["lang_rejected"]) for r in L.classify(frame, known).collect()} == want
