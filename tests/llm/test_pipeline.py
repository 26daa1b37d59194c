"""The stages against a plain version on the smallest tables."""

import hashlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest
from tokenizers import Tokenizer as Library

import corpus_pipeline as P
from seqforge.llm import bpe, decontamination, language_id
from test_line_dedup import brute as brute_lines
from test_near_dedup import brute as brute_classes

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    judge = language_id.Classifier(language_id.fit(docs))
    rows = []
    for r in docs.select("doc_id", "text").collect():
        if not judge(r["text"])[3]:
            rows.append((r["doc_id"], r["text"]))
    lines = brute_lines(rows, 10)
    rows = [(i, lines[(i, t)]) for i, t in rows]
    group = brute_classes(rows)
    rows = [(i, t) for i, t in rows if group[i] == i]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    duck.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{DATA}/benchmark.parquet'")
    leaks = {r[0] for r in duck.sql(f"SELECT doc_id FROM ({decontamination.SQL})").fetchall()}
    library = Library.from_file(bpe.tokenizer_path())
    want = []
    for i, t in rows:
        if i not in leaks:
            ids = library.encode(t, add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = P.run(spark, str(DATA)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and leaks


def test_edges(spark, tmp_path):
    """Nulls in any column, repeated rows, rows that share an id, further columns and the empty table."""
    spark.createDataFrame([(1, "five words are not enough here for an item of a benchmark"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    en = "the river was high and they walked along the bank until it was dark"
    rows = [(1, f"{en} first", "en", "a", None, "k"), (2, f"{en} first", "en", None, 3, None), (2, f"{en} first", None, None, 3, None), (3, None, "en", "a", 0, "k"), (4, "", None, "a", 0, "k"), (None, f"{en} of nobody", None, None, None, None), (5, "123", "en", "a", 3, "k"), (6, "un autre texte assez court pour la rive", "fr", "a", 3, "k"), (7, "one text under seven", "en", "a", 1, "k"), (7, "two texts under seven", "en", "a", 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string")
    for some in (docs, docs.limit(0)):
        kept = some
        for _, stage in P.STAGES[:-1]:
            kept = stage(spark, kept, str(tmp_path))
            assert kept.columns == docs.columns
        out = P.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
        ids = defaultdict(int)
        for r in out:
            ids[r["doc_id"]] += 1
        assert set(ids) <= {1, 6, 7, None} and (some is docs) == bool(ids)
        assert ids[2] == ids[3] == ids[4] == ids[5] == 0
        assert some is not docs or ids[7] == 2  # two texts under one id


def test_rows_that_share_ids(spark, tmp_path):
    """Of near copies one stays, whatever their ids; other texts under the same id, or none, stay."""
    words = [f"w{k}" for k in range(400)]
    copy = lambda k: " ".join(words[:60] + [f"x{k}"])
    rows = [(1, copy(1)), (1, copy(2)), (None, copy(3)), (1, " ".join(words[100:160])), (None, " ".join(words[200:260])), (None, " ".join(words[300:360])), (None, " ".join(words[300:360])), (8, "\n"), (8, "\n")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in P.near_copies(spark, docs, "").collect()), key=str)
    (one,) = [t for i, t in got if t.startswith("w0 ")]
    assert one in (copy(1), copy(2))
    assert got == sorted([(1, one), *rows[3:6], *rows[7:]], key=str)
