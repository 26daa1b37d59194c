from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

from seqforge.llm import line_dedup as L

DATA = Path("/root/testdata/sf0.001")
SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, least):
    having = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            having[key(line)].add(i)
    return {(i, t): "\n".join(x for x in (t or "").split("\n") if not key(x) or len(having[key(x)]) < least) for i, t in rows}


ROWS = [(i, f"Common Line \n own {i}\n\n common line") for i in range(12)] + [(50, None), (51, ""), (52, "COMMON LINE"), (53, "É\n\n\n"), (54, "x\r\ncommon line"), (0, "Common Line \n own 0\n\n common line"), (0, "another text of id 0\ncommon line"), (60, "long\n" * 5000 + "common line")]


@pytest.mark.parametrize("partitions", [1, 7])
def test_against_brute_force(spark, partitions):
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in ROWS], "doc_id long, text string, bitmap string, _th int").repartition(partitions)
    out = L.apply_bitmaps(df, L.keep_bitmaps(df, min_docs=10))
    want = brute(ROWS, 10)
    rows = out.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert (r["kept"]["text"] or "") == want[(r["doc_id"], r["text"])]
        assert r["kept"]["n_lines"] == len((r["text"] or "").split("\n"))
        assert r["bitmap"] == "z"


def test_first_occurrence_stays(spark):
    df = spark.createDataFrame([(i, f"same\nown {i}") for i in range(20)], "doc_id long, text string")
    out = L.apply_bitmaps(df, L.keep_bitmaps(df, min_docs=10, keep="first")).collect()
    assert {r["doc_id"]: r["kept"]["text"] for r in out} == {i: ("same\n" if i == 0 else "") + f"own {i}" for i in range(20)}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.apply_bitmaps(df, L.keep_bitmaps(df)).count() == 0


def test_null_ids_count_as_one_document(spark):
    df = spark.createDataFrame([(None, "same")] * 9 + [(i, "same") for i in range(9)], "doc_id long, text string")
    assert {r["kept"]["text"] for r in L.apply_bitmaps(df, L.keep_bitmaps(df)).collect()} == {""}
    df = spark.createDataFrame([(None, "same")] * 12, "doc_id long, text string")
    assert {r["kept"]["text"] for r in L.apply_bitmaps(df, L.keep_bitmaps(df)).collect()} == {"same"}


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_query_against_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    want = sorted(duck.sql(f"SELECT {', '.join(names)} FROM ({L.SQL})").fetchall())
    assert sorted(map(tuple, L.op9_line_dedup(spark, str(DATA)).select(*names).collect())) == want
