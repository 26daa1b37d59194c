import random
from pathlib import Path

import duckdb
import pytest

from seqforge.llm import decontamination as D

DATA = Path("/root/testdata/sf0.001")
ITEM = " ".join(f"item{i}" for i in range(40))


def test_plants(spark):
    other = " ".join(f"other{i}" for i in range(300))
    changed = ITEM.replace("item39", "new").replace("item0 ", "NEW ")
    rows = [
        (1, f"{other} {ITEM} {other}"), (2, ITEM.upper()), (3, f"a b {changed} c d"), (4, other), (5, None), (6, ""), (7, "item1 item2 item3 item4 item5 item6"),
        (8, f"x {ITEM}"), (8, f"x {ITEM}"), (8, "no match under the same id"), (None, ITEM), (9, ("lorem " * 20_000) + ITEM),
    ]
    docs = spark.createDataFrame([(i, t, 7, "e") for i, t in rows], "doc_id long, text string, item_id long, start string")
    bench = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (None, ITEM), (4, "")], "item_id long, text string")
    got = {(r["id"], r["item_id"]): r for r in D.matches(docs, bench).collect()}
    assert set(got) == {(i, 1) for i in (1, 2, 3, 8, 9, None)}
    assert got[(1, 1)]["similarity"] == 1 and got[(1, 1)]["start"] == 300 and got[(9, 1)]["start"] == 20_000
    assert 0.8 <= got[(3, 1)]["similarity"] < 1
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.where("doc_id <> 5").collect()) == [(4, other), (6, ""), (7, rows[6][1]), (8, "no match under the same id")]
    assert D.matches(docs.limit(0), bench).count() == 0 and D.matches(docs, bench.limit(0)).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_query_against_sql(spark):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    names = "doc_id, item_id, start, n_words, similarity"
    want = sorted(duck.sql(f"SELECT {names} FROM ({D.SQL})").fetchall())
    assert want and sorted(map(tuple, D.op7_decontamination(spark, str(DATA)).select(*names.split(", ")).collect())) == want


def test_the_plan_has_no_python(spark):
    plan = D.op7_decontamination(spark, str(DATA))._jdf.queryExecution().toString() if DATA.exists() else ""
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_fingerprints_within_the_radius_meet_in_a_block():
    rnd = random.Random(3)
    for k in range(500):
        a = rnd.getrandbits(D.BITS)
        b = a
        for bit in rnd.sample(range(D.BITS), rnd.randrange(D.RADIUS + 1) if k % 2 else D.RADIUS):
            b ^= 1 << bit
        assert any(((a >> 16 * j ^ b >> 16 * j) & 0xFFFF).bit_count() <= D.NEAR for j in range(D.BLOCKS))
