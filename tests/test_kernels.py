"""Kernels by hand and by truth: reads cut from a synthetic genome must map to where they came from."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqforge.functions import cigar as C
from seqforge.functions import scores
from seqforge.functions import sequence as S
from seqforge.operators import kernels as K
from seqforge.operators import flow
from seqforge.operators import mapping as M
from seqforge.operators import pairing, recalibration
from seqforge.operators import reads as R


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("seq, want", [("ACGTN", "NACGT"), ("", ""), ("acgt", "ACGT"), ("TTT", "AAA")])
def test_revcomp(spark, seq, want):
    assert one(spark, S.revcomp("s"), s=seq) == want
    assert one(spark, S.revcomp(S.revcomp("s")), s=seq) == seq.upper()


@pytest.mark.parametrize("kmer, code", [("A" * 18, 0), ("A" * 17 + "C", 1), ("A" * 17 + "N", 0), ("TT", 15)])
def test_kmer_code(spark, kmer, code):
    assert one(spark, S.kmer_code("s"), s=kmer) == code


@pytest.mark.parametrize("length, want", [(100, [*range(0, 82, 9), 82]), (18, []), (27, [0]), (28, [0, 9, 10]), (17, [])])
def test_seed_positions(spark, length, want):
    assert one(spark, R.seed_positions(F.lit(length), 18, 20)) == want


@pytest.mark.parametrize("text, m, nm", [("5=1X4=", "10M", 1), ("3=2I5=", "3M2I5M", 2), ("2S8=1D2=", "2S8M1D2M", 1), ("*", "", 0)])
def test_m_form(spark, text, m, nm):
    assert one(spark, C.render(C.m_form(C.parse("c"))), c=text) == m
    assert one(spark, C.distance(C.parse("c")), c=text) == nm


def test_cigar_algebra(spark):
    p = C.parse("c")
    assert one(spark, C.render(C.concat(p, p)), c="3M2I") == "3M2I3M2I"
    assert one(spark, C.render(C.concat(p, C.parse(F.lit("4I1M")))), c="3M2I") == "3M6I1M"
    assert one(spark, C.render(C.trim_left(p, 4)), c="3M2D5M") == "4M"
    assert one(spark, C.trimmed_reference(p, 4), c="3M2D5M") == 6
    assert one(spark, C.render(C.trim_right(p, 6)), c="3M2D5M") == "2M"
    assert one(spark, C.render(C.unclipped(p)), c="2H3S4M1S") == "4M"
    assert one(spark, C.render(C.reclipped(C.parse(F.lit("2M1I1M")), p)), c="2H3S4M1S") == "2H3S2M1I1M1S"
    assert one(spark, C.left_clip(p), c="2H3S4M1S") == 3
    assert one(spark, C.is_valid(p, 7), c="4M2I1D1M") and not one(spark, C.is_valid(p, 8), c="4M2I1D1M")
    assert one(spark, C.projected(F.lit("ACGTAC"), p), c="2M2I1D2M") == "AC-AC"
    assert one(spark, C.projected_reference(F.lit("ACGTAC"), p, F.lit("GGTCC")), c="2M2I1D2M") == "GGGTCC"


@pytest.mark.parametrize("area, best, second, hits, want", [(100, 100, None, 1, 60), (100, 100, 100, 2, 0), (100, 90, 84, 2, 26), (100, 90, 84, 3, 24)])
def test_mapq(spark, area, best, second, hits, want):
    got = one(spark, scores.mapq(F.lit(area), F.lit(best), F.lit(second), F.lit(hits)))
    assert got == want


@pytest.mark.parametrize("seq, cut, left", [("CCCCCCCCCCACGTACGG", "right", "CCCCCCCCCC"), ("ACGTACGGCCCCCCCCCCCCCCCCCCCCCCCC", "left", "C" * 24), ("T" * 12 + "ACGTACGG" + "T" * 30, "left", "T" * 30), ("T" * 20 + "ACGTACGG" + "T" * 22, "none", None), ("CCCCCCCCCCACGTATTT", "none", None), ("TTTTTTTTTT", "none", None), ("CCCCCCCCCCCCGTACGT", "right", "CCCCCCCCCC")])
def test_adapter(spark, seq, cut, left):
    row = R.trim_adapter(spark.createDataFrame([("r", seq, "I" * len(seq))], "read_id string, seq string, qual string"), "ACGTACGG").first()
    assert (row["adapter_cut"], row["seq"], len(row["qual"])) == (cut, left or seq, len(left or seq))


def brute_alignment(q, r, match=5.0, mismatch=-4.0, go=10.0, ge=0.5):
    n, m = len(q), len(r)
    inf = float("-inf")
    h = [[0.0] * (m + 1) for _ in range(n + 1)]
    e = [[inf] * (m + 1) for _ in range(n + 1)]
    f = [[inf] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            e[i][j] = max(h[i][j - 1] - go, e[i][j - 1] - ge)
            f[i][j] = max(h[i - 1][j] - go, f[i - 1][j] - ge)
            h[i][j] = max(0, h[i - 1][j - 1] + (match if q[i - 1] == r[j - 1] else mismatch), e[i][j], f[i][j])
    return max(map(max, h))


def test_smith_waterman_against_brute_force():
    rnd = random.Random(4)
    for _ in range(200):
        r = "".join(rnd.choice("ACGT") for _ in range(rnd.randrange(1, 50)))
        q = list(r[rnd.randrange(len(r)) :])
        for _ in range(rnd.randrange(4)):
            k = rnd.randrange(len(q) + 1)
            q[k : k + rnd.randrange(3)] = [rnd.choice("ACGTN") for _ in range(rnd.randrange(6))]
        q = "".join(q)
        score, qs, qe, rs, re_, text = K.local_alignment(q, r)
        assert score == brute_alignment(q, r), (q, r)
        ops = K._parsed(text)
        assert sum(n for n, o in ops if o in "=XI") == qe - qs and sum(n for n, o in ops if o in "=XD") == re_ - rs
        gaps = [n for n, o in ops if o in "ID"]
        again = sum(5 * n if o == "=" else -4 * n if o == "X" else 0 for n, o in ops) - sum(10 + 0.5 * (n - 1) for n in gaps)
        assert abs(again - score) < 1e-9
    assert K.local_alignment("ANGT", "ANGT")[0] == 20 and K.local_alignment("", "A")[0] == 0


def test_extension_and_chain():
    assert K.extend("ACGTACGTAC", "ACGTACGTACTT")[:4] == (10, 10, 10, 0)
    assert K.extend("ACGTTCGTACGG", "ACGTACGTACGG")[3] == 1
    assert "1I" in K.extend("ACGTACCGTACGATCGATCC", "ACGTACGTACGATCGATCC")[-1]
    f = np.array([(0, 9, 100, 109), (12, 20, 112, 120), (25, 40, 125, 140), (11, 19, 900, 908)]).T
    rows, score = K.chains(np.zeros(4, int), *f)
    assert rows.tolist() == [0, 1, 2] and score.tolist() == [35]
    assert K.left_aligned("ACAAAAGT", "5M1I2M", "ACAAAGT") == "2M1I5M"
    assert K.left_aligned("ACGT", "4M", "ACGT") == "4M"


@pytest.fixture(scope="module")
def genome():
    rnd = random.Random(7)
    return {c: "".join(rnd.choice("ACGT") for _ in range(20_000)) for c in (0, 1)}


def simulated(genome, n, seed, errors):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        c, s = rnd.randrange(2), rnd.randrange(19_800)
        seq = list(genome[c][s : s + 100])
        for _ in range(errors):
            k = rnd.randrange(5, 95)
            kind = rnd.random()
            if kind < 0.8:
                seq[k] = rnd.choice([b for b in "ACGT" if b != seq[k]])
            elif kind < 0.9:
                seq[k:k] = [rnd.choice("ACGT")]
            else:
                del seq[k]
        seq = "".join(seq)
        strand = rnd.randrange(2)
        if strand:
            seq = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
        rows.append((f"{c}_{s}_{s + 99}_{strand}_{i}", seq, "I" * len(seq)))
    return rows


@pytest.mark.parametrize("errors, least", [(0, 1.0), (1, 0.99), (3, 0.97)])
def test_reads_map_to_their_origin(spark, genome, errors, least):
    contigs = spark.createDataFrame(list(genome.items()), "contig long, bases string")
    reference, index = M.windows(contigs, 1024), M.kmer_index(M.windows(contigs, 1024, M.K - 1))
    reads = spark.createDataFrame(simulated(genome, 200, errors, errors), "read_id string, seq string, qual string")
    got = flow.map_reads(reads, reference, index, width=1024).toPandas()
    t = got["read_id"].str.split("_", expand=True)
    right = (t[0].astype(int) == got["contig"]) & ((t[1].astype(int) - got["pos"]).abs() <= 5) & (t[3].astype(int) == got["strand"])
    assert got.loc[right, "read_id"].nunique() >= least * 200
    if not errors:
        assert set(got["cigar"]) == {"100="} and (got.loc[right, "pos"] == t[1].astype(int)[right]).all()


def test_realigned_reads_get_the_indel(spark, genome):
    from seqforge.operators import realign

    g = genome[0]
    rows = []
    for i in range(24):  # a deletion of 3 at 5040; every third read shows it as mismatches; two others carry another one
        s = 5000 + i
        if i < 20:
            seq, cut = g[s:5040] + g[5043 : 5043 + 60 - (5040 - s)], 5040 - s
            cigar = f"{cut}M3D{60 - cut}M" if i % 3 else "60M"
        else:
            seq, cut = g[s:5045] + g[5047 : 5047 + 60 - (5045 - s)], 5045 - s
            cigar = f"{cut}M2D{60 - cut}M"
        rows.append((f"r{i}", 0, s, 30 if i else 255, cigar, seq, "I" * 60))
    al = spark.createDataFrame(rows, "read_id string, contig long, pos long, mapq int, cigar string, seq string, qual string")
    reference = M.windows(spark.createDataFrame(list(genome.items()), "contig long, bases string"), 1024)
    got = {r["read_id"]: r for r in realign.realign(al, reference, 1024).collect()}
    assert len(got) == 24
    fixed = [got[f"r{i}"] for i in range(3, 20, 3)]
    assert all("3D" in r["cigar"] and r["mapq"] == 40 for r in fixed), [(r["read_id"], r["cigar"]) for r in fixed]
    assert got["r0"]["mapq"] == 255


def test_recalibration_learns_the_error_rate(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(300):
        seq = "".join(rnd.choice("ACGT") for _ in range(50))
        ref = "".join(rnd.choice([x for x in "ACGT" if x != b]) if rnd.random() < 0.01 else b for b in seq)
        rows.append((i, seq, chr(33 + 30) * 50, "50M", ref))
    al = spark.createDataFrame(rows, "read_id long, seq string, qual string, cigar string, reference string")
    table = recalibration.fit(al)
    new = [ord(c) - 33 for r in recalibration.apply(al, table).select("qual").collect() for c in r["qual"]]
    assert 18 <= sorted(new)[len(new) // 2] <= 23
    exploded = recalibration.new_qualities(recalibration.explode_bases(al), table)
    assert sorted(r["new_q"] for r in exploded.collect()) == sorted(new)


def test_insert_size_needs_fragments(spark):
    frag = lambda n: [(i, m, 0, i, 1000 + (m - 1) * 400, 1100 + (m - 1) * 400) for i in range(n) for m in (1, 2)]
    schema = "fragment long, mate int, contig long, id long, start long, end long"
    assert tuple(pairing.insert_size(spark.createDataFrame(frag(11), schema)).first()) == (201, 801)
    assert tuple(pairing.insert_size(spark.createDataFrame(frag(10), schema)).first()) == (200, 800)
    assert tuple(pairing.insert_size(spark.createDataFrame([], schema)).first()) == (200, 800)


def spliced_genome():
    """Two contigs of exons of 150 bases and introns of 300 to 900, from GT to AG."""
    rnd = random.Random(17)
    base = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    contigs, exons = {}, {}
    for c in (0, 1):
        text, spans = base(500), []
        for _ in range(8):
            spans.append((len(text), len(text) + 150))
            text += base(150) + "GT" + base(rnd.randrange(300, 900)) + "AG"
        contigs[c], exons[c] = text + base(500), spans
    return contigs, exons


def test_spliced_reads_map_over_their_introns(spark):
    """Reads of transcripts, with errors: the reference places that a CIGAR spells are those that the read came from."""
    from seqforge.operators import spliced

    contigs, exons = spliced_genome()
    rnd = random.Random(18)
    rows, truth = [], {}
    for i in range(160):
        c = rnd.randrange(2)
        places = [p for s, e in exons[c] for p in range(s, e)]
        at = rnd.randrange(len(places) - 100)
        own = places[at : at + 100]
        seq = [contigs[c][p] for p in own]
        for _ in range(i % 2):
            k = rnd.randrange(100)
            seq[k] = rnd.choice([b for b in "ACGT" if b != seq[k]])
        seq = "".join(seq)
        strand = rnd.randrange(2)
        rows.append((i, seq[::-1].translate(str.maketrans("ACGT", "TGCA")) if strand else seq, "I" * 100))
        truth[i] = (c, strand, own)
    frame = spark.createDataFrame(list(contigs.items()), "contig long, bases string")
    reference, index = M.windows(frame, 1024), M.kmer_index(M.windows(frame, 1024, M.K - 1))
    got = spliced.map_spliced(spark.createDataFrame(rows, "read_id long, seq string, qual string"), reference, index, width=1024).collect()
    right, spliced_right, spliced_all = 0, 0, sum(own[-1] - own[0] > 99 for _, _, own in truth.values())
    for r in got:
        c, strand, own = truth[r["read_id"]]
        at, spelled, clip = r["pos"], [], 0
        for n, o in K._parsed(r["cigar"]):
            if o == "M":
                spelled += range(at, at + n)
            if o == "S":
                clip += n
            at += n if o in "MDN" else 0
        lead = K._parsed(r["cigar"])[0]
        first = lead[0] if lead[1] == "S" else 0
        ok = r["contig"] == c and r["strand"] == strand and spelled == own[first : first + len(spelled)] and clip < 40  # an anchor takes 18 bases and a place for a seed
        right += ok
        spliced_right += ok and own[-1] - own[0] > 99
    assert spliced_all > 60 and right >= 150 and spliced_right >= 0.9 * spliced_all


def test_known_junctions_close_ends(spark):
    """Queries cut from either side of an intron, against plain comparison."""
    from seqforge.operators import spliced

    contigs, exons = spliced_genome()
    text, ((_, e1), (s2, _), *_) = contigs[0], exons[0]
    frame = spark.createDataFrame(list(contigs.items()), "contig long, bases string")
    reference = M.windows(frame, 1024)
    junctions = spark.createDataFrame([(0, 0, e1 + 1, s2), (0, 0, e1 + 1, s2 + 40)], "strand long, contig long, start long, end long")
    right = spark.createDataFrame([(n, 0, 0, e1 - n, text[e1 - n : e1] + text[s2 : s2 + 20]) for n in range(6)], "id long, strand long, contig long, place long, query string")
    got = {r["id"]: (r["l"], r["j_start"], r["j_end"], r["errors"]) for r in spliced.extend_right_anchor(right, junctions, reference, 1024).collect()}
    assert got == {n: (n, e1 + 1, s2, 0) for n in range(6)}
    left = spark.createDataFrame([(n, 0, 0, s2 + n, text[e1 - 20 : e1] + text[s2 : s2 + n]) for n in range(6)], "id long, strand long, contig long, place long, query string")
    got = {r["id"]: (r["r"], r["j_start"], r["j_end"], r["errors"]) for r in spliced.extend_left_anchor(left, junctions, reference, 1024).collect()}
    assert got == {n: (n, e1 + 1, s2, 0) for n in range(6)}


def test_base_sums_make_no_row_for_a_base(spark):
    """The sums from counts by cell are those of the exploded bases, and their plan explodes no read."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        n = rng.randrange(1, 60)
        seq = "".join(rng.choice("ACGTN") for _ in range(n))
        cigar = f"{n}M" if n < 10 else rng.choice([f"{n}M", f"{n // 2}M2D{n - n // 2}M", f"{n // 2}M2I{n - n // 2 - 2}M"])
        rows.append((i, seq, "".join(chr(33 + rng.randrange(0, 41)) for _ in range(n)), cigar, "".join(rng.choice("ACGT") for _ in range(n + 2))))
    a = spark.createDataFrame(rows, "read_id long, seq string, qual string, cigar string, reference string")
    want = recalibration.explode_bases(a).groupBy("cycle", "miss").agg(F.count("*").alias("n"), F.sum("q").alias("sum_q"), F.sum("dinuc").alias("sum_dinuc"))
    got = recalibration.base_sums(recalibration.cells(a))
    assert sorted(tuple(r) for r in got.select(want.columns).collect()) == sorted(tuple(r) for r in want.collect())
    from seqforge.plans import catalog

    plan = catalog.QUERIES["B01_explode_bases"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "explode(sequence(" not in plan
