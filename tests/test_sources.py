import gzip

import pytest

from seqforge.operators.alignments import sam_header
from seqforge.operators.mapping import windows
from seqforge.sources import sinks, tables
from seqforge.sources import text_records as T
from seqforge.streaming import mates


def fastq(n, tag="r"):
    return "".join(f"@{tag}{i} more words\n{'ACGTN'[i % 5] * (5 + i % 7)}\n+\n{'@I'[i % 2] * (5 + i % 7)}\n" for i in range(n))


def test_fastq_over_splits_and_gzip(spark, tmp_path):
    (tmp_path / "a.fq").write_text(fastq(500))
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write(fastq(30, "z"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = T.read_fastq(spark, [str(tmp_path / "a.fq"), str(tmp_path / "b.fq.gz")]).orderBy("file", "ordinal").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["read_id"] for r in got] == [f"r{i}" for i in range(500)] + [f"z{i}" for i in range(30)]
    assert all(len(r["seq"]) == len(r["qual"]) for r in got) and got[3]["seq"] == "T" * 8


def test_fastq_errors_and_pairs(spark, tmp_path):
    (tmp_path / "a.fq").write_text(fastq(7))
    (tmp_path / "b.fq").write_text(fastq(7, "m"))
    (tmp_path / "c.fq").write_text(fastq(6, "m"))
    (tmp_path / "d.fq").write_text("@x\nACGT\n+\nII\n")
    pairs = T.read_fastq_pairs(spark, [str(tmp_path / "a.fq")], [str(tmp_path / "b.fq")])
    assert pairs.count() == 14 and {r["mate"] for r in pairs.collect()} == {1, 2}
    with pytest.raises(ValueError):
        T.read_fastq_pairs(spark, ["a"], [])
    with pytest.raises(Exception, match="different numbers"):
        T.read_fastq_pairs(spark, [str(tmp_path / "a.fq")], [str(tmp_path / "c.fq")]).collect()
    with pytest.raises(Exception, match="not a FASTQ record"):
        T.read_fastq(spark, str(tmp_path / "d.fq")).collect()


def test_fastq_round_trip(spark, tmp_path):
    (tmp_path / "a.fq").write_text(fastq(40))
    reads = T.read_fastq(spark, str(tmp_path / "a.fq"))
    sinks.write_fastq(reads, str(tmp_path / "out"))
    again = T.read_fastq(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, again.select("read_id", "seq", "qual").collect())) == sorted(map(tuple, reads.select("read_id", "seq", "qual").collect()))


def test_fasta(spark, tmp_path):
    body = {"one": "acgtRN" * 50, "two": "G" * 301, "three": ""}
    (tmp_path / "g.fa").write_text("".join(f">{k} text\n" + "".join(v[i : i + 60] + "\n" for i in range(0, len(v), 60)) for k, v in body.items()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        fa = T.read_fasta(spark, str(tmp_path / "g.fa"))
        sizes = {r["name"]: r["length"] for r in T.contigs_of(fa).collect()}
        assert sizes == {"one": 300, "two": 301, "three": 0}
        got = {(r["contig"], r["start"]): r["bases"] for r in T.windows_of(fa, 128, 5).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    clean = {k: "".join(c if c in "ACGT" else "N" for c in v.upper()) for k, v in body.items()}
    assert got == {(k, s): v[s : s + 133] for k, v in clean.items() for s in range(0, len(v), 128)}
    contigs = spark.createDataFrame(list(clean.items()), "contig string, bases string")
    direct = {(r["contig"], r["start"]): r["bases"] for r in windows(contigs, 128, 5).where("bases <> ''").collect()}
    assert direct == got


def test_tables(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('#c\n1\tx\texon\t10\t20\t.\t+\t.\tgene_id "g"; transcript_id "t"; exon_number "2"; exon_id "e";\n1\tx\tCDS\t10\t20\t.\t+\t.\tgene_id "g";\n9\tx\texon\t1\t2\t.\t-\t.\tgene_id "h"; transcript_id "u";\n')
    known = spark.createDataFrame([("1",)], "name string")
    assert [tuple(r) for r in tables.read_gtf(spark, str(tmp_path / "a.gtf"), known).collect()] == [("1", 0, 10, 20, 2, "g", "t", "e")]
    assert tables.read_gtf(spark, str(tmp_path / "a.gtf")).count() == 2
    assert [tuple(r) for r in tables.parse_regions(spark, "1:3000-3200,HLA:A:100-200").collect()] == [("1", 3000, 3200), ("HLA:A", 100, 200)]
    for bad in ("1:5", "1:9-3", ":1-2"):
        with pytest.raises(ValueError):
            tables.parse_regions(spark, bad)


@pytest.mark.parametrize("text, want", [("10,20", (10, 20)), ("10", (10, 100_000)), (",20", (0, 20)), ("10,", (10, 100_000)), (None, (0, 100_000)), ("20,10", None), ("-1", None)])
def test_ranges(text, want):
    if want is None:
        with pytest.raises(ValueError):
            tables.parse_range(text)
    else:
        assert tables.parse_range(text) == want


def test_sam_round_trip(spark, tmp_path):
    header = sam_header(spark.createDataFrame([("chr1", 100)], "name string, length long"))
    rows = spark.createDataFrame([("q", 16, "chr1", 5, 60, "4M", "=", 9, 8, "ACGT", "IIII", "AS:i:4\tNM:i:0"), ("u", 4, "*", 0, 0, "*", "*", 0, 0, "AC", "II", "")], "qname string, flag long, rname string, pos long, mapq long, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags string")
    sinks.write_sam(header, rows, str(tmp_path / "s"))
    got = {r["qname"]: r for r in tables.read_sam(spark, str(tmp_path / "s")).collect()}
    assert (got["q"]["pos"], got["q"]["mcontig"], got["q"]["mpos"], got["q"]["nm"]) == (4, "chr1", 8, 0)
    assert got["u"]["contig"] is None and got["u"]["nm"] is None
    assert [tuple(r) for r in tables.sam_contigs(spark, str(tmp_path / "s")).collect()] == [("chr1", 100)]


def test_streamed_mates(spark, tmp_path):
    rows = [("a", 65, "1", 10, 90), ("b", 65, "1", 5, 6), ("a", 129, "1", 90, 10), ("b", 129, "1", 7, 5), ("b", 129, "2", 6, 5), ("c", 321, "1", 1, 1)]
    for k in range(0, 6, 2):
        spark.createDataFrame(rows[k : k + 2], "qname string, flag int, contig string, pos long, mpos long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qname string, flag int, contig string, pos long, mpos long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = mates.match_mates(stream).writeStream.outputMode("append").format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("pairs").collect())) == [("a", "1", 10, "1", 90), ("b", "1", 5, "2", 6)]
