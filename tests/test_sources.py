"""Written, then read."""

import gzip
import json

import pytest

from strandlake.sources import tables


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_tsv_gzip_and_columns(spark, tmp_path):
    with gzip.open(tmp_path / "a.persite.gz", "wt") as f:
        f.write("2\t5\t0.5\t1\n2\t9\tNA\t2\n3\t9\t1\t2\n")
    path = str(tmp_path / "a.persite.gz")
    assert rows(tables.read_tsv(spark, path, "site_parts", ["pos", "B"])) == [(5, 1.0), (9, 2.0), (9, 2.0)]
    read = tables.read_tsv(spark, path, "site_parts")
    assert rows(tables.region(read, "2", 6, 10)) == [("2", 9, None, 2.0)]
    (tmp_path / "bad.tsv").write_text("2\tx\t1\t1\n")
    with pytest.raises(Exception):
        tables.read_tsv(spark, str(tmp_path / "bad.tsv"), "site_parts").collect()


def test_csv_with_header(spark, tmp_path):
    (tmp_path / "g.csv").write_text("c,s,e\nchr1,0,5\nchr2,,7\n")
    assert rows(tables.read_csv(spark, str(tmp_path / "g.csv"), "genes")) == [("chr1", 0, 5), ("chr2", None, 7)]
    (tmp_path / "h.csv").write_text("c,e,s\nchr1,0,5\n")
    with pytest.raises(Exception):
        tables.read_csv(spark, str(tmp_path / "h.csv"), "genes").collect()


def test_spectra(spark, tmp_path):
    (tmp_path / "a.sfs").write_text("1.5 2 3.0 \n")
    assert rows(tables.read_spectrum(spark, str(tmp_path / "a.sfs"), 3).select("i", "v")) == [(0, 1.5), (1, 2.0), (2, 3.0)]
    with pytest.raises(Exception):
        tables.read_spectrum(spark, str(tmp_path / "a.sfs"), 5).collect()
    with pytest.raises(Exception):
        tables.read_spectrum(spark, str(tmp_path / "a.sfs"), square=True).collect()
    (tmp_path / "b.2dsfs").write_text("1 2\n".replace("\n", " ") + "3 4\n")
    assert rows(tables.read_spectrum(spark, str(tmp_path / "b.2dsfs"), square=True).select("i", "j", "v")) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)]


def test_gff(spark, tmp_path):
    (tmp_path / "a.gff").write_text("##gff\nc1\tx\tgene\t11\t20\t.\t+\t.\tID=g1;Name=a\nc1\tx\tmRNA\t11\t20\t.\t+\t.\tID=t1;Parent=g1\nc1\tx\texon\t1\t2\t.\t+\t.\tID=e\n")
    assert rows(tables.read_gff(spark, str(tmp_path / "a.gff"))) == [("c1", "gene", 10, 20, "+", "g1", None), ("c1", "mRNA", 10, 20, "+", "t1", "g1")]


def test_vcf_counts_skip_missing_calls(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##f\n#CHROM\tPOS\tID\tREF\tALT\tQ\tF\tI\tFORMAT\ts1\ts2\ts3\nc\t5\t.\tA\tG\t.\t.\t.\tGT:DP\t0|1:3\t./.:0\t1/1:2\nc\t6\t.\tA\tG,T\t.\t.\t.\tGT\t0|1\t0|0\t1|2\nc\t7\t.\tAT\tG\t.\t.\t.\tGT\t0|1\t0|0\t1|1\n")
    people = spark.createDataFrame([("s1", "AA"), ("s2", "BB"), ("s3", "AA")], "sample string, population string")
    calls = tables.read_vcf(spark, str(tmp_path / "a.vcf"), people)
    assert calls.count() == 6 and calls.filter("allele is null").count() == 2
    assert rows(tables.allele_counts(calls)) == [("c", 5, "A", "G", "AA", 3, 4)]


def test_replicates_and_reports(spark, tmp_path):
    path = str(tmp_path / "reps")
    frame = spark.createDataFrame([("a", 0, "pi", 1.0), ("a", 0, "fst", 2.0), ("a", 1, "pi", 3.0), ("b", 0, "pi", 4.0)], "engine string, rep int, stat string, value double")
    tables.write_replicates(frame, path)
    tables.write_replicates(spark.createDataFrame([("a", 1, "pi", 5.0)], frame.schema), path)
    read = spark.read.parquet(path).select("engine", "rep", "stat", "value")
    assert rows(read) == [("a", 0, "fst", 2.0), ("a", 0, "pi", 1.0), ("a", 1, "pi", 5.0), ("b", 0, "pi", 4.0)]
    assert rows(tables.stacked(read).select("engine", "stat").distinct()) == [("a", "pi"), ("b", "pi")]
    with gzip.open(tmp_path / "r.jsonl.gz", "wt") as f:
        f.write('{"rep": 1, "sfs": [1, 2.5]}\n{"rep": 2, "sfs": null}\n')
    assert rows(tables.read_replicates(spark, str(tmp_path / "r.jsonl.gz"), "rep long, sfs array<double>")) == [(1, [1.0, 2.5]), (2, None)]
    for k in (1, 2):
        tables.append_tsv(spark.createDataFrame([(k, "ok", 0.5)], "seed long, status string, wall double"), str(tmp_path / "parts"))
    assert rows(tables.read_tsv_parts(spark, str(tmp_path / "parts"), "seed long, status string, wall double")) == [(1, "ok", 0.5), (2, "ok", 0.5)]
    tables.write_report(spark, {"n": 3, "a": "x"}, str(tmp_path / "report"))
    assert json.loads(spark.read.text(str(tmp_path / "report.json")).first()[0]) == {"a": "x", "n": 3}
    assert [r[0] for r in spark.read.text(str(tmp_path / "report.txt")).collect()] == ["a\tx", "n\t3"]


def test_written_tsv_is_read_back(spark, tmp_path):
    frame = spark.createDataFrame([("c", 1, None, 2.0), ("d", 2, 0.25, 3.0)], "chrom string, pos long, A double, B double")
    for compress in (False, True):
        tables.write_tsv(frame, str(tmp_path / "t"), header=False, compress=compress)
        assert rows(tables.read_tsv(spark, str(tmp_path / "t"), "site_parts")) == rows(frame)
    assert tables.rescaled(spark.createDataFrame([(1.5,)], "time double"), 1000.0).first()[0] == 3000.0
