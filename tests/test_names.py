from pyspark.sql import functions as F

from seqsys.functions.names import accession_key, accession_raw, accession_styles, contig_name, with_accession_style
from seqsys.functions.values import present_text


def test_contig_spellings(spark):
    want = {
        "AB1_01_000": "AB1_01_000", " ab1_01_000\t": "AB1_01_000", ">AB1_01_000": "AB1_01_000", "bins/AB1_01_000.fa": "AB1_01_000", "./x/y/AB1_01_000.fna": "AB1_01_000",
        "AB1_01_000 len=5": "AB1_01_000", "AB1_01_000\tflag=1 multi=2.0": "AB1_01_000", "AB1_01_000\xa0": "AB1_01_000", "AB1_01_000\n": "AB1_01_000", "N/A": None, "": None, "  ": None, "-": None, "unknown": None, None: None, "ＡＢ1_01_000": "AB1_01_000",
    }
    df = spark.createDataFrame([(k,) for k in want], "c string").select("c", contig_name(F.col("c")).alias("n"))
    assert {r.c: r.n for r in df.collect()} == want


def test_accession_spellings_and_styles(spark):
    rows = ["PD00000001.7", "pd00000001", "PD 00000001.12", "ＰＤ００００００01.7", "PD00000002", "PD00000001\r", "P​D00000001", "dnfam_5_00000003",
        "DNFAM_5_00000003", "dnfam_5_4", "NA", "N/A", " ", None, "OG31_99", "OG3199"]
    df = spark.createDataFrame([(r,) for r in rows], "a string").select(accession_key(F.col("a")).alias("k"), accession_raw(F.col("a")).alias("raw"))
    keys = [r.k for r in df.collect()]
    assert keys == ["pd00000001"] * 4 + ["pd00000002"] + ["pd00000001"] * 2 + ["dnfam_5_00000003"] * 2 + ["dnfam_5_4", None, None, None, None, "og31_99", "og3199"]
    counted = df.filter("raw is not null").groupBy("raw").agg(F.count("*").alias("n"))
    keys_once, styles = df.filter("k is not null").select("k").distinct(), accession_styles(counted, "raw", "n")
    out = with_accession_style(keys_once, "k", styles, "out")
    assert set(with_accession_style(keys_once, "k", styles, "out", max_broadcast=0).collect()) == set(out.collect())  # by shuffle as by broadcast
    assert {r.k: r.out for r in out.collect()}["pd00000001"] == "PD00000001"
    assert {r.k: r.out for r in out.collect()}["dnfam_5_00000003"] == "dnfam_5_00000003"


def test_present_text(spark):
    df = spark.createDataFrame([("x",), ("",), (" \t",), (None,), ("None",), ("n/a",), ("none of it",)], "t string").select(present_text(F.col("t")).alias("p"))
    assert [r.p for r in df.collect()] == [True, False, False, False, False, False, True]
