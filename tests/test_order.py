from pyspark.sql import functions as F

from seqsys.operators import annot, layout
from seqsys.operators.order import number_rows


def test_number_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v")).repartition(7)
    got = [r.i for r in number_rows(df, ["v"]).orderBy("v").collect()]
    assert got == list(range(1000))
    assert number_rows(df.limit(0), ["v"]).count() == 0


def test_symbols_and_ribbons(spark):
    acc = spark.createDataFrame([("x", 3), ("y", 2), ("z", 2), ("w", 9)], "accession string, contigs long")
    anchors = spark.createDataFrame([(0, "w")], "position int, accession string")
    got = {r.accession: r.symbol for r in annot.symbols(acc, anchors, [F.col("contigs").desc()]).collect()}
    assert got == {"w": "A", "x": "0", "y": "1", "z": "2"}
    windows = spark.createDataFrame([("a", "a", 0, 50), ("b", "b", 10, 80), ("c", "c", 0, 9)], "contig string, locus string, start int, stop int")
    blocks = spark.createDataFrame([("b", "a", 5, 44, 60, 21, 4), ("c", "a", 1, 5, 1, 5, 0)],
        "ref string, query string, ref_start int, ref_end int, query_start int, query_end int, errors int")
    (r,) = layout.ribbons(blocks, windows, ["contig", "start"]).collect()
    assert (r.query_locus, r.ref_locus, r.query_from, r.query_to, r.ref_from, r.ref_to, r.reversed, r.identity) == ("a", "b", 20, 50, 10, 44, True, 0.9)
