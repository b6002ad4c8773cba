import random

import pytest
from pyspark.sql import functions as F

from seqsys.functions.values import rounded
from seqsys.operators import annot, cooc, graph, layout
from seqsys.operators.order import sample_rows
from seqsys.operators.systems import Systems, cluster_scores, cluster_subnetwork

GENES = "contig string, start int, stop int, direction string, accession string, source string"


def test_letters(spark):
    df = spark.createDataFrame([(i,) for i in (0, 25, 26, 27, 701, 702, 18277, 18278)], "i int").select(annot.letters(F.col("i")).alias("s"))
    assert [r.s for r in df.collect()] == ["A", "Z", "AA", "AB", "ZZ", "AAA", "ZZZ", "AAAA"]


def test_sample_is_the_same_for_one_seed(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("g"))
    one = [r.id for r in sample_rows(df, 20, "id").collect()]
    assert one == [r.id for r in sample_rows(df.repartition(5), 20, "id").collect()] and len(set(one)) == 20
    assert one != [r.id for r in sample_rows(df, 20, "id", seed=7).collect()]
    assert {r.g: r["count"] for r in sample_rows(df, 4, "id", per="g").groupBy("g").count().collect()} == {0: 4, 1: 4, 2: 4}


def test_top_pairs_masks_symmetry_and_tail(spark):
    df = spark.createDataFrame([("a", "b", 5), ("b", "a", 5), ("a", "c", 9), ("c", "a", 9), ("b", "c", 1), ("c", "b", 1), ("a", "a", 2)], "a string, b string, v int")
    rows = lambda **kw: [tuple(r) for r in cooc.top_pairs(df, "v", **kw).collect()]
    assert rows(k=2) == [("a", "c", 9), ("c", "a", 9)]
    assert rows(k=9, symmetric=True) == [("a", "c", 9), ("a", "b", 5), ("a", "a", 2), ("b", "c", 1)]
    assert rows(k=1, symmetric=True, tail=True) == [("a", "c", 9, False), ("b", "c", 1, True)]
    assert rows(k=9, keep=(["b"], None), drop=(None, ["a"])) == [("b", "c", 1)]
    assert rows(k=9, keep=(None, F.col("b") > "b"), drop=(F.col("a") == "a", None)) == [("b", "c", 1)]


def test_norms(spark):
    counts = spark.createDataFrame([("a", "b", 2), ("b", "a", 2), ("a", "a", 2), ("b", "b", 1)], "a string, b string, total long")
    singles = spark.createDataFrame([("a", 5, 4, 2), ("b", 4, 3, 3)], "accession string, instances long, contigs long, groups long")
    r = cooc.normalise(counts, singles).filter("a = 'a' and b = 'b'").first()
    got = [r.hyperz_marg, r.jacc_marg, r.cond_marg, r.hyperz_groups, r.jacc_groups, r.cond_groups, r.cond_contigs]
    assert [round(x, 6) for x in got] == [round(x, 6) for x in (2 / 12, 2 / 5, 2 / 4, 2 / 6, 2 / 3, 1.0, 2 / 4)]


def test_norms_of_pairs_counted_as_often_as_both_ends(spark):
    """Two orientations on one contig: the pair counts 2, each accession 1; 1 + 1 - 2 is no divisor."""
    g = spark.createDataFrame([("c", 0, 10, "f", "A", "0"), ("c", 20, 30, "f", "B", "1"), ("c", 40, 50, "r", "A", "2")],
        "contig string, start int, stop int, direction string, accession string, row string")
    counts = cooc.symmetric_counts(cooc.pair_counts(cooc.window_pairs(g, 1000)))
    got = {(r.a, r.b): (r.total, r.jacc_groups, r.jacc_marg) for r in cooc.normalise(counts, cooc.frequencies(g)).collect()}
    assert got == {("A", "A"): (2, float("inf"), 2 / 6), ("A", "B"): (2, float("inf"), 2 / 4), ("B", "A"): (2, float("inf"), 2 / 4)}
    assert {(r.a, r.b): (r.total, r.jacc_groups, r.jacc_marg) for r in cooc.window_norms(g, 1000).collect()} == got


def test_norms_of_windows(spark):
    """Pairs by numbers give the same rows as pairs by names; genes of one start are ordered by their rows."""
    rng = random.Random(4)
    rows = [(f"c{rng.randrange(4)}", s := rng.randrange(0, 9000, 500), s + rng.randrange(100, 3000), rng.choice("fr"), f"A{rng.randrange(9)}") for _ in range(120)]
    g = spark.createDataFrame([(*r, f"{i}:{r[4]}") for i, r in enumerate(rows)], "contig string, start int, stop int, direction string, accession string, row string")
    slow = cooc.normalise(cooc.symmetric_counts(cooc.pair_counts(cooc.window_pairs(g, 1000))), cooc.frequencies(g))
    fast = cooc.window_norms(g, 1000)
    assert fast.columns == slow.columns and sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect()))


def test_rounded(spark):
    x = [1 / 128, -1 / 128, 2.5e-7, -7.25, 0.0, float("inf"), None]
    got = [r.y for r in spark.createDataFrame([(v,) for v in x], "x double").select(rounded("x", 6).alias("y")).collect()]
    assert got == [0.007813, -0.007813, 0.0, -7.25, 0.0, float("inf"), None]


def test_descriptions(spark):
    f = spark.createDataFrame([("X", "one"), ("X", "one"), ("X", "two"), ("Y", "b"), ("Y", "a"), ("Z", None), (None, "q")], "accession string, description string")
    d = annot.descriptions(f)
    assert {tuple(r) for r in d.collect()} == {("X", "one"), ("Y", "a")}
    g = spark.createDataFrame([("X",), ("Y.12",), ("Z",), ("Q.1",)], "accession string")
    assert {r.accession: r.description for r in annot.describe(g, d).collect()} == {"X": "one", "Y.12": "a", "Z": None, "Q.1": None}


def test_instances_within_and_loci(spark):
    rows = [("c", 0, 10, "f", "A", "S"), ("c", 50, 60, "f", "B", "S"), ("c", 500, 510, "r", "A", "S"), ("d", 0, 9, "f", "A", "S"), ("c", 30, 40, "f", "C", "S")]
    g = spark.createDataFrame([(*r, str(i)) for i, r in enumerate(rows)], GENES + ", row string")
    assert {r.row for r in cooc.instances_within(g, "A", "B", 100).collect()} == {"0", "1"}
    lengths = spark.createDataFrame([("c", 600), ("d", 20)], "contig string, length int")
    windows = layout.loci(g.filter("accession = 'A'"), lengths, 20)
    assert {(r.locus, r.start, r.stop) for r in windows.collect()} == {("c_locus_0", 0, 30), ("c_locus_1", 480, 530), ("d", 0, 20)}
    assert {(r.locus, r.row) for r in layout.locus_genes(g, windows).collect()} == {("c_locus_0", "0"), ("c_locus_1", "2"), ("d", "3")}
    assert layout.locus_genes(g, windows, inside=False).count() == 9


def test_cargo_of_samples_and_sources(spark):
    g = spark.createDataFrame([("b", 0, 9, "f", "X", "S"), ("k", 0, 9, "f", "X", "S"), ("k", 0, 9, "f", "N", "T"), ("k", 20, 29, "f", "M", "T")], GENES)
    of = spark.createDataFrame([("b", 0), ("k", 1)], "contig string, cluster int")
    reached = spark.createDataFrame([(0, 0), (0, 1)], "backbone int, cluster int")
    found = lambda **kw: {(r.contig, r.accession) for r in annot.cargo(g, of, reached, **kw).collect()}
    assert found() == {("k", "M")} and found(strict=False) == {("k", "N"), ("k", "M")} and found(strict_sources=["T"]) == {("k", "N"), ("k", "M")}
    seen = spark.createDataFrame([("k", "s1"), ("k", "s2"), ("z", "s3")], "contig string, sample string")
    assert {(r.accession, r.sample) for r in annot.cargo(g, of, reached, detected=seen).collect()} == {("M", "s1"), ("M", "s2")}


def test_vertices_and_edge_attributes(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    v = spark.createDataFrame([("a", 1), ("z", 2)], "node string, n int")
    assert {tuple(r) for r in graph.vertex_table(e, v).collect()} == {("a", 1), ("b", None), ("c", None), ("z", 2)}
    assert {r.node for r in graph.vertex_table(e, v, isolated=False).collect()} == {"a", "b", "c"}
    w = spark.createDataFrame([("a", "b", 5)], "src string, dst string, weight int")
    assert {tuple(r) for r in graph.edge_attributes(e, w, {"weight": 0}).collect()} == {("a", "b", 5), ("b", "c", 0)}
    with pytest.raises(ValueError):
        graph.edge_attributes(e, w.unionAll(w))


def test_subnetwork_and_scores(spark):
    """a in b in c; d is a fragment in c. Samples that a longer path tells of get no edge of their own."""
    rows = [(x, x, 1.0, 100.0, 1.0) for x in "abcd"] + [(*p, 0.95, 99.0, 0.9) for p in ("ab", "ac", "bc", "dc")]
    pairs = spark.createDataFrame(rows, "query string, reference string, coverage double, ANI double, full_ANI double")
    contigs = spark.createDataFrame([("a", 1, True), ("b", 2, True), ("c", 3, False), ("d", 1, False)], "contig string, length int, circular boolean")
    s = Systems(pairs, contigs)
    samples = spark.createDataFrame([(0, "s1"), (1, "s1"), (2, "s2"), (0, "s2"), (3, "s3")], "cluster int, sample string")
    genes = spark.createDataFrame([("X", 1), ("X", 3)], "accession string, cluster int")
    given = spark.createDataFrame([("0", 9, "x"), ("new", 1, "y")], "node string, node_size int, note string")
    nodes, edges = cluster_subnetwork(s, samples=samples, genes=genes, attributes=given)
    assert {(r.src, r.dst, r.weight, r.edge_type) for r in edges.collect()} == {
        ("0", "1", 10, "cluster-cluster"), ("1", "2", 10, "cluster-cluster"), ("1", "s1", 1, "sample-cluster"), ("2", "s2", 1,
            "sample-cluster"), ("X", "1", 1, "gene-cluster")
    }
    assert {(r.node, r.node_type, r.node_size, r.note) for r in nodes.collect()} == {("0", "cluster", 9, "x"), ("1", "cluster", 1, None),
        ("2", "cluster", 1, None), ("s1", "sample", 1, None), ("s2", "sample", 1, None), ("X", "gene", 1, None), ("new", None, 1, "y")}
    of = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("zz", 9.0)], "contig string, score double")
    assert {tuple(r) for r in cluster_scores(s.membership, of).collect()} == {(0, 1.0, 1.0, 1.0), (1, 2.0, 2.0, 2.0)}
    assert cluster_subnetwork(s, clusters=spark.createDataFrame([(0,), (2,)], "cluster int"))[1].select("src", "dst").collect() == [("0", "2")]
