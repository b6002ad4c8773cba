import os
from xml.etree import ElementTree

import pytest

from seqsys import cli
from seqsys.operators import layout
from seqsys.session import Scratch, checkpoint_dir, release
from seqsys.sources import readers, sinks


def test_fasta_flags_pairs_delta(spark, tmp_path):
    (tmp_path / "s.fa").write_text(">a one\nACGT\nAC\n\n>b len>500 x\nGG\n")
    assert {(r.contig, r.seq, r.length) for r in readers.read_fasta(spark, str(tmp_path / "s.fa")).collect()} == {("a", "ACGTAC", 6), ("b", "GG", 2)}
    (tmp_path / "c.txt").write_text("a\t1\nb\tFalse\n")
    assert {tuple(r) for r in readers.read_complete(spark, str(tmp_path / "c.txt")).collect()} == {("a", True), ("b", False)}
    (tmp_path / "bad.txt").write_text("a\tyes\n")
    with pytest.raises(Exception, match="not a flag"):
        readers.read_complete(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "p.txt").write_text("# note\nReference_Sequence\tQuery_Sequence\tC\tI_local\tI_global\na\tb\t0.5\t0.9\t0.45\n")
    r = readers.read_pairs(spark, str(tmp_path / "p.txt")).first()
    assert (r.reference, r.query, r.coverage, r.ANI, r.full_ANI) == ("a", "b", 0.5, 90.0, 0.45)
    (tmp_path / "d.delta").write_text("/x>1 /y\nNUCMER\n>a b 100 90\n1 50 2 51 3 3 0\n-4\n0\n60 80 60 80 0 0 0\n0\n>b a 90 100\n5 9 9 5 1 1 0\n0\n")
    got = {(r.ref, r.query, r.query_len, r.query_start, r.query_end, r.mismatches) for r in readers.read_delta(spark, str(tmp_path / "d.delta")).collect()}
    assert got == {("a", "b", 90, 2, 51, 3), ("a", "b", 90, 60, 80, 0), ("b", "a", 100, 9, 5, 1)}


def test_annotations_and_fragments(spark, tmp_path):
    (tmp_path / "f1.txt").write_text("contig\tstart\tstop\tdirection\taccession\tsource\tfunction\na\t1\t9\tf\tX\tS\twhat it does\n")
    (tmp_path / "f2.txt").write_text("contig\tsource\taccession\tstart\tstop\tdirection\nb\tS\tY\t2\t8\tr\n")
    got = {(r.contig, r.accession, r.description) for r in readers.read_annotations(spark, [str(tmp_path / "f1.txt"), str(tmp_path / "f2.txt")]).collect()}
    assert got == {("a", "X", "what it does"), ("b", "Y", None)}
    (tmp_path / "fr.txt").write_text("/q/a.fa\t/r/b.x.fa\t97.5\t8\t10\n")
    r = readers.read_fragments(spark, str(tmp_path / "fr.txt")).first()
    assert (r["query"], r.reference, r.fragments_matched) == ("a", "b.x", 8)


def joined(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def rows(spark, path):
    return spark.read.option("sep", "\t").option("header", True).csv(str(path)).collect()


def test_graphml_in_parts(spark, tmp_path):
    n = spark.createDataFrame([(0, 'a&b"', ["x", "y"])] + [(i, "<>", None) for i in range(1, 50)], "node int, label string, more array<string>").repartition(5)
    e = spark.createDataFrame([(0, i, 3) for i in range(50)], "src int, dst int, weight int").repartition(3)
    sinks.write_graphml(n, e, str(tmp_path / "g.graphml"))
    root = ElementTree.fromstring(joined(tmp_path / "g.graphml").encode())
    space = "{http://graphml.graphdrawing.org/xmlns}"
    nodes = {x.get("id"): [d.text for d in x] for x in root.iter(f"{space}node")}
    assert len(nodes) == 50 and nodes["0"] == ['a&b"', "x|y"] and nodes["7"] == ["<>"]
    assert {(x.get("source"), x.get("target")) for x in root.iter(f"{space}edge")} == {("0", str(i)) for i in range(50)}


def test_systems_command(spark, tmp_path):
    (tmp_path / "s.fa").write_text(">a\nACGTACGT\n>b\nACGTAC\n")
    (tmp_path / "c.txt").write_text("a\t0\nb\t1\n")
    (tmp_path / "p.txt").write_text("reference\tquery\tC\tI_local\tI_global\na\ta\t1\t1\t1\nb\tb\t1\t1\t1\na\tb\t0.95\t0.95\t0.9\n")
    cli.main(["systems", "-s", str(tmp_path / "s.fa"), "-c", str(tmp_path / "c.txt"), "-a", str(tmp_path / "p.txt"), "-o", str(tmp_path / "out")])
    assert [(r.system_name, r.backbone_plasmids, r.compound_plasmids) for r in rows(spark, tmp_path / "out_systems")] == [("PS1", "b", "a")]
    assert '<edge source="0" target="1">' in joined(tmp_path / "out_cluster_graph.graphml") or '<edge source="1" target="0">' in joined(tmp_path / "out_cluster_graph.graphml")
    assert '<edge source="b" target="a">' in joined(tmp_path / "out_contig_graph.graphml")
    (tmp_path / "bad.txt").write_text("reference\tquery\tC\tI_local\tI_global\na\tb\t95\t0.9\t0.9\n")
    with pytest.raises(Exception, match="not within 0..1"):
        readers.read_pairs(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "short.txt").write_text("reference\tC\na\t1\n")
    with pytest.raises(ValueError, match="query"):
        readers.read_pairs(spark, str(tmp_path / "short.txt"))


def test_systems_command_from_blocks(spark, tmp_path):
    (tmp_path / "s.fa").write_text(f">a\n{'ACGT' * 25}\n>b\n{'ACGT' * 20}\n")
    (tmp_path / "d.delta").write_text("/x /y\nNUCMER\n>a a 100 100\n1 100 1 100 0 0 0\n0\n>b b 80 80\n1 80 1 80 0 0 0\n0\n>a b 100 80\n5 79 3 77 2 2 0\n0\n70 84 68 80 0 0 0\n0\n")
    cli.main(["systems", "-s", str(tmp_path / "s.fa"), "--delta", str(tmp_path / "d.delta"), "-o", str(tmp_path / "out")])
    blocks = rows(spark, tmp_path / "out_ani_blocks")
    assert len(blocks) == 4 and readers.read_blocks(spark, str(tmp_path / "out_ani_blocks")).count() == 4
    pair = {(r.reference, r["query"]): float(r.C) for r in rows(spark, tmp_path / "out_ani")}
    assert pair == {("a", "a"): 1.0, ("b", "b"): 1.0, ("a", "b"): 78 / 80}
    assert {(r.contig, r.cluster_type, r.systems) for r in rows(spark, tmp_path / "out_contigs")} == {("a", "compound", "PS1"), ("b", "backbone", "PS1")}


def test_layout_command(spark, tmp_path):
    (tmp_path / "s.fa").write_text(f">a\n{'A' * 900}\n>b\n{'C' * 900}\n")
    calls = [(1, "a", 10, 60), (2, "a", 70, 90), (3, "b", 20, 50), (4, "b", 700, 800)]
    (tmp_path / "g.txt").write_text("gene_callers_id\tcontig\tstart\tstop\tdirection\n" + "".join(f"{g}\t{c}\t{s}\t{e}\tf\n" for g, c, s, e in calls))
    (tmp_path / "f.txt").write_text("gene_callers_id\taccession\tsource\tfunction\n1\tX\tS\td\n2\tY\tS\td\n3\tX\tS\td\n4\tX\tT\td\n")
    (tmp_path / "m.txt").write_text("contig\thabitat\nb\tsoil\n")
    (tmp_path / "d.delta").write_text("/x /y\nNUCMER\n>b a 900 900\n20 50 20 50 3 3 0\n0\n")
    cli.main(["layout", "-s", str(tmp_path / "s.fa"), "-a", str(tmp_path / "f.txt"), "-g", str(tmp_path / "g.txt"), "-o", str(tmp_path / "fig"),
        "--neighborhood", "15", "--metadata", str(tmp_path / "m.txt"), "--align", str(tmp_path / "d.delta")])
    loci = {(r.locus, int(r.start), int(r.stop), r.habitat) for r in rows(spark, tmp_path / "fig_loci")}
    assert loci == {("a", 0, 75, None), ("b_locus_0", 5, 65, "soil"), ("b_locus_1", 685, 815, "soil")}
    assert {(r.locus, r.accession) for r in rows(spark, tmp_path / "fig_genes")} == {("a", "X"), ("b_locus_0", "X"), ("b_locus_1", "X")}
    assert [(r.symbol, r.accession, r.contigs) for r in rows(spark, tmp_path / "fig_legend")] == [("A", "X", "2"), ("0", "Y", "1")]
    assert [(r.query_locus, r.ref_locus) for r in rows(spark, tmp_path / "fig_ribbons")] == [("a", "b_locus_0")]


def test_saved_tables_and_representatives(spark, tmp_path):
    (tmp_path / "k.txt").write_text("/q/a.b.fa\t/r/c.fa\t0.25\t0.001\t10/20\n")
    r = readers.read_sketch_distances(spark, str(tmp_path / "k.txt")).first()
    assert (r.s1, r.s2, r.sim) == ("a_b", "c", 0.75)
    names = spark.createDataFrame([("/q/a.fa", "first")], "file string, name string")
    (tmp_path / "fr.txt").write_text("/q/a.fa\t/r/b.fa\t97.5\t8\t10\n")
    r = readers.read_fragments(spark, str(tmp_path / "fr.txt"), names).first()
    assert (r["query"], r.reference) == ("first", "/r/b.fa")
    seqs = spark.createDataFrame([("a", "ACGT"), ("b", "AC"), ("c", "G")], "contig string, seq string")
    derep = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "c")], "representative string, contig string")
    sinks.write_dereplicated(derep, seqs, str(tmp_path / "d"))
    assert {(r.contig, r.seq) for r in readers.read_fasta(spark, str(tmp_path / "d_representatives")).collect()} == {("a", "ACGT"), ("c", "G")}
    assert len(rows(spark, tmp_path / "d_components")) == 3


def test_streaming_coverage(spark, tmp_path):
    from seqsys.streaming import loads

    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    batches = [[("a", 0, 5), ("a", 3, 9), ("c", 1, 4)], [("a", 8, 12), ("b", 1, 2)], [("a", 20, 22)]]
    for rows_ in batches:
        spark.createDataFrame(rows_, "contig string, start int, stop int").coalesce(1).write.mode("append").parquet(src)
        s = loads.read_arrivals(spark, src, "contig string, start int, stop int")
        loads.maintain_coverage(s, "contig", "start", "stop", state, str(tmp_path / "cp")).awaitTermination()
    got = {r.key: (r.cov, r.cov_uniq, r.n) for r in loads.current_coverage(spark, state, 2).collect()}
    assert got == {"a": (17, 14, 4), "b": (1, 1, 1), "c": (3, 3, 1)}


def test_legend_and_wrap(spark):
    df = spark.createDataFrame([(1, None, ["x", "y"]), (2, "one two three", None)], "n int, t string, a array<string>")
    assert [tuple(r) for r in layout.legend(df, ["n", "t", "a"], "n", 8).collect()] == [("2", "one two\nthree", ""), ("1", "", "x|y")]


def test_scratch_ends(spark, tmp_path):
    where = checkpoint_dir(spark)
    scratch = Scratch(spark, "ends")
    scratch.write(spark.range(3))
    assert os.path.isdir(f"{where}/{scratch.root.rsplit('/', 1)[1]}")
    release(spark)
    assert not os.path.isdir(f"{where}/{scratch.root.rsplit('/', 1)[1]}")


def test_no_private_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Cluster)
