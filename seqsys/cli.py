"""Command line: ``python -m seqsys.cli systems`` and ``layout``."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from seqsys.operators.annot import anchor_cover, gene_pivot, merge_calls, symbols
from seqsys.operators.coverage import pair_summary
from seqsys.operators.cooc import frequencies
from seqsys.operators.layout import legend, loci, locus_genes, ribbons
from seqsys.operators.systems import Systems, cluster_network, clusters_output, contig_network, contigs_output, graph_output, systems_output
from seqsys.session import local_session, release, ship
from seqsys.sources import readers, sinks


def systems(a: argparse.Namespace) -> None:
    """Pairs (or alignment blocks), sequences and flags to clusters, systems and networks."""
    spark = local_session(str(a.threads))
    ship(spark)
    contigs = readers.read_fasta(spark, a.sequences).select("contig", "length")
    contigs = contigs.join(readers.read_complete(spark, a.complete), "contig", "left") if a.complete else contigs.withColumn("circular", F.lit(True))
    if a.ani:
        pairs = readers.read_pairs(spark, a.ani)
    else:
        sinks.write_blocks(readers.read_delta(spark, a.delta), f"{a.output}_ani_blocks")
        s = pair_summary(readers.read_blocks(spark, f"{a.output}_ani_blocks"))
        pairs = s.select(F.col("ref").alias("reference"), "query", F.col("query_cov_uniq").alias("coverage"), (F.col("ANI") * 100).alias("ANI"), "full_ANI")
        sinks.write_pairs(pairs, f"{a.output}_ani")
    out = Systems(pairs, contigs, 100 * a.min_similarity, a.min_coverage)
    for name, df in (("contigs", contigs_output(out)), ("clusters", clusters_output(out)), ("systems", systems_output(out)), ("cluster_graph", graph_output(out))):
        sinks.write_tsv(df, f"{a.output}_{name}")
    sinks.write_graphml(*cluster_network(out), f"{a.output}_cluster_graph.graphml")
    sinks.write_graphml(*contig_network(out), f"{a.output}_contig_graph.graphml")
    release(spark)


def layout(a: argparse.Namespace) -> None:
    """Annotations (and alignment blocks) to the tables of a comparison figure."""
    spark = local_session(str(a.threads))
    ship(spark)
    lengths = readers.read_fasta(spark, a.sequences).select("contig", "length")
    if a.gene_calls:
        genes = merge_calls(readers.read_annotations(spark, a.annotations, by_call=True), readers.read_calls(spark, a.gene_calls))
    else:
        genes = readers.read_annotations(spark, a.annotations)
    if a.contigs:
        genes = genes.filter(F.col("contig").isin([c.strip() for c in a.contigs.split(",")]))
    split = lambda x: [y.strip() for y in x.split(",")] if x else None
    anchors = anchor_cover(genes, sources=split(a.sources), start_genes=split(a.anchors))
    windows = loci(genes.join(anchors.select("accession"), "accession"), lengths, a.neighborhood)
    freq = frequencies(genes)
    placed = locus_genes(genes, windows)
    described = windows
    if a.metadata:
        described = windows.join(readers.read_metadata(spark, a.metadata), "contig", "left")
    names = symbols(freq, anchors, [F.col("contigs").desc(), F.col("instances").desc()])
    table = legend(names.join(freq, "accession"), ["symbol", "accession", "instances", "contigs"], "contigs")
    for name, df in (("loci", described), ("genes", placed), ("legend", table), ("pivot", gene_pivot(placed, freq))):
        sinks.write_tsv(df, f"{a.output}_{name}")
    if a.align:
        sinks.write_tsv(ribbons(readers.read_delta(spark, a.align), windows, ["contig", "start"]), f"{a.output}_ribbons")
    release(spark)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="seqsys")
    sub = p.add_subparsers(required=True)
    s = sub.add_parser("systems")
    s.add_argument("-s", "--sequences", required=True)
    s.add_argument("-c", "--complete")
    s.add_argument("-o", "--output", required=True)
    s.add_argument("-a", "--ani")
    s.add_argument("--delta", help="alignment blocks, if there is no pair table")
    s.add_argument("-T", "--threads", type=int, default=1)
    s.add_argument("--min-similarity", type=float, default=0.9)
    s.add_argument("--min-coverage", type=float, default=0.9)
    s.set_defaults(run=systems)
    v = sub.add_parser("layout")
    v.add_argument("-s", "--sequences", required=True)
    v.add_argument("-a", "--annotations", nargs="+", required=True)
    v.add_argument("-g", "--gene-calls")
    v.add_argument("-o", "--output", required=True)
    v.add_argument("--contigs")
    v.add_argument("--anchors", help="accessions taken as anchors first")
    v.add_argument("--sources", help="annotation sources of anchors, the best first")
    v.add_argument("--metadata", help="a table by contig, joined to the loci")
    v.add_argument("--align", help="alignment blocks of the contigs")
    v.add_argument("-T", "--threads", type=int, default=1)
    v.add_argument("--neighborhood", type=int, default=20000)
    v.set_defaults(run=layout)
    a = p.parse_args(argv)
    if a.run is systems and not (a.ani or a.delta):
        p.error("one of --ani and --delta is needed")
    a.run(a)


if __name__ == "__main__":
    main()
