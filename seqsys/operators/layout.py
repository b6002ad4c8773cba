"""Tables that a drawing of annotated contigs needs; rendering is left to the reader's tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqsys.operators.intervals import merge, overlaps, slop, with_locus
from seqsys.operators.order import number_rows
from seqsys.operators.scan import SHARD_WIDTH, sharded


def loci(anchor_genes: DataFrame, lengths: DataFrame, neighborhood: int, merge_overlapping: bool = True) -> DataFrame:
    """Windows around anchor genes, clamped to the contig, merged where they overlap, and named."""
    g = anchor_genes.select("contig", "start", "stop").distinct().join(lengths.select("contig", F.col("length").alias("_size")), "contig")
    wide = slop(g, neighborhood, "_size").select("contig", "start", "stop")
    return with_locus(merge(wide, ["contig"]) if merge_overlapping else wide)


def locus_genes(genes: DataFrame, windows: DataFrame, inside: bool = True) -> DataFrame:
    """Genes with the ``locus`` they are inside of, or, without ``inside``, once for every locus of their contig.

    Genes meet windows by contig and stretch of positions, so a contig with very many of both is spread.
    """
    w = windows.select("contig", "locus", F.col("start").alias("_ws"), F.col("stop").alias("_we"))
    if not inside:
        return genes.join(w.drop("_ws", "_we"), "contig")
    w = w.withColumn("_shard", F.explode(F.sequence(F.floor(F.col("_ws") / SHARD_WIDTH), F.floor(F.col("_we") / SHARD_WIDTH))))
    within = (F.col("start") >= F.col("_ws")) & (F.col("stop") <= F.col("_we"))
    return sharded(genes, "start").join(w, ["contig", "_shard"]).filter(within).drop("_ws", "_we", "_shard")


def centre(genes: DataFrame, anchor: str) -> DataFrame:
    """Gaps left and right of the first anchor gene per contig, swapped where it is reversed, and the widest of all."""
    ext = genes.groupBy("contig").agg(F.min("start").alias("xmin"), F.max("stop").alias("xmax"))
    first = genes.filter(F.col("accession") == anchor).groupBy("contig").agg(F.min(F.struct("start", "stop", "direction")).alias("g"))
    x = ext.join(first, "contig").withColumns({"l": F.col("g.start") - F.col("xmin"), "r": F.col("xmax") - F.col("g.stop"), "back": F.col("g.direction") == "r"})
    x = x.select("contig", "xmin", "xmax", F.when(F.col("back"), F.col("r")).otherwise(F.col("l")).alias("left_gap"),
        F.when(F.col("back"), F.col("l")).otherwise(F.col("r")).alias("right_gap"))
    widest = F.broadcast(x.agg(F.max("left_gap").alias("max_left"), F.max("right_gap").alias("max_right")))
    return x.join(widest).select("contig", "left_gap", "right_gap", (F.col("xmin") - (F.col("max_left") - F.col("left_gap"))).alias("view_start"),
        (F.col("xmax") + F.col("max_right") - F.col("right_gap")).alias("view_stop"))


def ribbons(blocks: DataFrame, windows: DataFrame, order: list[str]) -> DataFrame:
    """Alignment blocks between neighbouring loci, clipped to both, with their identity.

    ``blocks``: ``ref, query, ref_start, ref_end, query_start, query_end, errors`` (1-based closed); ``order`` sorts the loci.
    """
    placed = number_rows(windows.select("contig", "locus", "start", "stop"), [*order, "locus"])
    after = placed.select((F.col("i") - 1).alias("i"), F.struct("contig", "locus", "start", "stop").alias("n"))
    nxt = placed.join(after, "i").select(F.col("contig").alias("query"), F.col("locus").alias("query_locus"), F.col("start").alias("qs"),
        F.col("stop").alias("qe"), F.col("n.contig").alias("ref"), F.col("n.locus").alias("ref_locus"), F.col("n.start").alias("rs"), F.col("n.stop").alias("re"))
    b = blocks.join(nxt, ["query", "ref"])
    q1, q2 = F.least("query_start", "query_end") - 1, F.greatest("query_start", "query_end")
    r1, r2 = F.least("ref_start", "ref_end") - 1, F.greatest("ref_start", "ref_end")
    b = b.filter(overlaps(q1, q2, F.col("qs"), F.col("qe")) & overlaps(r1, r2, F.col("rs"), F.col("re")))
    span = F.abs(F.col("query_end") - F.col("query_start")) + 1
    return b.select(
        "query_locus", "ref_locus", F.greatest(q1, F.col("qs")).alias("query_from"), F.least(q2, F.col("qe")).alias("query_to"),
        F.greatest(r1, F.col("rs")).alias("ref_from"), F.least(r2, F.col("re")).alias("ref_to"),
        ((F.col("query_start") > F.col("query_end")) != (F.col("ref_start") > F.col("ref_end"))).alias("reversed"), ((span - F.col("errors")) / span).alias("identity"),
    )


def legend(table: DataFrame, columns: list[str], sort: str, width: int | None = None) -> DataFrame:
    """The annotation table of a figure: blanks for nulls, arrays joined, texts broken at ``width``, largest ``sort`` first."""
    kinds = dict(table.dtypes)

    def show(c: str) -> Column:
        text = F.coalesce(F.array_join(c, "|") if kinds[c].startswith("array") else F.col(c).cast("string"), F.lit(""))
        return (wrap(text, width) if width else text).alias(c)

    return table.orderBy(F.col(sort).desc(), *columns).select(*[show(c) for c in columns])


def wrap(text: Column, width: int) -> Column:
    """Break a text into lines of at most ``width`` characters at blanks; longer words stay whole."""
    return F.regexp_replace(F.regexp_replace(text, rf"(.{{1,{width}}})(?:\s+|$)", "$1\n"), r"\n$", "")
