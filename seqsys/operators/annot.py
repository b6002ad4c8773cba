"""Annotations of genes: merging, cover, symbols, cargo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqsys.operators.order import number_rows
from seqsys.session import Scratch


def merge_calls(functions: DataFrame, calls: DataFrame, dummies: bool = False, key: str = "gene_callers_id") -> DataFrame:
    """Annotations with the coordinates of their gene calls.

    With ``dummies`` calls without annotation stay, with source ``dummy_annotation`` and an accession made of the call.
    """
    calls = calls.select(key, "contig", "start", "stop", "direction")
    if not dummies:
        return functions.join(calls, key)
    out = functions.join(calls, key, "full_outer").filter(F.col("contig").isNotNull())
    made = F.concat_ws("_", "contig", "start", "stop", "direction")
    return out.withColumns({"accession": F.coalesce("accession", made), "source": F.coalesce("source", F.lit("dummy_annotation"))})


def anchor_cover(genes: DataFrame, target: str = "contig", sources: list[str] | None = None, start_genes: list[str] | None = None,
    max_rounds: int | None = None) -> DataFrame:
    """Greedy cover of the contigs (or genes) by accessions: ``position, accession``, in the order chosen.

    While some accession is on several contigs, the one on most contigs is taken, then
    by instances, rank of its source (earlier sources first), leftmost start, name; after that the
    one with the first contig, then start, then name. ``start_genes`` are taken first. Covered contigs,
    or with ``target = 'gene'`` covered genes, leave, until none is left; ``max_rounds`` cuts the list off where it is given.

    An accession's place in this order can only fall as others are taken, and only by those it shares a
    contig (gene) with. So each round takes all accessions that come first on every contig they are
    on; sorted by what they had when taken, they are the list that taking one at a time gives.
    """
    spark = genes.sparkSession
    scratch = Scratch(spark, "cover")
    rank = F.lit(0)
    for k, s in enumerate(sources or []):
        rank = F.when(F.col("source") == s, len(sources) - k).otherwise(rank)
    rest = genes.withColumn("_rank", rank).filter(F.col("contig").isNotNull() & F.col("accession").isNotNull())
    if sources:
        rest = rest.filter(F.col("source").isin(sources))
    keys = ["contig"] if target == "contig" else ["contig", "start", "stop"]
    rest = rest.select("contig", "start", "stop", "accession", "_rank")
    first = list(start_genes or [])
    if first:
        rest = _uncovered(rest, rest.filter(F.col("accession").isin(first)), keys)
    rest = scratch.write(rest, "rest")
    taken: list[str] = []
    while not rest.isEmpty():
        here = scratch.last
        per = rest.groupBy("accession").agg(F.count_distinct("contig").alias("nc"), F.count("*").alias("ni"), F.max("_rank").alias("r"),
            F.min("contig").alias("c"), F.min("start").alias("s"))
        several = F.col("nc") > 1
        order = [F.when(several, -F.col(x)).otherwise(1).alias(x) for x in ("nc", "ni", "r")] + [F.when(several,
            F.lit("")).otherwise(F.col("c").cast("string")).alias("c"), "s", "accession"]
        each = rest.select("accession", *keys).distinct().join(per.select("accession", F.struct(*order).alias("place")), "accession")
        each = each.withColumn("_first", F.min("place").over(Window.partitionBy(*keys)))
        now = scratch.write(each.groupBy("accession", "place").agg(F.every(F.col("place").eqNullSafe(F.col("_first"))).alias("ok")).filter("ok").select("accession", "place"), "taken")
        taken.append(scratch.last)
        rest = scratch.write(_uncovered(rest, rest.join(now.select("accession"), "accession", "left_semi"), keys), "rest")
        scratch.drop(here)
    given = spark.createDataFrame(list(enumerate(first)), "position int, accession string")
    out = given
    if taken:
        out = given.unionByName(number_rows(spark.read.parquet(*taken), ["place"]).select((F.col("i") + len(first)).cast("int").alias("position"), "accession"))
    return out if max_rounds is None else out.filter(F.col("position") < max_rounds)


def _uncovered(rest: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``rest`` that are on no contig (or gene) of the ``chosen`` rows."""
    return rest.join(chosen.select(*keys).distinct(), keys, "left_anti")


def letters(i: Column) -> Column:
    """A, B, .. Z, AA, AB, .. for 0, 1, ..; up to four letters."""
    out, first = F.lit(""), 0
    for n in range(1, 5):
        x = i - first
        digits = [F.char(F.lit(65) + (F.floor(x / 26**k) % 26)) for k in reversed(range(n))]
        out = F.when((i >= first) & (i < first + 26**n), F.concat(*digits)).otherwise(out)
        first += 26**n
    return out


def symbols(accessions: DataFrame, anchors: DataFrame, order: list[Column]) -> DataFrame:
    """Symbols for ranked accessions: anchors A, B, .. Z, AA, .., others 0, 1, ..; ``order`` ranks the others."""
    named = anchors.select("accession", letters(F.col("position")).alias("symbol"), F.col("position").alias("order"))
    others = accessions.join(anchors.select("accession"), "accession", "left_anti")
    ranked = number_rows(others, [*order, "accession"])
    return named.unionByName(ranked.select("accession", F.col("i").cast("string").alias("symbol"), F.col("i").cast("int").alias("order")))


def anchor_directions(genes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Rows ``contig, accession, position, direction``: the first anchor that each contig carries, and the direction of its leftmost gene."""
    place = F.struct("position", "start", "stop", "direction")
    first = genes.join(anchors.select("accession", "position"), "accession").groupBy("contig").agg(F.min_by(F.struct("accession", "position",
        "direction"), place).alias("g"))
    return first.select("contig", "g.accession", "g.position", "g.direction")


def gene_pivot(genes: DataFrame, frequency: DataFrame) -> DataFrame:
    """One row per gene: its most frequent accession, all accessions, and the sources that annotate it."""
    g = genes.select("contig", "start", "stop", "accession", "source").distinct().join(frequency.select("accession", "contigs"), "accession")
    best = F.min_by("accession", F.struct(-F.col("contigs"), F.col("accession")))
    return g.groupBy("contig", "start", "stop").agg(
        best.alias("accession_representative"), F.array_join(F.array_sort(F.collect_set("accession")),
            "|").alias("accessions"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources")
    )


def symbol_members(genes: DataFrame, pivot: DataFrame) -> DataFrame:
    """Rows ``accession_representative, source, accession``: every annotation met on the genes that a representative accession stands for."""
    of = pivot.select("contig", "start", "stop", "accession_representative")
    return genes.select("contig", "start", "stop", "source", "accession").join(of, ["contig", "start", "stop"]).select("accession_representative",
        "source", "accession").distinct()


def symbol_merge(pivot: DataFrame, members: DataFrame) -> DataFrame:
    """Per representative accession: instances, contigs, and every accession met with it in one string."""
    met = members.groupBy("accession_representative").agg(F.array_join(F.array_sort(F.collect_set("accession")), "|").alias("accessions"))
    counts = pivot.groupBy("accession_representative").agg(F.count("*").alias("instances"), F.count_distinct("contig").alias("ncontigs"))
    return counts.join(met, "accession_representative")


def accession_contigs(genes: DataFrame) -> DataFrame:
    """Rows ``accession, contig, instances``: where every accession is, a row per contig."""
    return genes.groupBy("accession", "contig").agg(F.count("*").alias("instances"))


def descriptions(functions: DataFrame) -> DataFrame:
    """Rows ``accession, description``: what most rows say of each accession, the smaller text of equally frequent ones."""
    counted = functions.filter(F.col("accession").isNotNull() & F.col("description").isNotNull()).groupBy("accession", "description").agg(F.count("*").alias("n"))
    return counted.groupBy("accession").agg(F.min_by("description", F.struct(-F.col("n"), F.col("description"))).alias("description"))


def describe(df: DataFrame, described: DataFrame) -> DataFrame:
    """``df`` with the description of its ``accession``; one that has none under its full name is looked up without its release number."""
    bare = F.regexp_replace("accession", r"\.[^.]*$", "")
    d = described.select(F.col("accession").alias("_name"), F.col("description").alias("_text"))
    out = df.join(d.toDF("accession", "_full"), "accession", "left").withColumn("_name", bare).join(d, "_name", "left")
    return out.withColumn("description", F.coalesce("_full", "_text")).drop("_name", "_full", "_text")


def cargo(genes: DataFrame, membership: DataFrame, reached: DataFrame, strict: bool = True, strict_sources: list[str] | None = None,
    detected: DataFrame | None = None) -> DataFrame:
    """Annotations that a system's backbone lacks: ``backbone, contig, start, stop, accession, source, is_strict``.

    ``membership``: ``contig, cluster``; ``reached``: ``backbone, cluster``, the clusters of each system. An accession is a
    backbone accession if any contig of the backbone cluster carries it. A gene is strict cargo if none of its annotations
    (from ``strict_sources``, if given) is one. With ``strict`` only those are returned. ``detected`` (``contig, sample``)
    adds the samples each contig was detected in, one row each; contigs detected in none are left out.
    """
    m = membership.select("contig", "cluster").join(reached.select("backbone", "cluster"), "cluster").select("contig", "backbone")
    on_backbone = genes.join(membership.select("contig", "cluster"), "contig").select(F.col("cluster").alias("backbone"), "accession").distinct()
    rows = genes.select("contig", "start", "stop", "accession", "source").distinct().join(m, "contig")
    rows = rows.join(on_backbone.withColumn("_hit", F.lit(True)), ["backbone", "accession"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    counted = F.col("_hit") & (F.col("source").isin(strict_sources) if strict_sources else F.lit(True))
    spoiled = rows.filter(counted).select("backbone", "contig", "start", "stop").distinct().withColumn("_spoiled", F.lit(True))
    out = rows.filter(~F.col("_hit")).join(spoiled, ["backbone", "contig", "start", "stop"], "left").withColumn("is_strict", F.col("_spoiled").isNull())
    out = out.select("backbone", "contig", "start", "stop", "accession", "source", "is_strict")
    if detected is not None:
        out = out.join(detected.select("contig", "sample").distinct(), "contig")
    return out.filter("is_strict") if strict else out
