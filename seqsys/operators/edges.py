"""Pair tables to edge lists: thresholds, reciprocity, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqsys.session import Scratch


def with_coverage(df: DataFrame, matched: str = "fragments_matched", total: str = "total_query_fragments", force: bool = False) -> DataFrame:
    """Add ``coverage = matched / total`` where it is absent or ``force`` is set."""
    return df if "coverage" in df.columns and not force else df.withColumn("coverage", F.col(matched) / F.col(total))


def with_full_ani(df: DataFrame, matched: str = "fragments_matched", total: str = "total_query_fragments") -> DataFrame:
    """Add ``full_ANI``, the identity over the whole query."""
    return df.withColumn("full_ANI", F.col("ANI") * F.col(matched) / F.col(total))


def min_ani_cov(df: DataFrame) -> DataFrame:
    """Add ``min_ani_cov``, the smaller of identity (0..1) and coverage."""
    return df.withColumn("min_ani_cov", F.least(F.col("ANI") / 100, F.col("coverage")))


def threshold_edges(pairs: DataFrame, min_coverage: float, min_ani: float, reciprocal: bool = False) -> DataFrame:
    """Rows with ``coverage >= min_coverage`` and ``ANI >= min_ani`` (percent), both inclusive.

    An edge query -> reference says that the query is contained in the reference. With
    ``reciprocal`` only edges whose opposite also passed are kept.
    """
    kept = pairs.filter((F.col("coverage") >= min_coverage) & (F.col("ANI") >= min_ani))
    if not reciprocal:
        return kept
    back = kept.select(F.col("reference").alias("query"), F.col("query").alias("reference")).distinct()
    return kept.join(back, ["query", "reference"], "left_semi")


def drop_self(edges: DataFrame, src: str = "query", dst: str = "reference") -> DataFrame:
    return edges.filter(F.col(src) != F.col(dst))


def nodes_of(edges: DataFrame, src: str = "query", dst: str = "reference") -> DataFrame:
    """The vertex universe: every name on either side, as ``node``."""
    return edges.select(F.col(src).alias("node")).unionByName(edges.select(F.col(dst).alias("node"))).distinct()


def similar_records(members: DataFrame, method: str, threshold: float, min_items: int = 1) -> DataFrame:
    """Rows ``a, b, shared, n_a, n_b``: records of ``min_items`` or more items whose overlap score is at least ``threshold``.

    ``members`` are distinct, non-null (record, item) pairs. For ``jaccard`` and ``minsize`` each pair is one row with
    a < b, for ``rowsize``, the share of a's items that b holds, each direction. An empty table gives no row.

    A pair that reaches the threshold shares at least k of the smaller (or contained) record's n items, so one of its n - k + 1
    rarest: only those are joined, with the other record's rarest (jaccard) or all items. A
    frequent item is joined for the few records only that have no rarer ones, not for all that hold it. Item sets decide.
    """
    scratch = Scratch(members.sparkSession, "similar")
    m = scratch.write(members.select("record", "item"), "members")
    often = m.groupBy("item").agg(F.count("*").alias("f"))
    ranked = m.join(often, "item").groupBy("record").agg(F.array_sort(F.collect_list(F.struct("f", F.xxhash64("item").alias("h"), "item"))).alias("items"))
    sets = scratch.write(ranked.select("record", F.col("items.item").alias("items"), F.size("items").alias("n")).filter(F.col("n") >= max(1, min_items)), "sets")
    least = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(float(threshold)) - 1e-9)).cast("int")
    rarest = F.slice("items", F.lit(1), F.greatest(F.lit(1), F.col("n") - least + 1))
    left = sets.select(F.col("record").alias("a"), F.col("n").alias("n_a"), F.explode(rarest).alias("item"))
    right = sets.select(F.col("record").alias("b"), F.col("n").alias("n_b"), F.explode(rarest if method == "jaccard" else F.col("items")).alias("item"))
    met = left.join(right, "item").filter(F.col("a") != F.col("b"))
    if method == "jaccard":
        met = met.filter((F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(float(threshold)) - 1e-9))
    elif method == "minsize":
        met = met.filter((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))))
    items = sets.select("record", "items")
    pairs = met.select("a", "b", "n_a", "n_b").distinct().join(items.toDF("a", "x"), "a").join(items.toDF("b", "y"), "b")
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("x", "y"))).drop("x", "y")
    kept = pairs.filter(overlap_score(method, F.col("shared"), F.col("n_a"), F.col("n_b")) >= F.lit(float(threshold)) - 1e-12)
    if method == "minsize":
        first = F.col("a") < F.col("b")
        turn = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
        return kept.select(turn("a", "b").alias("a"), turn("b", "a").alias("b"), "shared", turn("n_a", "n_b").alias("n_a"), turn("n_b", "n_a").alias("n_b"))
    return kept.select("a", "b", "shared", "n_a", "n_b")


def overlap_score(method: str, shared: Column, a: Column, b: Column) -> Column:
    """Set overlap: ``jaccard``, ``minsize`` or ``rowsize``."""
    if method == "jaccard":
        return shared / (a + b - shared)
    if method == "minsize":
        return shared / F.least(a, b)
    if method == "rowsize":
        return shared / a
    raise ValueError(f"unknown method {method!r}")
