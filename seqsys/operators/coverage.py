"""Coverage of a query by alignment blocks or intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqsys.operators.intervals import running_depth
from seqsys.operators.runs import stretches_and_gaps
from seqsys.operators.scan import value_after
from seqsys.session import Scratch


def _new_part(keys: list[str], start: str, stop: str) -> Column:
    """The part of [start, stop) that no earlier interval of the group covers."""
    w = Window.partitionBy(*keys).orderBy(start, stop).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(stop).over(w), F.col(start))
    return F.greatest(F.lit(0), F.col(stop) - F.greatest(F.col(start), reached))


def union_coverage(df: DataFrame, key: str, start: str, stop: str) -> DataFrame:
    """Per key: ``cov`` (sum of lengths), ``cov_uniq`` (length of the union), ``n``. Intervals are half-open whole numbers.

    The union comes from run bitmaps, the rest is combined before the shuffle, so a key with very many intervals is spread.
    """
    rows = df.select(F.col(key).cast("string").alias(key), start, stop)
    per = rows.groupBy(key).agg(F.sum(F.col(stop) - F.col(start)).alias("cov"), F.count("*").alias("n"))
    union = stretches_and_gaps(rows, key, start, stop).filter("kind = 'covered'").groupBy(key).agg(F.sum(F.col("stop") - F.col("start")).alias("cov_uniq"))
    return per.join(union, key, "left").select(key, "cov", F.coalesce("cov_uniq", F.lit(0)).alias("cov_uniq"), "n")


def pair_summary(blocks: DataFrame) -> DataFrame:
    """Alignment blocks (1-based closed, either orientation) to one row per (ref, query), whose blocks are one window.

    Columns: ``query_cov, query_cov_uniq, mismatches, nblocks, ANI, full_ANI`` as fractions. Overlapping
    blocks count repeatedly in ``query_cov`` and ANI, once in ``query_cov_uniq``.
    """
    b = blocks.withColumn("_s", F.least("query_start", "query_end") - 1).withColumn("_e", F.greatest("query_start", "query_end"))
    b = b.withColumn("_new", _new_part(["ref", "query"], "_s", "_e"))
    g = b.groupBy("ref", "query").agg(
        F.sum(F.col("_e") - F.col("_s")).alias("_cov"), F.sum("_new").alias("_uniq"), F.sum("mismatches").alias("mismatches"), F.count("*").alias("nblocks"), F.first("query_len").alias("_len")
    )
    ani = (F.col("_cov") - F.col("mismatches")) / F.col("_cov")
    uniq = F.col("_uniq") / F.col("_len")
    return g.select("ref", "query", (F.col("_cov") / F.col("_len")).alias("query_cov"), uniq.alias("query_cov_uniq"), "mismatches", "nblocks",
        ani.alias("ANI"), (ani * uniq).alias("full_ANI"))


def position_deltas(df: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """Net number of intervals that open at each position where it changes: ``keys, pos, delta``."""
    ends = df.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("d")),
        F.struct(F.col(stop).alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    return ends.groupBy(*keys, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("delta")).filter(F.col("delta") != 0)


def depth_profile(df: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """Run-length depth: ``keys, start, stop, depth`` for every stretch of constant depth above 0."""
    scratch = Scratch(df.sparkSession, "depth")
    depth = scratch.write(running_depth(df, keys, start, stop, scratch), "depth")
    d = value_after(depth, keys, ["pos"], "pos", "stop")
    return d.filter(F.col("depth") > 0).select(*keys, F.col("pos").alias("start"), "stop", "depth")


def dense_depth(profile: DataFrame, keys: list[str]) -> DataFrame:
    """One row per covered position; asked for explicitly only."""
    return profile.select(*keys, F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos"), "depth")
