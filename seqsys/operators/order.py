"""Row numbers over a whole table without a single task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqsys.session import Scratch


def number_rows(df: DataFrame, order: list[Column | str], out: str = "i") -> DataFrame:
    """Add ``out``, the 0-based place of each row in ``order``, which must be a total order.

    The rows are range-sorted and written with their partition; the offset of a partition is the
    number of rows before it, so every task sees only its own range.
    """
    scratch = Scratch(df.sparkSession, "order")
    placed = scratch.write(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    per = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per partition of the sort
    before = per.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    joined = placed.withColumn("_i", within).join(F.broadcast(before.select("_part", "_base")), "_part")
    return joined.withColumn(out, F.col("_base") + F.col("_i") - 1).drop("_part", "_at", "_base", "_i")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 123, per: str | None = None) -> DataFrame:
    """The same ``n`` rows for one seed, or ``n`` per value of ``per``: those whose keys hash lowest. ``key`` is unique."""
    at = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string")))
    if per is None:
        return df.orderBy(at, key).limit(n)
    w = Window.partitionBy(per).orderBy(at, key)
    return df.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= n).drop("_at")
