"""Running values along positions, without a task that holds a whole key.

A key's positions are cut into shards of fixed width, and every shard is a window of its own. What a shard needs to know of
the ones before it is one row per shard, carried over by a window of shards. So a key with very
many rows is spread over its shards; rows of one shard stand in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions per shard.
SHARD_WIDTH = 1 << 14


def sharded(df: DataFrame, pos: str, width: int = SHARD_WIDTH) -> DataFrame:
    """Add ``_shard``, the shard of a position; negative positions are fine."""
    return df.withColumn("_shard", F.floor(F.col(pos) / width))


def _carried(df: DataFrame, keys: list[str], total: Column, carry) -> DataFrame:
    """Rows ``keys, _shard, _carry``: ``carry`` of the column ``_total`` over the key's earlier shards."""
    earlier = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    return df.groupBy(*keys, "_shard").agg(total.alias("_total")).select(*keys, "_shard", carry("_total").over(earlier).alias("_carry"))


def _local(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, "_shard").orderBy(*order)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, peers: bool = False) -> DataFrame:
    """Add the sum of ``value`` over the key's rows up to this one in ``order``. ``df`` comes from `sharded` by the first of ``order``.

    With ``peers`` rows that are equal in ``order`` count together, so that it need not be a total order.
    """
    w = _local(keys, order)
    here = F.sum(value).over(w.rangeBetween(Window.unboundedPreceding, 0) if peers else w.rowsBetween(Window.unboundedPreceding, 0))
    joined = df.join(_carried(df, keys, F.sum(value), F.sum), [*keys, "_shard"])
    return joined.withColumn(out, here + F.coalesce("_carry", F.lit(0))).drop("_carry")


def max_before(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add the largest ``value`` of the key's rows before this one in ``order``; null for the first."""
    here = F.max(value).over(_local(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    joined = df.join(_carried(df, keys, F.max(value), F.max), [*keys, "_shard"])
    # greatest skips nulls
    return joined.withColumn(out, F.greatest(here, "_carry")).drop("_carry")


def value_before(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, is_first: str) -> DataFrame:
    """Add ``value`` of the key's row before this one in ``order``, and whether there is none."""
    w = _local(keys, order)
    last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order))
    joined = df.join(_carried(df, keys, last, lambda c: F.last(c)), [*keys, "_shard"])
    before = F.coalesce(F.lag(F.struct(F.col(value).alias("v"))).over(w), F.col("_carry"))
    return joined.withColumn("_row", before).withColumns({out: F.col("_row.v"), is_first: F.col("_row").isNull()}).drop("_carry", "_row")


def value_after(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add ``value`` of the key's next row in ``order``; null for the last."""
    later = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(1, 1)
    first = df.groupBy(*keys, "_shard").agg(F.min_by(value, F.struct(*order)).alias("_total"))
    joined = df.join(first.select(*keys, "_shard", F.first("_total").over(later).alias("_carry")), [*keys, "_shard"])
    return joined.withColumn(out, F.coalesce(F.lead(value).over(_local(keys, order)), "_carry")).drop("_carry")
