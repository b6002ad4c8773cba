"""References to records that do not exist, were deleted or arrived later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphan_rows(
    children: DataFrame, parents: DataFrame, *, row: str, key: str, at: str, parent_key: str, valid_from: str, valid_to: str, table: str = "child"
) -> DataFrame:
    """Every distinct child row whose key had no standing parent at the row's time.

    A reference is a key above zero; null, zero and negative keys refer to
    nothing. A parent row stands at time t if ``valid_from <= t`` and ``valid_to``
    is null or later than t; a parent row without ``valid_from`` never stands.
    Result: ``child_table, row, key, at, kind`` with kind ``missing`` (no parent row has
    the key), ``late`` (all came after t) or ``withdrawn``. Rows without a
    time, and repeated (row, key, time), are reported once or not at all: a null
    time gives no case. Empty tables and clashing extra columns are fine.

    The distinct keys are anti-joined with the distinct parent keys first, so the
    hottest key crosses the network once per map task; orphans then join back for their
    rows. A child row of a known key is anti-joined on its key with the parent rows,
    reduced to one row per (key, valid_from); both joins have the fat side on the left,
    where adaptive execution splits a skewed partition.
    """
    c = children.select(
        F.col(row).alias("row"), F.col(key).cast("long").alias("key"), F.col(at).cast("timestamp").alias("at")
    ).filter((F.col("key") > 0) & F.col("at").isNotNull())
    far = F.lit("9999-12-31 23:59:59").cast("timestamp")
    p = parents.select(
        F.col(parent_key).cast("long").alias("key"), F.col(valid_from).cast("timestamp").alias("p_from"), F.coalesce(F.col(valid_to).cast("timestamp"), far).alias("p_to")
    ).filter(F.col("key") > 0)

    known = p.groupBy("key").agg(F.min("p_from").alias("first_from"))
    missing = c.select("key").distinct().join(known, "key", "left_anti").withColumn("gone", F.lit(True))
    # the last withdrawal among deliveries at one time is the one that counts
    standing = p.filter(F.col("p_from").isNotNull()).groupBy("key", "p_from").agg(F.max("p_to").alias("p_to"))
    s = standing.select(F.col("key").alias("s_key"), "p_from", "p_to")
    without = c.join(s, (F.col("key") == F.col("s_key")) & (F.col("p_from") <= F.col("at")) & (F.col("p_to") > F.col("at")), "left_anti")
    marked = without.join(missing, "key", "left").join(known, "key", "left")
    kind = F.when(F.col("gone"), "missing").when(F.col("first_from").isNull() | (F.col("first_from") > F.col("at")), "late").otherwise("withdrawn")
    return marked.select(F.lit(table).alias("child_table"), "row", "key", "at", kind.alias("kind")).distinct()


def orphan_report(orphans: DataFrame, children: DataFrame, *, key: str, at: str, table: str = "child", period: str = "yyyy-MM") -> DataFrame:
    """Orphan rows, distinct orphan keys and all references per table, period and kind."""
    total = (
        children.select(F.col(key).cast("long").alias("key"), F.date_format(F.col(at), period).alias("period"))
        .filter((F.col("key") > 0) & F.col("period").isNotNull())
        .groupBy("period")
        .agg(F.count("*").alias("references"))
    )
    per = orphans.groupBy("child_table", F.date_format("at", period).alias("period"), "kind").agg(
        F.count("*").alias("orphan_rows"), F.countDistinct("key").alias("orphan_keys")
    )
    return per.join(total, "period").select("child_table", "period", "kind", "orphan_rows", "orphan_keys", "references")
