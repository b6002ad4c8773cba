"""Best representative of each duplicate group, record- and fieldwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def survivors(df: DataFrame, group: Column, row: Column, rules: dict[str, tuple[Column, list[Column]]], min_rows: int = 2) -> DataFrame:
    """Rows ``group, group_row, field_name, row``: the row that supplies each field of each group.

    ``rules`` maps a field name to (present, ranks): only rows where ``present`` is true
    may supply it, and the one with the largest ``ranks`` wins, compared in order, a
    null last, then the largest ``row``. ``group_row`` is the smallest row of the
    group. Ranks are numbers; rules must have equally many (pad with literals).
    Groups with fewer than ``min_rows`` rows, null groups, and fields present nowhere give no
    row. Repeated rows with one ``row`` value count as rows but win once.

    One window over (group, field) keeps the first row; Spark takes the top row of each
    group per map task before the shuffle, so a hot group moves one row per task.
    """
    width = max(len(r) for _, r in rules.values())
    fields = [
        F.struct(F.lit(name).alias("field_name"), present.alias("present"), *[r.cast("long").alias(f"rank{i}") for i, r in enumerate(ranks)])
        for name, (present, ranks) in rules.items()
    ]
    base = df.select(group.alias("group"), row.alias("row"), F.array(*fields).alias("f")).filter(F.col("group").isNotNull())
    each = base.select("group", "row", F.explode("f").alias("f")).select("group", "row", "f.*").filter("present")
    order = [F.col(f"rank{i}").desc_nulls_last() for i in range(width)] + [F.col("row").desc()]
    w = Window.partitionBy("group", "field_name").orderBy(*order)
    best = each.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") == 1).select("group", "field_name", "row")
    sizes = base.groupBy("group").agg(F.count("*").alias("_n"), F.min("row").alias("group_row")).filter(F.col("_n") >= min_rows)
    return best.join(sizes, "group").select("group", "group_row", "field_name", "row")
