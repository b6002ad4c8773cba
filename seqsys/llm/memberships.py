"""Distinct (record, item) pairs, the common input of set joins and co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def memberships(df: DataFrame, record: Column, item: Column) -> DataFrame:
    """Rows ``record, item``, each pair once; rows with a null in either are left out.

    The pairs are hashed on both columns, so neither a hot record nor a hot item meets
    in one task, and repeats are combined before the shuffle.
    """
    return df.select(record.alias("record"), item.alias("item")).dropna().distinct()
