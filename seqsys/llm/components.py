"""Connected components of pairwise matches by large-star and small-star rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsys.operators.graph import star_components


def components(pairs: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """Rows ``node, component``: the smallest node name linked to each node, in byte order.

    ``pairs`` is undirected; rows with a null end are ignored, self pairs make no node,
    repeated rows and either direction count once. Every node of a pair of two
    different nodes gives one row. An empty table gives no row. Other columns are not read.

    The edge set is rewritten by large stars and small stars, through joins, until it stays the same:
    every record is then linked to its component's minimum identifier.
    """
    x, y = F.col(a).cast("string"), F.col(b).cast("string")
    linked = pairs.select(x.alias("u"), y.alias("v")).filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    return star_components(linked, max_rounds)
