"""Items that appear together in records, counted by item blocks.

A basket's distinct items are coded by rank from rare to frequent. Instead of one row
per pair, a basket is sent once to each block of items it touches; the pairs of the
block's items with the more frequent ones are emitted there and combined at once
by a hash aggregate in the same stage, as all counts of a pair live in its block. A
basket of any size is spread over all blocks, and what is shuffled is several times smaller
than the pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsys.session import Scratch, parallelism

#: Item tables of up to this many rows are broadcast, larger ones joined by shuffle.
MAX_BROADCAST_ITEMS = 200_000


def together(members: DataFrame, min_count: int = 2, min_lift: float = 0.0, blocks_per_partition: int = 2, max_broadcast: int = MAX_BROADCAST_ITEMS) -> DataFrame:
    """Rows ``item_a, item_b, n_ab, n_a, n_b, n, pmi, lift`` with item_a < item_b in byte order.

    ``members`` are distinct, non-null (record, item) pairs as from `memberships`. A pair is
    reported if at least ``min_count`` records hold both and ``n_ab * n >= min_lift
    * n_a * n_b``; n counts all records. pmi is ln(lift). Two exact prunings come
    first: an item on fewer than ``min_count`` records is in no pair, and as n_ab is at most
    n_b, neither is an item with ``min_lift * n_a > n``. Empty input gives no row.
    """
    scratch = Scratch(members.sparkSession, "together")
    pairs = scratch.write(members, "members")
    n = pairs.select("record").distinct().count()
    counts = pairs.groupBy("item").agg(F.count("*").alias("n_item"))
    counts = counts.filter((F.col("n_item") >= min_count) & (F.col("n_item") * F.lit(float(min_lift)) <= n))
    # ids ascend with the sort, so a larger code is a more frequent item
    items = scratch.write(counts.orderBy("n_item", "item").withColumn("code", F.monotonically_increasing_id()), "items")
    small = items.count() <= max_broadcast
    hint = F.broadcast if small else (lambda x: x)

    baskets = pairs.join(hint(items.select("item", "code")), "item").groupBy("record").agg(F.array_sort(F.collect_list("code")).alias("codes"))
    baskets = baskets.filter(F.size("codes") > 1).select("codes")
    n_blocks = parallelism(members.sparkSession) * blocks_per_partition
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n_blocks)).cast("int")
    # the last item is the rarer one of no pair; a block needs the basket from its first own item on
    blocked = baskets.select("codes", F.transform("codes", block).alias("of"))
    sent = blocked.select("codes", "of", F.explode(F.array_distinct(F.slice("of", 1, F.size("of") - 1))).alias("block"))
    sent = sent.select("block", F.slice("codes", F.array_position("of", F.col("block")).cast("int"), F.size("codes")).alias("codes"))
    # one partition per block
    routed = sent.repartitionById(n_blocks, F.col("block"))
    firsts = routed.select("block", "codes", F.posexplode("codes").alias("i", "a")).filter(block(F.col("a")) == F.col("block"))
    emitted = firsts.select("block", "a", F.explode(F.slice("codes", F.col("i") + 2, F.size("codes"))).alias("b"))
    n_ab = emitted.groupBy("block", "a", "b").agg(F.count("*").alias("n_ab")).filter(F.col("n_ab") >= min_count)

    left = items.select(F.col("code").alias("a"), F.col("item").alias("x"), F.col("n_item").alias("nx"))
    right = items.select(F.col("code").alias("b"), F.col("item").alias("y"), F.col("n_item").alias("ny"))
    found = n_ab.join(hint(left), "a").join(hint(right), "b").withColumn("n", F.lit(n))
    wanted = F.col("n_ab").cast("decimal(38,0)") * F.col("n") >= F.lit(min_lift).cast("decimal(18,6)") * F.col("nx") * F.col("ny")
    lift = F.col("n_ab") * F.col("n") / (F.col("nx").cast("double") * F.col("ny"))
    first = F.col("x") < F.col("y")
    return found.filter(wanted).select(
        F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"), "n_ab",
        F.when(first, F.col("nx")).otherwise(F.col("ny")).alias("n_a"), F.when(first, F.col("ny")).otherwise(F.col("nx")).alias("n_b"),
        "n", F.log(lift).alias("pmi"), lift.alias("lift"),
    )
