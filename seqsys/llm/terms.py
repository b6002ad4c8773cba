"""Frequencies of all terms and n-grams by sorted, truncated suffixes.

Every position of a record gives its suffix, truncated to ``sigma`` terms. Suffixes
are routed by their first term, so all n-grams starting with it meet in one place, and
sorted in reverse lexicographic order, longer before shorter. One pass with a stack of
as many levels as the current suffix has terms then yields every n-gram: leaving a
prefix pops its level, whose count and record set are final, into the level
below. A first term that holds more than its share of the rows is salted by record:
its parts hold different records, so counts and record counts of the parts add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqsys.operators.scan import sharded, value_after
from seqsys.session import Scratch, parallelism


def term_suffixes(df: DataFrame, record: Column, term: Column) -> DataFrame:
    """Rows that hold one term each, as suffixes of length 1: ``suffix, record``. Null terms are left out."""
    return df.select(F.array(term).alias("suffix"), F.xxhash64(record).alias("record"), record.isNotNull().alias("has_record")).filter(F.col("suffix")[0].isNotNull())


def array_suffixes(df: DataFrame, record: Column, terms: Column, sigma: int) -> DataFrame:
    """All suffixes of each record's array of terms, truncated to ``sigma`` terms. Null terms are left out first."""
    kept = df.select(record.alias("r"), F.filter(terms, lambda x: x.isNotNull()).alias("t")).filter(F.size("t") > 0)
    at = kept.select("r", "t", F.explode(F.sequence(F.lit(1), F.size("t"))).alias("i"))
    return at.select(F.slice("t", F.col("i"), F.lit(sigma)).alias("suffix"), F.xxhash64("r").alias("record"), F.col("r").isNotNull().alias("has_record"))


def sequence_suffixes(df: DataFrame, record: str, order: list[str], term: str, sigma: int) -> DataFrame:
    """All suffixes, truncated to ``sigma`` terms, of sequences given as rows: the terms of a record along ``order``, a total order whose first column is a number.

    A row finds the terms after it shard by shard, so that a record of very many rows is spread. Rows with a null record, term or first order are left out.
    """
    scratch = Scratch(df.sparkSession, "sequences")
    rows = df.select(record, *order, F.col(term).alias("_t1")).dropna(subset=[record, order[0], "_t1"])
    rows = scratch.write(sharded(rows, order[0]), "rows")
    for k in range(1, sigma):
        rows = scratch.write(value_after(rows, [record], order, f"_t{k}", f"_t{k + 1}"), "rows")
    # a missing term ends the suffix, and no later one is there
    suffix = F.array_compact(F.array(*[F.col(f"_t{k}") for k in range(1, sigma + 1)]))
    return rows.select(suffix.alias("suffix"), F.xxhash64(record).alias("record"), F.lit(True).alias("has_record"))


class _Level:
    """A stack level: occurrences of a prefix and the records it was seen in."""

    __slots__ = ("count", "records")

    def __init__(self) -> None:
        self.count, self.records = 0, []


def _stack_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reverse-sorted rows (joined suffix, record, has_record, n) to rows (gram, count, records).

    Equal suffixes are reduced batch-wise with numpy; the stack sees one entry per
    distinct suffix. Record sets are kept as sorted arrays and united when popped.
    """
    names: list[str] = []
    levels: list[_Level] = []
    out: list[tuple[str, int, int]] = []

    def pop() -> None:
        top = levels.pop()
        seen = np.unique(np.concatenate(top.records)) if top.records else np.zeros(0, np.int64)
        out.append(("\u0001".join(names), top.count, len(seen)))
        names.pop()
        if levels:
            levels[-1].count += top.count
            levels[-1].records.append(seen)

    def flush() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))],
            ["gram", "occurrences", "records"])
        out.clear()
        return b

    for b in batches:
        if not b.num_rows:
            continue
        code = b.column(0).dictionary_encode()
        idx = code.indices.to_numpy(zero_copy_only=False)
        record, has, n = b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy()
        at = np.flatnonzero(np.append(True, idx[1:] != idx[:-1]))
        words = code.dictionary.to_pylist()
        sums = np.add.reduceat(n, at)
        for k, (lo, total) in enumerate(zip(at.tolist(), sums.tolist())):
            hi = at[k + 1] if k + 1 < len(at) else len(idx)
            suffix = words[idx[lo]].split("\u0001")
            same = 0
            while same < len(suffix) and same < len(names) and suffix[same] == names[same]:
                same += 1
            while len(names) > same:
                pop()
            for w in suffix[same:]:
                names.append(w)
                levels.append(_Level())
            levels[-1].count += total
            mine = record[lo:hi][has[lo:hi]]
            if len(mine):
                levels[-1].records.append(np.unique(mine))
        # a prefix that goes on over many batches keeps one united set
        for level in levels:
            if len(level.records) > 64:
                level.records = [np.unique(np.concatenate(level.records))]
        if len(out) > 20_000:
            yield flush()
    while names:
        pop()
    yield flush()


def gram_statistics(suffixes: DataFrame, hot_share: float = 0.25) -> DataFrame:
    """Rows ``gram, occurrences, records``: every n-gram with its count and its distinct records.

    ``suffixes`` comes from `term_suffixes` or `array_suffixes`. Terms of a gram are joined
    by U+0001, which a term must not contain. Rows whose record is null
    count as occurrences but for no record. Repeated rows count as occurrences
    again and once per record. An empty table gives no row.

    First terms with more than ``hot_share`` of a shuffle partition's fair number of rows
    are salted by record (rows without record by row); there can be no more than
    ``partitions / hot_share`` of them, so their broadcast is bounded whatever the data.
    """
    spark = suffixes.sparkSession
    parts = parallelism(spark)
    scratch = Scratch(spark, "terms")
    rows = suffixes.select(
        F.element_at("suffix", 1).alias("first"), F.array_join("suffix", "\u0001").alias("joined"), F.when(F.col("has_record"),
            F.col("record")).otherwise(0).alias("record"), "has_record"
    )
    firsts = scratch.write(rows.groupBy("first").agg(F.count("*").alias("n")), "firsts")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    limit = max(1, int(total * hot_share / parts))
    hot = firsts.filter(F.col("n") > limit).select(F.col("first").alias("hot"), F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("salts"))
    salted = rows.join(F.broadcast(hot), F.col("first") == F.col("hot"), "left").withColumn(
        "salt", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64(F.when(F.col("has_record"),
            F.col("record")).otherwise(F.monotonically_increasing_id())), F.col("salts"))).otherwise(0)
    )
    routed = salted.withColumn("n", F.lit(1).cast("long")).repartition("first", "salt").sortWithinPartitions("salt", F.col("joined").desc(), "record")
    stacked = routed.select("joined", "record", "has_record", "n").mapInArrow(_stack_pass, "gram string, occurrences long, records long")
    return stacked.groupBy("gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
