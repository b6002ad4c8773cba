"""Continuous stretches and gaps of overlapping intervals, by run bitmaps.

Time or position is discretised into units; unit ``u`` and the border after it
are the bits ``2u`` and ``2u + 1``, so an interval ``[s, e)`` sets the bits
``2s .. 2e - 2``: overlapping intervals share bits, intervals that only touch
leave the border bit between them clear. Bits are cut into shards per entity and
kept compressed as runs. Every map task unions its own intervals per shard before
the shuffle, so what reaches one reducer of a hot entity is a set of bitmaps, each
bounded by the shard width, never the raw intervals; shards of one entity go to
different tasks. Set runs are the covered stretches, clear runs between two set ones
are the gaps. Shards that one interval covers from border to border are not filled but kept
as one run of shards, so that an interval may be of any length. Only runs that reach a shard's border, and one row per shard for
the gaps across borders, are stitched by a window over the entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqsys.session import Scratch

#: Bits per shard (two per unit).
SHARD_BITS = 17


def union_runs(group: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of closed bit runs per group, all groups at once; adjacent bits join.

    ``start`` and ``end`` lie in ``[0, width)``; groups are laid side by side with a
    clear bit between them, so one running maximum serves them all.
    """
    base = group.astype(np.int64) * (width + 1)
    s, e = base + start, base + end
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    first = np.ones(len(s), bool)
    first[1:] = s[1:] > e[:-1] + 1
    at = np.flatnonzero(first)
    stop = np.append(at[1:], len(s)) - 1
    g = s[at] // (width + 1)
    return g, s[at] - g * (width + 1), e[stop] - g * (width + 1)


def _grouped(names: pa.Array, shards: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each row by (name, shard), and the first row of each group."""
    code = names.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    low = shards.min()
    key = code * (shards.max() - low + 1) + (shards - low)
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    return group, first


def _pack(group: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> pa.Array:
    """One run bitmap (start, end as int32, ...) per group; ``group`` ascends and covers 0..n-1."""
    runs = np.stack([start, end], 1).astype("<i4")
    offsets = np.zeros(n + 1, np.int32)
    offsets[1:] = np.cumsum(np.bincount(group, minlength=n)) * 8
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(runs.tobytes())])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, shard, to, a, b) to one run bitmap per name and shard of a batch; runs of whole shards, which have ``to``, go on as they are."""
    for b in batches:
        whole = b.column(2).is_valid()
        full = b.filter(whole)
        if full.num_rows:
            yield pa.RecordBatch.from_arrays([*full.columns[:3], pa.nulls(full.num_rows, pa.binary())], ["name", "shard", "to", "runs"])
            b = b.filter(pc.invert(whole))
        if b.num_rows == 0:
            continue
        shard = b.column(1).to_numpy()
        group, first = _grouped(b.column(0), shard)
        g, s, e = union_runs(group, b.column(3).to_numpy(), b.column(4).to_numpy(), 1 << SHARD_BITS)
        columns = [b.column(0).take(pa.array(first)), pa.array(shard[first]), pa.nulls(len(first), pa.int64()), _pack(g, s, e, len(first))]
        yield pa.RecordBatch.from_arrays(columns, ["name", "shard", "to", "runs"])


def _lists(group: np.ndarray, value: np.ndarray, n: int) -> pa.Array:
    offsets = np.zeros(n + 1, np.int32)
    offsets[1:] = np.cumsum(np.bincount(group, minlength=n))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(value))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps sorted by name and shard to their union, as absolute bit runs; runs of whole shards go on as they are.

    The last group of a batch may go on in the next one: it is carried over as
    one bitmap, so memory holds a batch and a bitmap whatever the group's size.
    """
    carry: pa.RecordBatch | None = None

    def emit(b: pa.RecordBatch, last: bool) -> tuple[pa.RecordBatch | None, pa.RecordBatch | None]:
        shard = b.column(1).to_numpy()
        names = b.column(0)
        same = np.zeros(b.num_rows, bool)
        code = names.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        same[1:] = (code[1:] == code[:-1]) & (shard[1:] == shard[:-1])
        group = np.cumsum(~same) - 1
        first = np.flatnonzero(~same)
        raw = b.column(2)
        data = np.concatenate([np.frombuffer(x, "<i4") for x in raw.to_pylist()]) if b.num_rows else np.zeros(0, "<i4")
        per = np.diff(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]) // 8
        g, s, e = union_runs(np.repeat(group, per), data[0::2].astype(np.int64), data[1::2].astype(np.int64), 1 << SHARD_BITS)
        n = len(first)
        rest = None
        if not last:  # keep the last group back
            keep = g == n - 1
            rest = pa.RecordBatch.from_arrays([names.slice(int(first[-1]), 1), pa.array(shard[first[-1:]]),
                _pack(np.zeros(keep.sum(), np.int64), s[keep], e[keep], 1)], ["name", "shard", "runs"])
            g, s, e, n = g[~keep], s[~keep], e[~keep], n - 1
        if not n:
            return None, rest
        low = shard[first[:n]].astype(np.int64) << SHARD_BITS
        out = pa.RecordBatch.from_arrays(
            [names.take(pa.array(first[:n])), pa.array(shard[first[:n]]), pa.nulls(n, pa.int64()), _lists(g, s + low[g], n), _lists(g, e + low[g], n)],
            ["name", "shard", "to", "starts", "ends"],
        )
        return out, rest

    for b in batches:
        whole = b.column(2).is_valid()
        full = b.filter(whole)
        if full.num_rows:
            none = pa.nulls(full.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*full.columns[:3], none, none], ["name", "shard", "to", "starts", "ends"])
            b = b.filter(pc.invert(whole))
        if b.num_rows == 0:
            continue
        b = pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3)], ["name", "shard", "runs"])
        if carry is not None:
            t = pa.Table.from_batches([carry.cast(b.schema), b]).combine_chunks()
            b = t.to_batches()[0]
        out, carry = emit(b, False)
        if out is not None:
            yield out
    if carry is not None:
        yield emit(carry, True)[0]


def stretches_and_gaps(df: DataFrame, entity: str, start: str, stop: str) -> DataFrame:
    """Rows ``entity, kind, start, stop``: every covered stretch and every gap between two.

    Intervals are half-open ``[start, stop)`` in whole units. Rows with a null
    entity, start or stop, and intervals with ``stop <= start``, are ignored; negative
    positions are allowed. Repeated rows change nothing. Touching stretches
    stay apart and have no gap between them. An empty table gives no row. Other
    columns of ``df``, whatever their names, are not read.
    """
    scratch = Scratch(df.sparkSession, "runs")
    lo, hi = F.col("s") * 2, F.col("e") * 2 - 2
    bits = (
        df.select(F.col(entity).cast("string").alias("name"), F.col(start).cast("long").alias("s"), F.col(stop).cast("long").alias("e"))
        .filter(F.col("name").isNotNull() & (F.col("e") > F.col("s")))
        .select("name", lo.alias("lo"), hi.alias("hi"), F.shiftright(lo, SHARD_BITS).alias("low"), F.shiftright(hi, SHARD_BITS).alias("high"))
    )
    # an interval fills its first and last shard in part, and all between them as a whole
    low, high, none = F.col("low"), F.col("high"), F.lit(None).cast("long")
    part = lambda shard: F.struct(shard.alias("shard"), none.alias("to"))
    pieces = F.array(part(low), F.when(high > low, part(high)), F.when(high - low > 1, F.struct((low + 1).alias("shard"), (high - 1).alias("to"))))
    bits = bits.select("name", "lo", "hi", F.explode(F.array_compact(pieces)).alias("p")).select("name", "lo", "hi", "p.shard", "p.to")
    base = F.shiftleft(F.col("shard"), SHARD_BITS)
    cut = bits.select("name", "shard", "to", (F.greatest("lo", base) - base).alias("a"), (F.least("hi", base + ((1 << SHARD_BITS) - 1)) - base).alias("b"))
    maps = cut.mapInArrow(_build, "name string, shard long, to long, runs binary")
    merged = (
        maps.repartition("name", "shard")
        .sortWithinPartitions("name", "shard")
        .mapInArrow(_merge, "name string, shard long, to long, starts array<long>, ends array<long>")
    )
    rows = scratch.write(merged, "shards")
    # one slim row per shard and per run of whole shards, in the order of the shards: of those within earlier runs nothing is
    # left, of overlapping runs the new part
    earlier = Window.partitionBy("name").orderBy("shard", F.col("to").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    slim = rows.select("name", "shard", "to", F.max("to").over(earlier).alias("reached"))
    within = slim.filter(F.col("to").isNull() & (F.col("reached") >= F.col("shard"))).select("name", "shard")
    new = slim.filter(F.col("to") > F.coalesce("reached", F.col("to") - 1)).select("name", F.greatest("shard", F.col("reached") + 1).alias("shard"), "to")
    first_bit = F.shiftleft(F.col("shard"), SHARD_BITS)
    last_bit = F.shiftleft(F.coalesce("to", "shard") + 1, SHARD_BITS) - 1
    kept = rows.filter(F.col("to").isNull()).join(within, ["name", "shard"], "left_anti").select("name", "shard", "to", "starts", "ends")
    new = new.select("name", "shard", "to", F.array(first_bit).alias("starts"), F.array(last_bit).alias("ends"))
    runs = kept.unionByName(new).select("name", "shard", "starts", "ends", first_bit.alias("first_bit"), last_bit.alias("last_bit"))
    runs = scratch.write(runs, "runs")

    each = runs.select("name", "first_bit", "last_bit", F.explode(F.arrays_zip("starts", "ends")).alias("r")).select(
        "name", F.col("r.starts").alias("a"), F.col("r.ends").alias("b"), ((F.col("r.starts") == F.col("first_bit")) | (F.col("r.ends") == F.col("last_bit"))).alias("open")
    )
    closed = each.filter(~F.col("open")).select("name", "a", "b")
    by_start = Window.partitionBy("name").orderBy("a")
    island = F.sum(F.when(F.lag("b").over(by_start) == F.col("a") - 1, 0).otherwise(1)).over(by_start)
    stitched = each.filter("open").withColumn("island", island).groupBy("name", "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).select("name", "a", "b")
    covered = closed.unionByName(stitched).select(
        "name", F.lit("covered").alias("kind"), F.shiftright("a", 1).alias("start"), (F.shiftright("b", 1) + 1).alias("stop")
    )
    n = F.size("starts")
    inner = runs.filter(n > 1).select("name", F.explode(F.arrays_zip(F.slice("ends", 1, n - 1).alias("p"), F.slice("starts", 2, n - 1).alias("q"))).alias("r"))
    inner = inner.select("name", F.col("r.p").alias("p"), F.col("r.q").alias("q"))
    across = runs.select("name", "shard", F.col("starts")[0].alias("q"), F.element_at("ends", -1).alias("last"))
    across = across.select("name", F.lag("last").over(Window.partitionBy("name").orderBy("shard")).alias("p"), "q")
    gaps = (
        inner.unionByName(across)
        .filter(F.col("q") > F.col("p") + 2)
        .select("name", F.lit("gap").alias("kind"), (F.shiftright("p", 1) + 1).alias("start"), F.shiftright("q", 1).alias("stop"))
    )
    return covered.unionByName(gaps).withColumnRenamed("name", entity)
