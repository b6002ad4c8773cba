"""Interval algebra on half-open [start, stop) rows per contig."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqsys.operators.scan import max_before, running_sum, sharded, value_before
from seqsys.session import Scratch


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Half-open overlap that also holds for an empty interval at the start of another."""
    return ((s1 >= s2) & (s1 < e2)) | ((s2 >= s1) & (s2 < e1))


def slop(df: DataFrame, k: int, size: str | None = None, start: str = "start", stop: str = "stop") -> DataFrame:
    """Extend both sides by ``k``, clamped to [0, size]."""
    far = F.col(stop) + k
    return df.withColumns({start: F.greatest(F.lit(0), F.col(start) - k), stop: F.least(far, F.col(size)) if size else far})


def with_island(df: DataFrame, keys: list[str], start: str = "start", stop: str = "stop", out: str = "island") -> DataFrame:
    """Number the connected groups of overlapping intervals per key; touching stays apart. Rows with a null key are left out."""
    scratch = Scratch(df.sparkSession, "islands")
    rows = scratch.write(sharded(df, start), "rows")
    # peers of one (start, stop) belong to one island
    reached = scratch.write(max_before(rows, keys, [start, stop], stop, "_reached"), "reached")
    opens = F.when(F.col(start) < F.col("_reached"), 0).otherwise(1)
    return running_sum(reached, keys, [start, stop], opens, out, peers=True).drop("_reached", "_shard")


def merge(df: DataFrame, keys: list[str], start: str = "start", stop: str = "stop", aggs: dict[str, Column] | None = None) -> DataFrame:
    """Merge overlapping intervals per key; ``aggs`` adds aggregates over the members."""
    g = with_island(df, keys, start, stop).groupBy(*keys, "island")
    return g.agg(F.min(start).alias(start), F.max(stop).alias(stop), *[c.alias(n) for n, c in (aggs or {}).items()]).drop("island")


def overlap_join(left: DataFrame, right: DataFrame, key: str, bin_width: int, start: str = "start", stop: str = "stop") -> DataFrame:
    """All overlapping pairs per key; columns of both sides get the suffixes _l and _r.

    Intervals are exploded to the bins they touch and joined on (key, bin), so a contig
    with very many rows is spread over its bins; a pair is kept in the first bin
    both share, which needs no distinct.
    """
    def binned(df: DataFrame, suffix: str) -> DataFrame:
        last = F.greatest(F.col(start), F.col(stop) - 1)
        b = df.select(*[F.col(c).alias(c + suffix) for c in df.columns],
            F.explode(F.sequence(F.floor(F.col(start) / bin_width), F.floor(last / bin_width))).alias("_bin"))
        return b.withColumn("_key", F.col(key + suffix))

    l, r = binned(left, "_l"), binned(right, "_r")
    s1, e1, s2, e2 = (F.col(c) for c in (start + "_l", stop + "_l", start + "_r", stop + "_r"))
    first = F.floor(F.greatest(s1, s2) / bin_width) == F.col("_bin")
    return l.join(r, ["_key", "_bin"]).filter(overlaps(s1, e1, s2, e2) & first).drop("_key", "_bin")


def rotate(df: DataFrame, delta: Column, length: Column, start: str = "start", stop: str = "stop") -> DataFrame:
    """Rotate coordinates on circles; an interval across the origin is split, its second half gets ``part`` = 1.

    Reversed intervals (start > stop) keep their orientation.
    """
    lo, hi = F.least(start, stop) + delta, F.greatest(start, stop) + delta
    a, b = F.pmod(lo, length), F.pmod(hi - 1, length) + 1
    crosses = F.floor(lo / length) != F.floor((hi - 1) / length)
    piece = lambda s, e, p: F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"), F.lit(p).alias("part"))
    pieces = F.when(crosses, F.array(piece(a, length, 0), piece(F.lit(0), b, 1))).otherwise(F.array(piece(a, b, 0)))
    back = F.col(start) > F.col(stop)
    out = df.withColumn("_back", back).withColumn("_p", F.explode(pieces))
    s, e = F.col("_p.s"), F.col("_p.e")
    return out.withColumns({start: F.when(F.col("_back"), e).otherwise(s), stop: F.when(F.col("_back"), s).otherwise(e), "part": F.col("_p.part")}).drop("_p", "_back")


def with_run_index(df: DataFrame, value: str, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Add the 0-based number of the run of equal values a row is in, along ``order``, whose first column is a position. Rows with a null key are left out."""
    scratch = Scratch(df.sparkSession, "run-index")
    rows = scratch.write(sharded(df, order[0]), "rows")
    x = scratch.write(value_before(rows, keys, order, value, "_before", "_is_first"), "before")
    change = F.when(F.col("_is_first") | F.col("_before").eqNullSafe(F.col(value)), 0).otherwise(1)
    return running_sum(x, keys, order, change, out, peers=True).drop("_before", "_is_first", "_shard")


def running_depth(df: DataFrame, keys: list[str], start: str, stop: str, scratch: Scratch) -> DataFrame:
    """Rows ``keys, pos, depth, _shard``: the number of intervals open from each position where it changes."""
    ends = F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("d")), F.struct(F.col(stop).alias("pos"), F.lit(-1).alias("d")))
    each = df.filter(F.col(stop) > F.col(start)).select(*keys, F.explode(ends).alias("e"))
    per = each.groupBy(*keys, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("delta")).filter(F.col("delta") != 0)
    rows = scratch.write(sharded(per, "pos"), "deltas")
    return running_sum(rows, keys, ["pos"], F.col("delta"), "depth")


def tiers(df: DataFrame, key: str, start: str = "start", stop: str = "stop") -> DataFrame:
    """Rows a drawing needs per key: the largest number of intervals open at any start."""
    depth = running_depth(df, [key], start, stop, Scratch(df.sparkSession, "tiers"))
    return depth.groupBy(key).agg(F.max("depth").alias("tiers"))


def interval_tiers(df: DataFrame, key: str, start: str = "start", stop: str = "stop") -> DataFrame:
    """Rows ``key, start, stop, tier`` of the distinct intervals: the row a drawing puts them on, from 0.

    That is the largest number of earlier intervals, in order of start and stop, that any interval up to this one found open at its start.
    """
    scratch = Scratch(df.sparkSession, "interval-tiers")
    each = df.filter(F.col(stop) > F.col(start)).select(key, F.col(start).alias("start"), F.col(stop).alias("stop")).distinct()
    # at one position ends come before starts
    ends = F.array(F.struct(F.col("stop").alias("pos"), F.lit(0).alias("opens")), F.struct(F.col("start").alias("pos"), F.lit(1).alias("opens")))
    events = each.select(key, "start", "stop", F.explode(ends).alias("e")).select(key, "start", "stop", "e.pos", "e.opens")
    events = scratch.write(sharded(events, "pos"), "events")
    count = F.when(F.col("opens") == 1, 1).otherwise(-1)
    opened = running_sum(events, [key], ["pos", "opens", "stop", "start"], count, "_open").filter("opens = 1")
    opened = scratch.write(opened.withColumn("_open", F.col("_open") - 1), "open")
    tiered = max_before(opened, [key], ["start", "stop"], "_open", "_before")
    return tiered.select(key, F.col("start").alias(start), F.col("stop").alias(stop), F.greatest("_before", "_open").cast("int").alias("tier"))


def with_locus(df: DataFrame, key: str = "contig", start: str = "start") -> DataFrame:
    """Name the loci of contigs that have two or more: ``locus`` = contig or contig_locus_i (from 0)."""
    scratch = Scratch(df.sparkSession, "loci")
    rows = scratch.write(sharded(df, start), "rows")
    several = rows.groupBy(key).agg(F.count("*").alias("_n"))
    numbered = running_sum(rows, [key], [start, *[c for c in df.columns if c not in (key, start)]], F.lit(1), "_i").join(several, key)
    name = F.when(F.col("_n") > 1, F.concat_ws("_locus_", F.col(key), (F.col("_i") - 1).cast("string"))).otherwise(F.col(key))
    return numbered.withColumn("locus", name).drop("_i", "_n", "_shard")
