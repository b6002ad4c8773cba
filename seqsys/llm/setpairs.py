"""All pairs of records whose sets of values are similar, by multi-index binary sketches.

Each set gets ``segments * bits`` one-bit minhashes, packed into one code. Two sets of
Jaccard similarity J agree in a bit with probability (1 + J) / 2, independently,
so the Hamming distance of their codes is binomial and a radius holds the
distance of all but ``miss`` of the pairs at the threshold. Codes are cut into segments
of ``bits`` bits: by the pigeonhole principle a pair within ``segments - 1``
differing bits shares a whole segment for certain, and the number of segments is set so that
a pair at the threshold shares one but for a probability of ``miss``. Segments are
joined by equality, the Hamming radius discards chance meetings on the codes, and
the original sets decide. ``bits`` follows the number of sets, so that the chance
meetings of a segment stay in proportion to it. Sets that are equal are
one class from the start: their sketches are made and joined once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsys.session import Scratch


def sketch_shape(n_sets: int, threshold: float, miss: float) -> tuple[int, int, int]:
    """Bits per segment, segments and Hamming radius for ``n_sets`` sets."""
    bits = min(30, max(12, math.ceil(math.log2(max(n_sets, 2)))))
    agree = (1 + threshold) / 2
    segments = math.ceil(math.log(miss) / math.log(1 - agree**bits))
    n, p = bits * segments, 1 - agree
    # smallest radius whose binomial tail is below `miss`
    term, tail, radius = (1 - p) ** n, 1.0, -1
    log_term = n * math.log(1 - p)
    while tail > miss and radius < n:
        radius += 1
        term = math.exp(log_term)
        tail -= term
        log_term += math.log((n - radius) / (radius + 1)) + math.log(p / (1 - p)) if radius < n else 0
    return bits, segments, radius


def _sketches(bits: int, segments: int):
    k = bits * segments
    rng = np.random.default_rng(20240607)
    mul = rng.integers(1, 2**63, k, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 2**63, k, dtype=np.uint64)
    mix = np.uint64(0x9E3779B97F4A7C15)
    weights = (np.uint64(1) << np.arange(bits, dtype=np.uint64)).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (class, set of 64-bit values) to (class, segment values, code packed in 64-bit words)."""
        for b in batches:
            sets = b.column(1)
            values = sets.flatten().to_numpy().astype(np.int64).view(np.uint64)
            lens = np.diff(sets.offsets.to_numpy())
            keys, words = [], []
            step, lo = max(1, 4_000_000 // k), 0
            starts = np.append(0, np.cumsum(lens))
            while lo < len(lens):  # as many whole sets as make a few million hashes, at least one
                hi = lo + 1
                while hi < len(lens) and starts[hi + 1] - starts[lo] <= step:
                    hi += 1
                low = np.full((hi - lo, k), np.iinfo(np.uint64).max, np.uint64)
                for at in range(starts[lo], starts[hi], step) if hi == lo + 1 else (starts[lo],):
                    v = values[at : min(at + step, starts[hi]) if hi == lo + 1 else starts[hi]]
                    h = v[:, None] * mul + add
                    h ^= h >> np.uint64(29)
                    if hi == lo + 1:
                        low[0] = np.minimum(low[0], h.min(0))
                    else:
                        low = np.minimum.reduceat(h, starts[lo:hi] - starts[lo], axis=0)
                low *= mix
                bit = (low >> np.uint64(61)) & np.uint64(1)
                keys.append((bit.reshape(hi - lo, segments, bits) * weights).sum(2))
                packed = np.packbits(bit.astype(np.uint8), axis=1)
                pad = -packed.shape[1] % 8
                words.append(np.pad(packed, ((0, 0), (0, pad))).view("<i8"))
                lo = hi
            keys, words = np.concatenate(keys).astype(np.int64), np.concatenate(words)

            def column(m: np.ndarray) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(m).ravel()))

            yield pa.RecordBatch.from_arrays([b.column(0), column(keys), column(words)], ["id", "keys", "code"])

    return run


def set_classes(members: DataFrame, min_size: int) -> DataFrame:
    """Rows ``record, id, items`` of the records with at least ``min_size`` items; ``id`` is shared by equal sets.

    ``members`` are distinct (record, item) pairs. Items are kept as 64-bit hashes in
    ascending order; a record's set is one row, as set similarity needs it whole.
    """
    sets = members.groupBy("record").agg(F.array_sort(F.collect_list(F.xxhash64("item"))).alias("items"))
    return sets.filter(F.size("items") >= min_size).select("record", F.xxhash64("items").alias("id"), "items")


def similar_classes(members: DataFrame, threshold: float = 0.8, min_size: int = 1, miss: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Classes of records with equal item sets, and the links between similar ones: ``record, id, n`` and ``x, y, shared, total`` with x < y.

    ``members`` are distinct, non-null (record, item) pairs as from `memberships`; records with
    fewer than ``min_size`` items take no part. A link joins two classes whose sets have Jaccard similarity ``>= threshold``;
    the records of one class, of ``n`` items each, are similar among themselves. ``miss`` bounds the probability of losing
    a pair that lies at the threshold; pairs above it are lost less often, equal sets never.
    Empty input gives no row. There is no cap on partners: a segment value shared by
    very many classes is split by adaptive execution, and repeated sets are one class, however many records have them.
    """
    scratch = Scratch(members.sparkSession, "setpairs")
    sets = scratch.write(set_classes(members, min_size), "sets")
    classes = scratch.write(sets.groupBy("id").agg(F.min_by("items", "record").alias("items")), "classes")
    n = classes.count()
    bits, segments, radius = sketch_shape(n, threshold, miss)
    sketches = scratch.write(classes.select("id", "items").mapInArrow(_sketches(bits, segments), "id long, keys array<long>, code array<long>"), "sketches")

    sizes = classes.select("id", F.size("items").alias("n"))
    keyed = sketches.join(sizes, "id").select("id", F.col("n").cast("int").alias("n"), F.posexplode("keys").alias("s", "key"))
    keyed = keyed.select((F.col("s") * (1 << bits) + F.col("key")).alias("key"), "id", "n")
    left, right = keyed.toDF("key", "x", "nx"), keyed.toDF("key", "y", "ny")
    met = left.join(right, "key").filter(
        (F.col("x") < F.col("y")) & (F.least("nx", "ny") >= F.ceil(F.greatest("nx", "ny") * F.lit(threshold) - 1e-9))
    )
    candidates = met.select("x", "y").distinct()
    near = (
        candidates.join(sketches.select(F.col("id").alias("x"), F.col("code").alias("cx")), "x")
        .join(sketches.select(F.col("id").alias("y"), F.col("code").alias("cy")), "y")
        .filter(F.aggregate(F.zip_with("cx", "cy", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, d: acc + d) <= radius)
        .select("x", "y")
    )
    items = classes.select("id", "items")
    checked = near.join(items.toDF("x", "ix"), "x").join(items.toDF("y", "iy"), "y").withColumn("shared", F.size(F.array_intersect("ix", "iy")))
    checked = checked.withColumn("total", F.size("ix") + F.size("iy") - F.col("shared")).filter(F.col("shared") >= F.col("total") * F.lit(threshold) - 1e-9)
    links = scratch.write(checked.select("x", "y", "shared", "total"), "links")

    return sets.select("record", "id", F.size("items").alias("n")), links


def similar_pairs(members: DataFrame, threshold: float = 0.8, min_size: int = 1, miss: float = 1e-3) -> DataFrame:
    """Rows ``a, b, shared, total`` with a < b: `similar_classes` written out as pairs of records."""
    records, links = similar_classes(members, threshold, min_size, miss)
    of = records.select("record", "id")
    across = links.join(of.toDF("p", "x"), "x").join(of.toDF("q", "y"), "y").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "shared", "total")
    several = records.groupBy("id").agg(F.count("*").alias("copies")).filter(F.col("copies") > 1).select("id")
    copies = records.join(several, "id").select("id", F.col("record").alias("a"), F.col("n").alias("shared"))
    within = copies.join(of.toDF("b", "id"), "id").filter(F.col("a") < F.col("b")).select("a", "b", "shared", F.col("shared").alias("total"))
    return across.unionByName(within)
