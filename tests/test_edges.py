import random

import pytest
from pyspark.sql import functions as F

from seqsys.functions.values import fraction
from seqsys.operators import edges


def score(method, x, y):
    both = len(x & y)
    return both / {"jaccard": len(x | y), "minsize": min(len(x), len(y)), "rowsize": len(x)}[method]


@pytest.mark.parametrize("method,threshold", [("jaccard", 0.5), ("minsize", 0.6), ("rowsize", 0.8), ("jaccard", 1.0), ("rowsize", 0.01)])
def test_similar_records_against_brute_force(spark, method, threshold):
    rng = random.Random(8)
    sets = {f"r{i:02}": {f"i{min(int(rng.expovariate(0.12)), 25)}" for _ in range(rng.randrange(1, 12))} | ({"hot"} if i % 3 else set()) for i in range(90)}
    sets |= {"x1": {"hot"}, "x2": {"hot"}, "e1": {"hot", "i0"}, "e2": {"hot", "i0"}}
    df = spark.createDataFrame([(r, x) for r, s in sets.items() for x in s], "record string, item string")
    for least in (1, 3):
        got = [(r.a, r.b) for r in edges.similar_records(df, method, threshold, least).collect()]
        want = {(a, b) for a in sets for b in sets if a != b and (method == "rowsize" or a < b) and min(len(sets[a]),
            len(sets[b])) >= least and score(method, sets[a], sets[b]) >= threshold}
        assert len(got) == len(set(got)) and set(got) == want
    r = edges.similar_records(df, method, threshold).first()
    assert (r.n_a, r.n_b, r.shared) == (len(sets[r.a]), len(sets[r.b]), len(sets[r.a] & sets[r.b]))
    assert edges.similar_records(df.limit(0), method, threshold).count() == 0


def test_hot_item_is_joined_for_few_records(spark):
    """An item of every record is no meeting point of records that have rarer ones."""
    rows = [(f"r{i}", x) for i in range(2000) for x in ("hot", f"a{i // 2}", f"b{i // 2}", f"c{i}")]
    got = edges.similar_records(spark.createDataFrame(rows, "record string, item string"), "jaccard", 0.6)
    assert got.count() == 1000


def test_weights_of_fragment_tables(spark):
    df = spark.createDataFrame([("a", "b", 90.0, 8, 10)], "query string, reference string, ANI double, fragments_matched int, total_query_fragments int")
    r = edges.min_ani_cov(edges.with_full_ani(edges.with_coverage(df))).first()
    assert (r.coverage, r.full_ANI, r.min_ani_cov) == (0.8, 72.0, 0.8)
    given = df.withColumn("coverage", F.lit(0.5))
    assert edges.with_coverage(given).first().coverage == 0.5 and edges.with_coverage(given, force=True).first().coverage == 0.8


def test_fractions(spark):
    rows = [(0.5, 0.9), (50.0, 90.0), (0.9, 95.0), (float("nan"), 1.0), (None, 2.0), (1.0, 1.0)]
    df = spark.createDataFrame(rows, "c double, l double").select(fraction("c", "l").alias("c"))
    assert [r.c and round(r.c, 9) for r in df.collect()] == [0.5, 0.5, 0.009, None, None, 1.0]
