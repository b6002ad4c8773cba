import random

from pyspark.sql import functions as F

from seqsys.operators import annot, cooc, coverage, intervals


def test_pair_summary_fixture(spark):
    rows = [("R", "Q", 100, 1, 50, 2), ("R", "Q", 100, 40, 60, 1), ("R", "Q", 100, 90, 80, 0)]
    df = spark.createDataFrame(rows, "ref string, query string, query_len int, query_start int, query_end int, mismatches int")
    r = coverage.pair_summary(df).first()
    assert (r.mismatches, r.nblocks) == (3, 3)
    assert [round(x, 6) for x in (r.query_cov, r.query_cov_uniq, r.ANI, r.full_ANI)] == [0.82, 0.71, 0.963415, 0.684024]


def test_coverage_and_depth_against_positions(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), s, s + rng.randrange(1, 30)) for s in (rng.randrange(200) for _ in range(80))]
    df = spark.createDataFrame(rows, "k string, start int, stop int")
    got = {r.k: (r.cov, r.cov_uniq, r.n) for r in coverage.union_coverage(df, "k", "start", "stop").collect()}
    depth = {(k, p): sum(1 for x, s, e in rows if x == k and s <= p < e) for k in "ab" for p in range(240)}
    for k in "ab":
        assert got[k] == (sum(e - s for x, s, e in rows if x == k), sum(1 for p in range(240) if depth[k, p]), sum(1 for r in rows if r[0] == k))
    dense = {(r.k, r.pos): r.depth for r in coverage.dense_depth(coverage.depth_profile(df, ["k"], "start", "stop"), ["k"]).collect()}
    assert dense == {x: v for x, v in depth.items() if v}


def test_merge_slop_rotate_overlap(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 9), ("a", 8, 12)], "contig string, start int, stop int")
    assert sorted((r.start, r.stop) for r in intervals.merge(df, ["contig"]).collect()) == [(0, 5), (5, 12)]
    s = intervals.slop(spark.createDataFrame([(3, 18, 20)], "start int, stop int, size int"), 5, "size").first()
    assert (s.start, s.stop) == (0, 20)
    r = intervals.rotate(spark.createDataFrame([(90, 100)], "start int, stop int"), F.lit(5), F.lit(100)).collect()
    assert sorted((x.start, x.stop, x.part) for x in r) == [(0, 5, 1), (95, 100, 0)]
    assert spark.range(1).select(intervals.overlaps(F.lit(0), F.lit(0), F.lit(0), F.lit(1)).alias("x")).first().x


def test_overlap_join_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "c", s, s + rng.randrange(1, 90)) for i, s in enumerate(rng.randrange(500) for _ in range(120))]
    df = spark.createDataFrame(rows, "id int, contig string, start int, stop int")
    got = [(r.id_l, r.id_r) for r in intervals.overlap_join(df, df, "contig", 40).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a[0], b[0]) for a in rows for b in rows if a[2] < b[3] and b[2] < a[3]}


def test_window_pairs_fixture(spark):
    g = spark.createDataFrame([("c", 0, 10, "f", "A", "1"), ("c", 12, 20, "r", "B", "2"), ("c", 15, 40, "f", "C", "3")],
        "contig string, start int, stop int, direction string, accession string, row string")
    pairs = lambda w: {(r.later, r.earlier, r.orientation) for r in cooc.window_pairs(g, w).collect()}
    assert pairs(5) == {("C", "B", 1)}
    assert pairs(12) == {("C", "B", 1), ("B", "A", 2)}


def test_matching_and_cover(spark):
    s = spark.createDataFrame([("a", "x", 5), ("a", "y", 5), ("b", "x", 4), ("b", "y", 3), ("c", "x", 9)], "a string, b string, v int")
    assert {tuple(r) for r in cooc.greedy_matching(s, "v").collect()} == {("c", "x", 9), ("a", "y", 5)}
    rows = [("1", 0, "X"), ("2", 0, "X"), ("3", 0, "X"), ("3", 20, "Y"), ("4", 10, "Y"), ("4", 5, "Z")]
    g = spark.createDataFrame([(c, p, p + 1, a, "s") for c, p, a in rows], "contig string, start int, stop int, accession string, source string")
    assert [r.accession for r in annot.anchor_cover(g).orderBy("position").collect()] == ["X", "Z"]


def test_one_contig_of_very_many_calls(spark):
    """Rows of a hot contig stand in many tasks, and the results are those of one pass."""
    n = 200_000
    df = spark.range(n).select(F.lit("hot").alias("contig"), (F.col("id") * 7919 % 1_000_003).cast("int").alias("start"),
        F.col("id")).withColumn("stop", F.col("start") + 3 + F.col("id").cast("int") % 5)
    df = df.unionByName(spark.createDataFrame([("hot", 400_000, -1, 500_000), ("cold", 5, -2, 9)], "contig string, start int, id long, stop int"))
    placed = intervals.sharded(df, "start")
    assert placed.groupBy("contig", "_shard").count().agg(F.max("count")).first()[0] < n / 30
    rows = sorted((r.contig, r.start, r.stop, r.id) for r in df.collect())
    islands, runs, opened = {}, {}, []
    for c, s, e, i in rows:
        if c in islands and s < islands[c][-1][1]:
            islands[c][-1][1] = max(e, islands[c][-1][1])
        else:
            islands.setdefault(c, []).append([s, e])
    got = {(r.contig, r.start, r.stop) for r in intervals.merge(df, ["contig"]).collect()}
    assert got == {(c, s, e) for c, v in islands.items() for s, e in v}
    ranks = {r.id: r.k for r in intervals.with_run_index(df, "start", ["contig"], ["start", "id"], "k").select("id", "k").collect()}
    want, last, k = {}, None, 0
    for c, s, i in sorted((c, s, i) for c, s, _, i in rows):
        k = 0 if last is None or last[0] != c else k + (s != last[1])
        want[i], last = k, (c, s)
    assert ranks == want
    events = sorted([(s, 1) for c, s, e, _ in rows if c == "hot"] + [(e, -1) for c, s, e, _ in rows if c == "hot"])
    depth = most = 0
    for _, d in events:
        depth += d
        most = max(most, depth)
    assert {r.contig: r.tiers for r in intervals.tiers(df, "contig").collect()} == {"hot": most, "cold": 1}
    cov = {r.contig: r.cov_uniq for r in coverage.union_coverage(df, "contig", "start", "stop").collect()}
    assert cov == {c: sum(e - s for s, e in v) for c, v in islands.items()}


def test_interval_tiers_against_one_pass(spark):
    rng = random.Random(14)
    rows = {(c, s, s + rng.randrange(1, 4000)) for c in "ab" for s in (rng.randrange(60_000) for _ in range(300))} | {("c", 5, 9), ("c", 9, 12), ("c", 5, 7)}
    want = {}
    for c in "abc":
        opened, most = set(), 0
        for s, e in sorted((s, e) for x, s, e in rows if x == c):
            opened = {x for x in opened if x[1] > s}
            most = max(most, len(opened))
            want[c, s, e] = most
            opened.add((s, e))
    df = spark.createDataFrame([*rows, *list(rows)[:20], ("c", 3, 3)], "contig string, start int, stop int")
    assert {(r.contig, r.start, r.stop): r.tier for r in intervals.interval_tiers(df, "contig").collect()} == want
