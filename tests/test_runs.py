import random

from seqsys.operators.runs import SHARD_BITS, stretches_and_gaps


def brute(rows):
    out = set()
    for name in {r[0] for r in rows if r[0] is not None}:
        merged = []
        for s, e in sorted({(s, e) for n, s, e in rows if n == name and s is not None and e is not None and e > s}):
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(name, "covered", s, e) for s, e in merged}
        out |= {(name, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:]) if b[0] > a[1]}
    return out


def run(spark, rows, schema="contig string, start long, stop long"):
    df = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in stretches_and_gaps(df, "contig", "start", "stop").select("contig", "kind", "start", "stop").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_touching_nested_nulls_and_repeats(spark):
    rows = [("a", 0, 5), ("a", 5, 9), ("a", 8, 12), ("a", 8, 12), ("a", 20, 21), ("b", 3, 3), (None, 1, 2), ("a", None, 4), ("a", 4, None), ("c", -5, -1)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == set()


def test_across_shards(spark):
    unit = 1 << (SHARD_BITS - 1)
    rows = [("x", 0, 3 * unit), ("x", 3 * unit, 3 * unit + 5), ("x", 5 * unit - 1, 5 * unit), ("x", 5 * unit, 5 * unit + 1),
        ("x", 9 * unit - 3, 11 * unit + 2), ("y", unit - 1, unit + 1)]
    assert run(spark, rows) == brute(rows)


def test_intervals_of_any_length(spark):
    unit = 1 << (SHARD_BITS - 1)
    rows = [("x", 0, 2 * 10**14), ("x", 10**14, 2 * 10**14 + 7), ("x", 3 * 10**14, 3 * 10**14 + 1), ("x", 5, 9), ("y", -(10**15), 10**15)]
    rows += [("z", 0, 9 * unit), ("z", 4 * unit, 20 * unit + 3), ("z", 2 * unit, 5 * unit), ("z", 20 * unit + 3, 20 * unit + 5),
        ("z", 30 * unit, 33 * unit), ("z", 33 * unit, 37 * unit), ("z", 40 * unit - 1, 44 * unit)]
    assert run(spark, rows) == brute(rows)


def test_long_and_short_at_random(spark):
    rng = random.Random(6)
    unit = 1 << (SHARD_BITS - 1)
    rows = []
    for _ in range(400):
        s = rng.randrange(60 * unit)
        rows.append((rng.choice("ab"), s, s + rng.choice([1, 50, unit, unit // 2, 3 * unit, 7 * unit if rng.random() < 0.1 else 9])))
        rows.append(("c", s // unit * unit, (s // unit + rng.randrange(1, 5)) * unit))
    rows = [r for r in rows if r[0] != "a" or r[1] % 7]
    for name in "abc":
        some = [r for r in rows if r[0] == name][:60]
        assert run(spark, some) == brute(some)


def test_random_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(3000):
        s = rng.randrange(400_000)
        rows.append((rng.choice("aaaaabc"), s, s + rng.choice([0, 1, 2, 30, 200, 90_000 if rng.random() < 0.01 else 5])))
    assert run(spark, rows) == brute(rows)


def test_clashing_extra_columns(spark):
    df = spark.createDataFrame([("a", 0, 5, "x", 1, 2)], "contig string, start long, stop long, name string, shard int, lo int")
    assert [tuple(r) for r in stretches_and_gaps(df, "contig", "start", "stop").collect()] == [("a", "covered", 0, 5)]
