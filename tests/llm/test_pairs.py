import math
import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from seqsys.llm.components import components
from seqsys.llm.memberships import memberships
from seqsys.llm.queries import ani_matches
from seqsys.llm.setpairs import similar_classes, similar_pairs, sketch_shape
from seqsys.llm.survivors import survivors
from seqsys.llm.terms import array_suffixes, gram_statistics, sequence_suffixes, term_suffixes
from seqsys.llm.together import together


def roots(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in parent}


def test_components_against_union_find(spark):
    rng = random.Random(1)
    name = lambda i: f"n{i:04d}"
    pairs = [(name(i), name(i + 1)) for i in range(100, 160)]  # a chain
    pairs += [(name(0), name(i)) for i in range(200, 400)]  # a star
    pairs += [(name(rng.randrange(500, 900)), name(rng.randrange(500, 900))) for _ in range(250)]
    pairs += [("x", "x"), (None, "y"), ("z", None), (name(101), name(100)), (name(100), name(101))]
    df = spark.createDataFrame([(*p, 1) for p in pairs], "a string, b string, node int")
    got = [tuple(r) for r in components(df, "a", "b").collect()]
    assert set(got) == roots(pairs) and len(got) == len(set(got))
    assert components(df.limit(0), "a", "b").count() == 0


def test_ani_matches(spark):
    rows = [("A_1", "B_1", 0.9, 0.95, 0.85), ("A_1", "C_1", 90.0, 95.0, 85.0), ("A_1", "D_1", 0.95, 0.95, 90.0), ("A_1", "E_1", 0.95, 95.0, 90.0),
        ("A_1", "F_1", 0.89, 0.9, 0.9), ("A_1", "a_1", 1.0, 1.0, 1.0), ("NA", "B_1", 1.0, 1.0, 1.0), ("A_1", "G_1", None, 1.0, 1.0), ("A_1", "H_1",
            float("nan"), 1.0, 1.0), ("A_1", "I_1", 0.95, None, 0.9), ("A_1", "J_1", 1.0, 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "reference string, query string, c double, i_local double, i_global double")
    assert {r.b for r in ani_matches(df).collect()} == {"B_1", "C_1", "D_1", "I_1"}


def test_grams_against_brute_force(spark):
    rng = random.Random(2)
    records = [(f"r{i}" if i % 7 else None, [rng.choice(["a", "b", "a0", "ab", "", None]) for _ in range(rng.randrange(0,
        12))]) for i in range(60)] + [("r1", ["a", "b"]), ("e", []), ("n", None)]
    want_n, want_r = Counter(), {}
    for r, terms in records:
        t = [x for x in terms or [] if x is not None]
        for i in range(len(t)):
            for k in range(1, 4):
                if i + k <= len(t):
                    g = tuple(t[i : i + k])
                    want_n[g] += 1
                    want_r.setdefault(g, set()).update({r} - {None})
    df = spark.createDataFrame(records, "record string, terms array<string>")
    got = gram_statistics(array_suffixes(df, F.col("record"), F.col("terms"), 3)).collect()
    assert {tuple(r.gram.split("\x01")): (r.occurrences, r.records) for r in got} == {g: (n, len(want_r[g])) for g, n in want_n.items()}


def test_suffixes_of_sequences_in_rows(spark):
    rng = random.Random(12)
    rows = [("hot" if i % 3 else f"r{i % 40}", rng.randrange(200_000), i, rng.choice("abcd")) for i in range(3000)] + [(None, 1, -1, "a"), ("r1", 5, -2, None)]
    df = spark.createDataFrame(rows, "record string, at long, id long, term string")
    got = {r.gram: (r.occurrences, r.records) for r in gram_statistics(sequence_suffixes(df, "record", ["at", "id"], "term", 3)).collect()}
    n, where, of = Counter(), {}, {}
    for r, at, i, t in sorted(x for x in rows if x[0] and x[3]):
        of.setdefault(r, []).append(t)
    for r, t in of.items():
        for k in (1, 2, 3):
            for i in range(len(t) - k + 1):
                g = "\x01".join(t[i : i + k])
                n[g] += 1
                where.setdefault(g, set()).add(r)
    assert got == {g: (c, len(where[g])) for g, c in n.items()}


def test_terms_with_a_hot_term(spark):
    rows = [("hot", f"c{i % 300}") for i in range(3000)] + [("hot", None)] * 50 + [(f"t{i}", f"c{i}") for i in range(200)] + [(None, "c1")] + [("t1", "c9")]
    df = spark.createDataFrame(rows, "term string, contig string")
    got = {r.gram: (r.occurrences, r.records) for r in gram_statistics(term_suffixes(df, F.col("contig"), F.col("term"))).collect()}
    assert got["hot"] == (3050, 300) and got["t1"] == (2, 2) and len(got) == 201
    assert gram_statistics(term_suffixes(df.limit(0), F.col("contig"), F.col("term"))).count() == 0


def sets_at_random():
    rng = random.Random(3)
    sets = {}
    for i in range(400):
        base = [f"i{rng.randrange(4000)}" for _ in range(rng.randrange(3, 30))]
        sets[f"s{i}"] = set(base)
        if i % 3 == 0:
            other = set(base)
            for _ in range(rng.randrange(0, 3)):
                other.add(f"j{rng.randrange(9999)}")
            sets[f"s{i}x"] = other
            sets[f"s{i}y"] = set(base)
    sets["giant"] = {f"i{k}" for k in range(20_000)}
    sets["giant2"] = {f"i{k}" for k in range(1000, 20_000)}
    return sets


def test_similar_pairs_against_brute_force(spark):
    sets = sets_at_random()
    rows = [(r, x) for r, s in sets.items() for x in s] * 2 + [(None, "i1"), ("s1", None)]
    df = spark.createDataFrame(rows, "record string, item string")
    got = {(r.a, r.b): (r.shared, r.total) for r in similar_pairs(memberships(df, F.col("record"), F.col("item")), 0.8, 5).collect()}
    want = {}
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) >= 5 and len(x & y) >= 0.8 * len(x | y):
            want[a, b] = (len(x & y), len(x | y))
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.98 * len(want) and ("giant", "giant2") in got
    assert similar_pairs(memberships(df.limit(0), F.col("record"), F.col("item")), 0.8, 5).count() == 0


def test_classes_of_equal_sets(spark):
    """A hot class of copies is one class of many records and makes no pairs of its own."""
    rows = [(f"hot{i}", f"x{k}") for i in range(300) for k in range(10)] + [("near", f"x{k}") for k in range(9)] + [("far", f"y{k}") for k in range(9)]
    df = spark.createDataFrame(rows, "record string, item string")
    records, links = similar_classes(memberships(df, F.col("record"), F.col("item")), 0.8, 5)
    assert records.filter("record like 'hot%'").select("id", "n").distinct().count() == 1 and records.count() == 302
    (r,) = links.collect()
    assert (r.shared, r.total) == (9, 10)


def test_sketch_shape():
    bits, segments, radius = sketch_shape(100_000, 0.8, 1e-3)
    assert bits == 17 and (1 - 0.9**bits) ** segments <= 1e-3 and 0.1 < radius / (bits * segments) < 0.2


def test_together_against_brute_force(spark):
    rng = random.Random(4)
    baskets = {f"b{i}": {f"x{min(int(rng.expovariate(0.15)), 60)}" for _ in range(rng.randrange(1, 15))} | ({"p", "q"} if i % 10 == 0 else set()) for i in range(300)}
    rows = [(b, x) for b, s in baskets.items() for x in s]
    df = spark.createDataFrame(rows + rows[:50] + [(None, "p"), ("b1", None)], "record string, item string")
    got = {(r.item_a, r.item_b): r for r in together(memberships(df, F.col("record"), F.col("item")), 5, 1.5).collect()}
    n1 = Counter(x for s in baskets.values() for x in s)
    n2 = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    want = {p for p, n in n2.items() if n >= 5 and n * len(baskets) >= 1.5 * n1[p[0]] * n1[p[1]]}
    assert set(got) == want and ("p", "q") in want
    r = got["p", "q"]
    assert (r.n_ab, r.n_a, r.n_b, r.n) == (n2["p", "q"], n1["p"], n1["q"], 300) and math.isclose(r.pmi, math.log(r.n_ab * 300 / (r.n_a * r.n_b)))
    m = memberships(df, F.col("record"), F.col("item"))
    assert set(together(m, 5, 1.5, max_broadcast=3).collect()) == set(together(m, 5, 1.5).collect())  # by shuffle as by broadcast
    assert together(memberships(df.limit(0), F.col("record"), F.col("item")), 5, 1.5).count() == 0


def test_survivors_ties_and_nulls(spark):
    rows = [(1, "a", 5, None, "x"), (2, "a", 5, 3, None), (3, "a", 5, 3, None), (4, "b", 1, 1, "y"), (5, None, 9, 9, "z"), (6, "c", None, None, None),
        (7, "c", None, None, None), (7, "c", None, None, None)]
    df = spark.createDataFrame(rows, "id long, g string, trust int, n int, group string")
    rules = {"record": (F.lit(True), [F.col("trust"), F.col("n")]), "n": (F.col("n").isNotNull(), [F.col("n"), F.lit(0)])}
    got = {tuple(r) for r in survivors(df, F.col("g"), F.col("id"), rules).collect()}
    assert got == {("a", 1, "record", 3), ("a", 1, "n", 3), ("c", 6, "record", 7)}
    assert survivors(df.limit(0), F.col("g"), F.col("id"), rules).count() == 0
