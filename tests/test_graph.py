import random
import threading

from pyspark.sql import functions as F

from seqsys.operators import graph
from seqsys.operators.systems import Systems, cluster_network, clusters_output, contig_network, contigs_output, systems_output


def reach(edges):
    nxt = {}
    for a, b in edges:
        nxt.setdefault(a, set()).add(b)
    out = set()
    for s in {x for e in edges for x in e}:
        seen, todo = set(), list(nxt.get(s, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += nxt.get(x, ())
        out |= {(s, x) for x in seen}
    return out


def test_components_and_closure_against_search(spark):
    rng = random.Random(9)
    edges = [(f"v{rng.randrange(30):02d}", f"v{rng.randrange(30):02d}") for _ in range(34)] + [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c3", "d")]
    df = spark.createDataFrame([*edges, edges[0], (None, "x")], "src string, dst string")
    paths = reach(edges)
    proper = reach([e for e in edges if e[0] != e[1]])
    assert {tuple(r) for r in graph.closure(df).collect()} == proper
    nodes = {x for e in edges for x in e} | {"alone"}
    lonely = spark.createDataFrame([("alone",)], "node string")
    want = {n: min([n] + [m for m in nodes if (n, m) in paths and (m, n) in paths]) for n in nodes}
    assert {tuple(r) for r in graph.strong_components(df, lonely).collect()} == set(want.items())
    both = reach(edges + [(b, a) for a, b in edges])
    weak = {n: min([n] + [m for m in nodes if (n, m) in both]) for n in nodes}
    assert {tuple(r) for r in graph.weak_components(df, lonely).collect()} == set(weak.items())


def test_closure_of_deep_and_cyclic_graphs(spark):
    """Lengths beyond single edges, a component of several lists, cycles with and without mutual edges."""
    chain = [(i, i + 1) for i in range(70)] + [(20, 60)]
    cycle = [(100 + i, 100 + (i + 1) % 45) for i in range(45)] + [(30, 100), (110, 200)]
    star = [e for i in range(1, 200) for e in ((200, 200 + i), (200 + i, 200))] + [(399, 500), (500, 501), (501, 502), (502, 500)]
    edges = chain + cycle + star
    df = spark.createDataFrame([*edges, edges[0], (5, 5)], "src int, dst int")
    got = [tuple(r) for r in graph.closure(df).collect()]
    assert len(got) == len(set(got)) and set(got) == reach(edges)


def test_closure_of_a_large_component(spark):
    """A component of 2,001 nodes has 4 million paths; joining paths to paths would make 8 thousand million rows of them."""
    edges = spark.range(1, 2001).select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")),
        F.struct(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst")))).alias("e")).select("e.src", "e.dst")
    limit = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    limit.start()
    try:
        assert graph.closure(edges).count() == 2001 * 2001
    finally:
        limit.cancel()


def test_reduction_sources_extremes(spark):
    g = spark.createDataFrame([(0, 0, 4), (0, 1, 1), (0, 2, 1), (1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 3, 1), (3, 2, 1), (4, 4, 1)], "src int, dst int, weight int")
    assert {(r.src, r.dst) for r in graph.transitive_reduction(g).collect()} == {(0, 1), (1, 2), (3, 2)}
    assert {r.node for r in graph.source_nodes(g).collect() if r.is_source} == {2, 4}
    some = spark.createDataFrame([(0,), (1,), (4,)], "node int")
    got = {r.node: (r.is_minimal, r.is_maximal) for r in graph.extreme_elements(some, graph.closure(g)).collect()}
    assert got == {0: (True, False), 1: (False, True), 4: (True, True)}


def test_systems_fixture(spark):
    edges = [("a", "b"), ("b", "a"), ("a", "c"), ("c", "d"), ("b", "d"), ("e", "d")]
    pairs = spark.createDataFrame([(q, r, 0.95, 99.0, 0.9) for q, r in edges] + [("f", "f", 1.0, 100.0, 1.0), ("f", "a", 0.1, 99.0, 0.1)],
        "query string, reference string, coverage double, ANI double, full_ANI double")
    contigs = spark.createDataFrame([("a", 5, True), ("b", 9, False), ("c", 7, False), ("d", 8, False), ("e", 4, False), ("f", 3, True)],
        "contig string, length int, circular boolean")
    s = Systems(pairs, contigs)
    c = {r.cluster: r for r in s.clusters.collect()}
    assert {(r.node, r.cluster) for r in s.membership.collect()} == {("a", 0), ("b", 0), ("c", 1), ("d", 2), ("e", 3), ("f", 4)}
    assert [c[k].cluster_type for k in range(5)] == ["backbone", "fragment", "source", "fragment", "source"]
    assert [c[k].cluster_four_types for k in range(5)] == ["backbone", "fragment", "compound", "fragment", "maximal_not_in_system"]
    assert [c[k].sources_ancestors for k in range(5)] == [1] * 5 and [c[k].sources_circ for k in range(5)] == [0, 0, 0, 0, 1]
    assert [c[k].meta_cluster for k in range(5)] == [0, 0, 0, 0, 4]
    assert {(r.src, r.dst): r.weight for r in s.graph.collect()} == {(0, 0): 4, (0, 1): 1, (0, 2): 1, (1, 1): 1, (1, 2): 1, (2, 2): 1, (3, 3): 1, (3, 2): 1, (4, 4): 1}
    assert {(r.src, r.dst) for r in s.reduced.collect()} == {(0, 1), (1, 2), (3, 2)}
    (p,) = systems_output(s).collect()
    assert (p.system_name, p.backbone_plasmids, p.compound_clusters, p.compound_plasmids) == ("PS1", "a|b", "2", "d")
    out = {r.cluster: r for r in clusters_output(s).collect()}
    assert [out[k].systems for k in range(5)] == ["PS1", "PS1", "PS1", "", ""] and out[0].contigs == "a|b"
    assert contigs_output(s).count() == 6 and clusters_output(s).filter(F.col("representative_contig").isNull()).count() == 0
    nodes, links = contig_network(s)
    assert nodes.count() == 6 and {(r.src, r.dst) for r in links.collect()} == set(edges)
    nodes, links = cluster_network(s, drop_fragments=True)
    assert {r.node for r in nodes.collect()} == {0, 2, 4} and links.count() == 0


def test_clusters_of_no_pairs(spark):
    pairs = spark.createDataFrame([], "query string, reference string, coverage double, ANI double, full_ANI double")
    s = Systems(pairs, spark.createDataFrame([], "contig string, length int, circular boolean"))
    assert systems_output(s).count() == 0 and contigs_output(s).count() == 0 and s.reduced.count() == 0


def test_systems_of_a_known_collection(spark):
    """Types, systems, rosters and reduction of a collection whose results are known; one contig stands for each cluster."""
    # fixed values: containment between the clusters, clusters with complete members, and the expected tables
    contained = {0: [1], 1: [2, 3, 4, 5, 6, 7, 8, 9, 10], 4: [6], 9: [10]}
    complete = {0, 1, 4, 9}
    reduced = {(0, 1), (1, 2), (1, 3), (1, 4), (1, 5), (1, 7), (1, 8), (1, 9), (4, 6), (9, 10)}
    systems = {"PS1": (0, 10), "PS2": (1, 9), "PS3": (4, 1), "PS4": (9, 1)}
    of_cluster = {0: "PS1", 1: "PS1|PS2", 2: "PS1|PS2", 4: "PS1|PS2|PS3", 6: "PS1|PS2|PS3", 9: "PS1|PS2|PS4", 10: "PS1|PS2|PS4"}

    name = lambda k: f"c{k:02}"
    rows = [(name(k), name(k), 1.0, 100.0, 1.0) for k in range(11)] + [(name(a), name(b), 0.95, 98.0, 0.93) for a, v in contained.items() for b in v]
    pairs = spark.createDataFrame(rows, "query string, reference string, coverage double, ANI double, full_ANI double")
    contigs = spark.createDataFrame([(name(k), 100 + k, k in complete) for k in range(11)], "contig string, length int, circular boolean")
    s = Systems(pairs, contigs)
    out = {r.cluster: r for r in clusters_output(s).collect()}
    assert {k for k, r in out.items() if r.cluster_type == "backbone"} == complete and {r.cluster_type for k, r in out.items() if k not in complete} == {"compound"}
    assert all(out[k].systems == v for k, v in of_cluster.items())
    assert {r.system_name: (r.backbone_cluster, r.number_of_compound_clusters) for r in systems_output(s).collect()} == systems
    assert {(r.src, r.dst) for r in s.reduced.collect()} == reduced and s.graph.count() == 23
