"""Directed graphs as edge tables ``src, dst``: components, closure, reduction.

Loops cut lineage by written tables and read one or two numbers per round. Where a round advances one
hop only, several hops are composed into one job, which Spark plans as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsys.session import Scratch, parallelism

#: Hops that one job of a loop over single hops takes.
HOPS = 3

#: Hops up to which all paths of a graph are extended by single edges.
NEAR = 24

#: Members of a group of nodes that one list of `_every_path` holds.
CHUNK = 64


def _plain(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def closure(edges: DataFrame, sources: DataFrame | None = None, max_rounds: int = 1000) -> DataFrame:
    """Rows ``src, dst`` for every path of one or more edges; with ``sources`` (``node``) only paths from those.

    Semi-naive: each round extends the new paths only, with ``sources`` by single edges, as other paths are not made. Without
    ``sources`` see `_every_path`. The full result is quadratic in the depth of the graph and in the sizes of its
    components, so give ``sources`` where not all are needed.
    """
    scratch = Scratch(edges.sparkSession, "closure")
    step = scratch.write(_plain(edges).filter(F.col("src") != F.col("dst")), "edges")
    if sources is None:
        return _every_path(scratch, step, max_rounds)
    hop = step.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
    new = paths = scratch.write(step.join(sources.select(F.col("node").alias("src")).distinct(), "src", "left_semi"), "paths")
    for _ in range(max_rounds):
        more, at = None, new
        for _ in range(HOPS):
            at = at.join(hop, "dst").select("src", F.col("to").alias("dst")).distinct()
            more = at if more is None else more.unionByName(at)
        new = scratch.write(more.distinct().join(paths, ["src", "dst"], "left_anti"), "new")
        if new.isEmpty():
            return paths
        paths = paths.unionByName(new)
    raise RuntimeError("closure did not settle")


def _every_path(scratch: Scratch, step: DataFrame, max_rounds: int) -> DataFrame:
    """Rows ``src, dst`` of all paths over ``step``, plain edges of different nodes.

    Nodes with edges both ways share all their paths, so paths are made between such groups. Of the result
    nothing is shuffled: lists of at most about `CHUNK` members are, and a task pairs two of them.
    """
    mutual = step.join(_turned(step), ["src", "dst"], "left_semi")
    nodes = step.select(F.col("src").alias("node")).unionByName(step.select(F.col("dst").alias("node"))).distinct()
    groups = scratch.write(weak_components(mutual, nodes).withColumnRenamed("component", "group"), "groups")
    sizes = scratch.write(groups.groupBy("group").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "sizes")
    members = scratch.write(groups.join(sizes, "group").select("node", "id", "n"), "members")
    of = members.select("node", "id")
    inner = step.join(of.toDF("src", "a"), "src").join(of.toDF("dst", "b"), "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    paths = _group_paths(scratch, scratch.write(inner.distinct(), "steps"), max_rounds)
    # a group leads to itself if it has several members or stands on a cycle of groups
    own = sizes.filter("n > 1").select(F.col("id").alias("src"), F.col("id").alias("dst"))
    links = paths.filter("src <> dst").unionByName(paths.filter("src = dst").unionByName(own).distinct())
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / CHUNK)).alias("part")
    lists = scratch.write(members.select("id", part, "node").groupBy("id", "part").agg(F.collect_list("node").alias("nodes")), "lists")
    pairs = links.join(lists.toDF("src", "i", "from"), "src").join(lists.toDF("dst", "j", "to"), "dst")
    pairs = pairs.repartition(parallelism(step.sparkSession), "src", "i", "dst", "j")
    return pairs.select(F.explode("from").alias("src"), "to").select("src", F.explode("to").alias("dst"))


def _group_paths(scratch: Scratch, step: DataFrame, max_rounds: int) -> DataFrame:
    """Rows ``src, dst`` of all paths over ``step``.

    Only the longest paths so far are extended: by single edges up to `NEAR` hops, which makes a pair once per edge
    into its end, then by all paths, which doubles the length reached. A longer shortest path has a node at the
    reached length, and what is left of it is known, so lengths stay exact.
    """
    new = paths = scratch.write(step.withColumn("hops", F.lit(1)), "paths")
    reached = 1
    for _ in range(max_rounds):
        near = reached < NEAR
        hop = (step.withColumn("hops", F.lit(1)) if near else paths).toDF("dst", "to", "ahead")
        more, at = None, new.filter(F.col("hops") == reached)
        for _ in range(HOPS if near else 1):
            at = at.join(hop, "dst").groupBy("src", F.col("to").alias("dst")).agg(F.min(F.col("hops") + F.col("ahead")).alias("hops"))
            more = at if more is None else more.unionByName(at)
        more = more.groupBy("src", "dst").agg(F.min("hops").alias("hops"))
        new = scratch.write(more.join(paths, ["src", "dst"], "left_anti"), "new")
        if new.isEmpty():
            return paths.select("src", "dst")
        paths = paths.unionByName(new)
        reached = reached + HOPS if near else 2 * reached
    raise RuntimeError("closure did not settle")


def large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node it knows, itself included; edges ``u, v`` of either order."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them. Edges run from larger u to smaller v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
    return edges.join(least, "u").select(F.explode(linked).alias("e")).select("e.u", "e.v").filter(F.col("u") != F.col("v"))


def star_components(pairs: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Rows ``node, component`` of undirected pairs ``u, v`` of different nodes: the smallest node linked to each.

    Each round rewrites the edge set by a large star and a small star, two joins on the
    node; the minimum is pre-aggregated before its shuffle, and the join back has
    the edges on its large side, where adaptive execution splits a node that
    holds very many of them. Both keep connectivity, and the edge count never grows:
    at the fixed point every node is linked to its component's minimum only. Rounds are
    cut by a written table; the test for the fixed point reads two numbers.
    """
    scratch = Scratch(pairs.sparkSession, "stars")
    edges = scratch.write(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, path = None, scratch.last
    for _ in range(max_rounds):
        new = scratch.write(small_star(large_star(edges).distinct()).distinct(), "edges")
        now = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        old, path = path, scratch.last
        if before is not None and (now.n, now.h) == before:
            break
        edges, before = new, (now.n, now.h)
        scratch.drop(old)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def weak_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Rows ``node, component``: the smallest node reachable when directions are ignored; ``nodes`` adds isolated ones.

    Only nodes with an edge to another one take part in the rounds of `star_components`; the others are components of their own.
    """
    scratch = Scratch(edges.sparkSession, "weak")
    plain = scratch.write(_plain(edges), "edges")
    linked = star_components(plain.filter(F.col("src") != F.col("dst")).select(F.col("src").alias("u"), F.col("dst").alias("v")))
    alone = plain.filter(F.col("src") == F.col("dst")).select(F.col("src").alias("node"))
    if nodes is not None:
        alone = alone.unionByName(nodes.select("node").dropna())
    alone = alone.distinct().join(linked.select("node"), "node", "left_anti")
    return linked.unionByName(alone.withColumn("component", F.col("node")))


def strong_components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 1000) -> DataFrame:
    """Rows ``node, component``: the smallest member of each node's strongly connected component.

    Nodes with edges both ways are in one component for certain: they are contracted first, which
    leaves little of a containment graph. Nodes without an edge in or out are components of
    their own and trimmed, again and again. On the rest the smallest label travels forward; a node that keeps its own
    label roots a component, which is what reaches it backward within its
    label. Found components leave the graph, and the rest starts over.
    """
    scratch = Scratch(edges.sparkSession, "strong")
    given = scratch.write(_plain(edges).filter(F.col("src") != F.col("dst")), "given")
    mutual = given.join(_turned(given), ["src", "dst"], "left_semi")
    everyone = given.select(F.col("src").alias("node")).unionByName(given.select(F.col("dst").alias("node")))
    if nodes is not None:
        everyone = everyone.unionByName(nodes.select("node").dropna())
    groups = scratch.write(weak_components(mutual, everyone.distinct()).withColumnRenamed("component", "group"), "groups")
    contracted = given.join(groups.toDF("src", "a"), "src").join(groups.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    found = _strong(scratch, contracted.filter(F.col("src") != F.col("dst")), max_rounds)
    if found is None:
        return groups.withColumnRenamed("group", "component")
    # groups that were trimmed away, or have no edge, are on their own
    joined = groups.join(found.withColumnRenamed("node", "group"), "group", "left")
    return joined.select("node", F.coalesce("component", "group").alias("component"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose ends have an edge in and one out."""
    into = edges.select(F.col("dst").alias("src")).distinct()
    out = edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst")


def _strong(scratch: Scratch, edges: DataFrame, max_rounds: int) -> DataFrame | None:
    """Rows ``node, component`` of the nodes that survive trimming, by forward labels and backward search."""
    found: DataFrame | None = None
    rest = scratch.write(edges, "edges")
    n = rest.count()
    for _ in range(max_rounds):
        for _ in range(max_rounds):
            if not n:
                return found
            kept = rest
            for _ in range(HOPS):
                kept = _trimmed(kept)
            rest, before = scratch.write(kept, "trimmed"), n
            n = rest.count()
            if n == before:
                break
        # the smallest label travels forward
        color = scratch.write(rest.select(F.col("src").alias("node")).distinct().withColumn("color", F.col("node")), "color")
        moved = True
        while moved:
            new = color
            for _ in range(HOPS):
                came = rest.join(new.toDF("src", "c"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("c"))
                new = new.join(came, "node").select("node", F.least("color", "c").alias("color"))
            new = new.join(color.withColumnRenamed("color", "before"), "node")
            new = scratch.write(new.select("node", "color", (F.col("color") != F.col("before")).alias("moved")), "color")
            moved = not new.filter("moved").isEmpty()
            color = new.select("node", "color")
        inner = rest.join(color.toDF("src", "cs"), "src").join(color.toDF("dst", "cd"), "dst").filter("cs = cd").select("src", "dst")
        # backward from each root: what reaches it within its label; roots carry the smallest label of their component already
        roots = color.filter("node = color").select("node")
        back = closure(_turned(inner), roots)
        member = back.select(F.col("dst").alias("node"), F.col("src").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
        member = scratch.write(member.distinct(), "member")
        found = member if found is None else found.unionByName(member)
        out = member.select("node")
        rest = scratch.write(rest.join(out.toDF("src"), "src", "left_anti").join(out.toDF("dst"), "dst", "left_anti").select("src", "dst"), "edges")
        n = rest.count()
    raise RuntimeError("strong components did not settle")


def condense(edges: DataFrame, membership: DataFrame, node: str = "node", group: str = "cluster") -> DataFrame:
    """Group graph ``src, dst, weight``: how many edges run from one group to the other, the diagonal included."""
    m = membership.select(F.col(node).alias("_n"), F.col(group).alias("_g"))
    j = edges.select("src", "dst").join(m.toDF("src", "a"), "src").join(m.toDF("dst", "b"), "dst")
    return j.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("weight"))


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """Edges without self loops and without those that a longer path replaces; exact on acyclic graphs.

    An edge a -> b is replaced if a path leads to b from another node c that a has an edge to. So paths are only
    made from the nodes that branching nodes lead to, and only edges are joined with them.
    """
    e = edges.filter(F.col("src") != F.col("dst"))
    branching = e.groupBy("src").agg(F.count("*").alias("n")).filter("n > 1").select("src")
    steps = e.select("src", F.col("dst").alias("via")).join(branching, "src", "left_semi")
    paths = closure(e, steps.select(F.col("via").alias("node")))
    longer = steps.join(paths.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
    return e.join(longer, ["src", "dst"], "left_anti")


def source_nodes(edges: DataFrame) -> DataFrame:
    """Rows ``node, is_source``: a source's only outgoing edge, if any, leads to itself."""
    away = F.max((F.col("src") != F.col("dst")).cast("int"))
    out = edges.groupBy(F.col("src").alias("node")).agg((away == 0).alias("is_source"))
    only_in = edges.select(F.col("dst").alias("node")).distinct().join(out, "node", "left_anti").withColumn("is_source", F.lit(True))
    return out.unionByName(only_in)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (``node``)."""
    n = nodes.select("node").distinct()
    return edges.join(n.toDF("src"), "src", "left_semi").join(n.toDF("dst"), "dst", "left_semi")


def extreme_elements(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows ``node, is_minimal, is_maximal``: nothing of the subset reaches it, it reaches nothing of the subset."""
    inner = induced(paths.filter(F.col("src") != F.col("dst")), nodes)
    out = inner.select(F.col("src").alias("node")).distinct().withColumn("_out", F.lit(True))
    into = inner.select(F.col("dst").alias("node")).distinct().withColumn("_in", F.lit(True))
    return nodes.select("node").distinct().join(out, "node", "left").join(into, "node", "left").select("node",
        F.col("_in").isNull().alias("is_minimal"), F.col("_out").isNull().alias("is_maximal"))


def vertex_table(edges: DataFrame, attributes: DataFrame | None = None, isolated: bool = True) -> DataFrame:
    """All vertices of an edge table with their attributes (``node`` plus any); isolated vertices of the attribute table too."""
    v = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    if attributes is None:
        return v
    return v.join(attributes, "node", "full_outer" if isolated else "left")


def edge_attributes(edges: DataFrame, attributes: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Join one-to-one edge attributes on (src, dst) and fill gaps by column; a repeated key is an error."""
    twice = attributes.groupBy("src", "dst").count().filter("count > 1")
    if not twice.isEmpty():
        raise ValueError("edge attributes are not one to one")
    out = edges.join(attributes, ["src", "dst"], "left")
    return out.na.fill(defaults) if defaults else out
