"""Clusters of contigs, their types, representatives, and the systems that grow from backbones."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqsys.operators.graph import closure, condense, source_nodes, strong_components, transitive_reduction, weak_components
from seqsys.operators.order import number_rows
from seqsys.session import Scratch


def cluster_type(is_source: Column, members_circ: Column) -> Column:
    """source, backbone (holds a complete member) or fragment."""
    return F.when(is_source, "source").when(members_circ > 0, "backbone").otherwise("fragment")


def cluster_four_types(kind: Column, has_backbones: Column) -> Column:
    """A source with backbones is a compound, one without is maximal and in no system."""
    return F.when(kind != "source", kind).when(has_backbones, "compound").otherwise("maximal_not_in_system")


def number_clusters(components: DataFrame) -> DataFrame:
    """Give components 0-based ids by their smallest member name."""
    ids = number_rows(components.select("component").distinct(), ["component"], "cluster")
    return components.join(ids, "component").select("node", F.col("cluster").cast("int").alias("cluster"))


def joined(df: DataFrame, key: str, value: Column, out: str, order: Column | None = None) -> DataFrame:
    """Values per key as one string, ``|`` between them, in order; for the columns of output files only."""
    item = F.struct((value if order is None else order).alias("o"), value.cast("string").alias("v"))
    return df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_set(item)), lambda x: x["v"]), "|").alias(out))


class Systems:
    """Contigs clustered by mutual containment, with types, representatives and systems.

    ``pairs``: unique (query, reference) with ``coverage`` 0..1, ``ANI`` in percent, ``full_ANI``
    0..1. ``contigs``: unique ``contig`` with ``length`` and ``circular``; a vertex without an
    entry counts as incomplete and of unknown length. The universe are all names
    of the pair table.

    Every table is made when it is first asked for, and long: one row per member, path end or roster entry.
    """

    def __init__(self, pairs: DataFrame, contigs: DataFrame, min_ani: float = 90.0, min_coverage: float = 0.9):
        self.pairs, self.attributes = pairs, contigs
        self.min_ani, self.min_coverage = min_ani, min_coverage
        self.scratch = Scratch(pairs.sparkSession, "systems")

    @cached_property
    def _universe_and_edges(self) -> DataFrame:
        ok = F.coalesce((F.col("coverage") >= self.min_coverage) & (F.col("ANI") >= self.min_ani), F.lit(False))
        return self.scratch.write(self.pairs.select(F.col("query").alias("src"), F.col("reference").alias("dst"), "full_ANI", ok.alias("ok")), "pairs")

    @cached_property
    def edges(self) -> DataFrame:
        """Containment edges ``src, dst, full_ANI``."""
        return self._universe_and_edges.filter("ok").select("src", "dst", "full_ANI")

    @cached_property
    def nodes(self) -> DataFrame:
        p = self._universe_and_edges
        return self.scratch.write(p.select(F.col("src").alias("node")).unionByName(p.select(F.col("dst").alias("node"))).distinct(), "nodes")

    @cached_property
    def membership(self) -> DataFrame:
        """Rows ``node, cluster``."""
        return self.scratch.write(number_clusters(strong_components(self.edges, self.nodes)), "members")

    @cached_property
    def graph(self) -> DataFrame:
        """The cluster graph ``src, dst, weight`` with self loops."""
        loops = self.nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"))
        return self.scratch.write(condense(self.edges.select("src", "dst").unionByName(loops).distinct(), self.membership), "graph")

    @cached_property
    def members(self) -> DataFrame:
        """Rows ``node, cluster, length, circular, nchildren_in_cluster, ani_sum``: attributes and weights within clusters."""
        of, own = self.membership, self.attributes.select(F.col("contig").alias("node"), "length", "circular")
        inner = self.edges.join(of.toDF("src", "cs"), "src").join(of.toDF("dst", "cd"), "dst").filter("cs = cd")
        weight = inner.groupBy(F.col("dst").alias("node")).agg(F.count(F.when(F.col("src") != F.col("dst"), 1)).alias("children"), F.sum("full_ANI").alias("ani_sum"))
        m = of.join(own, "node", "left").join(weight, "node", "left").select(
            "node", "cluster", "length", F.coalesce("circular", F.lit(False)).alias("circular"),
            (F.coalesce("children", F.lit(0)) + 1).alias("nchildren_in_cluster"), F.coalesce("ani_sum", F.lit(0.0)).alias("ani_sum"),
        )
        return self.scratch.write(m, "weighted")

    @cached_property
    def typed(self) -> DataFrame:
        """One row per cluster: sizes, lengths, four representatives and type."""
        high = lambda c: -F.coalesce(F.col(c).cast("double"), F.lit(-1.0))
        best = lambda *ranks: F.min_by("node", F.struct(*[high(r) for r in ranks], F.col("node")))
        central = ("ani_sum", "nchildren_in_cluster", "length")
        complete = F.min_by(F.when(F.col("circular"), F.col("node")), F.struct(~F.col("circular"), *[high(r) for r in central], F.col("node")))
        per = self.members.groupBy("cluster").agg(
            F.count("*").alias("cluster_size"), F.sum(F.col("circular").cast("int")).alias("members_circ"),
            F.min("length").alias("length_min"), F.median("length").alias("length_median"), F.max("length").alias("length_max"),
            best("length", "nchildren_in_cluster").alias("rep_longest"), best("nchildren_in_cluster", "length").alias("rep_most_children"),
            best(*central).alias("rep_central"), complete.alias("rep_circular_central"),
        )
        kinds = source_nodes(self.graph).withColumnRenamed("node", "cluster")
        return self.scratch.write(per.join(kinds, "cluster").withColumn("cluster_type", cluster_type(F.col("is_source"), F.col("members_circ"))), "typed")

    @cached_property
    def meta(self) -> DataFrame:
        """Rows ``cluster, meta_cluster``: the weak components of the cluster graph."""
        return weak_components(self.graph).toDF("cluster", "meta_cluster")

    @cached_property
    def names(self) -> DataFrame:
        """Rows ``backbone, system_name``: systems are numbered along the backbones."""
        backbones = self.typed.filter("cluster_type = 'backbone'").select(F.col("cluster").alias("backbone"))
        numbered = number_rows(backbones, ["backbone"])
        return self.scratch.write(numbered.select("backbone", F.concat(F.lit("PS"), F.col("i") + 1).alias("system_name")), "names")

    @cached_property
    def reached(self) -> DataFrame:
        """Rows ``backbone, system_name, cluster``: all clusters of each system, its backbone included."""
        proper = closure(self.graph, self.names.select(F.col("backbone").alias("node"))).toDF("backbone", "cluster")
        own = self.names.select("backbone", F.col("backbone").alias("cluster"))
        return self.scratch.write(proper.unionByName(own).join(self.names, "backbone").select("backbone", "system_name", "cluster"), "reached")

    @cached_property
    def to_sources(self) -> DataFrame:
        """Rows ``cluster, source``: the sources each cluster is contained in, itself if it is one."""
        sources = self.typed.filter("is_source").select(F.col("cluster").alias("node"))
        back = closure(self.graph.select(F.col("dst").alias("src"), F.col("src").alias("dst")), sources).toDF("source", "cluster")
        return back.select("cluster", "source").unionByName(sources.select(F.col("node").alias("cluster"), F.col("node").alias("source")))

    @cached_property
    def kinds(self) -> DataFrame:
        """Rows ``cluster, cluster_four_types``."""
        held = self.reached.select("cluster").distinct().withColumn("_held", F.lit(True))
        return self.typed.join(held, "cluster", "left").select("cluster",
            cluster_four_types(F.col("cluster_type"), F.col("_held").isNotNull()).alias("cluster_four_types"))

    @cached_property
    def clusters(self) -> DataFrame:
        """`typed` with the meta cluster, the four types, and how many sources are direct parents and ancestors."""
        count_if = lambda c: F.sum(c.cast("int"))
        is_source = self.typed.select(F.col("cluster").alias("dst"), F.col("is_source").alias("s"), (F.col("members_circ") > 0).alias("c"))
        parents = self.graph.join(is_source, "dst").groupBy(F.col("src").alias("cluster")).agg(count_if(F.col("s")).alias("sources_parents"))
        up = self.to_sources.join(is_source.withColumnRenamed("dst", "source"), "source")
        ancestors = up.groupBy("cluster").agg(F.count("*").alias("sources_ancestors"), count_if(F.col("c")).alias("sources_circ"))
        out = self.typed.join(self.meta, "cluster").join(self.kinds, "cluster").join(parents, "cluster", "left").join(ancestors, "cluster", "left")
        return out.na.fill(0, ["sources_ancestors", "sources_circ"])

    @cached_property
    def contigs(self) -> DataFrame:
        """One row per contig with what is known of its cluster."""
        info = self.typed.join(self.meta, "cluster").join(self.kinds, "cluster").select("cluster", "meta_cluster", "cluster_size", "cluster_type",
            "cluster_four_types", F.col("rep_central").alias("representative_contig"))
        return self.members.join(info, "cluster").select(
            F.col("node").alias("contig"), "cluster", "length", "circular", "nchildren_in_cluster", (F.col("ani_sum") / F.col("cluster_size")).alias("avgANI"),
            "meta_cluster", "cluster_size", "cluster_type", "cluster_four_types", "representative_contig",
        )

    @cached_property
    def roster(self) -> DataFrame:
        """Rows ``backbone, system_name, cluster``: the compound clusters of each system, without its backbone and fragments."""
        kinds = self.typed.select("cluster", "cluster_type")
        return self.reached.join(kinds, "cluster").filter((F.col("cluster") != F.col("backbone")) & (F.col("cluster_type") != "fragment")).select("backbone", "system_name", "cluster")

    @cached_property
    def reduced(self) -> DataFrame:
        """The cluster graph without self loops and edges that a longer path replaces."""
        return transitive_reduction(self.graph)


def system_strings(s: Systems) -> DataFrame:
    """Rows ``cluster, systems``: the systems of each cluster in one string."""
    return joined(s.reached, "cluster", F.col("system_name"), "systems", F.col("backbone"))


def contigs_output(s: Systems) -> DataFrame:
    """The contig table as written out."""
    t = s.contigs.join(system_strings(s), "cluster", "left")
    return t.select("contig", "cluster", F.col("cluster_four_types").alias("cluster_type"), F.col("circular").cast("int").alias("circular"),
        "representative_contig", F.coalesce("systems", F.lit("")).alias("systems"))


def clusters_output(s: Systems) -> DataFrame:
    """The cluster table as written out."""
    t = s.typed.join(s.kinds, "cluster").join(joined(s.membership, "cluster", F.col("node"), "contigs"), "cluster").join(system_strings(s), "cluster", "left")
    return t.select(
        "cluster", F.col("cluster_four_types").alias("cluster_type"), F.col("cluster_size").alias("number_of_contigs"), F.col("members_circ").alias("number_of_circular_contigs"),
        "contigs", F.col("rep_central").alias("representative_contig"), F.coalesce("systems", F.lit("")).alias("systems"),
    )


def systems_output(s: Systems) -> DataFrame:
    """The system table as written out: backbone and compound clusters and their plasmids."""
    of = s.membership
    plasmids = s.roster.join(of, "cluster").select("backbone", "node").distinct()
    of_backbone = s.names.join(of.withColumnRenamed("cluster", "backbone"), "backbone")
    counts = (
        s.roster.groupBy("backbone").agg(F.count("*").cast("int").alias("nc")),
        plasmids.groupBy("backbone").agg(F.count("*").cast("int").alias("np")),
        joined(s.roster, "backbone", F.col("cluster"), "cc"),
        joined(plasmids, "backbone", F.col("node"), "cp"),
    )
    own = of_backbone.groupBy("backbone", "system_name").agg(F.count("*").cast("int").alias("nb"))
    t = own.join(joined(of_backbone, "backbone", F.col("node"), "bp"), "backbone")
    for c in counts:
        t = t.join(c, "backbone", "left")
    text, number = (lambda c: F.coalesce(c, F.lit(""))), (lambda c: F.coalesce(c, F.lit(0)))
    return t.select(
        "system_name", F.col("backbone").alias("backbone_cluster"), F.col("nb").alias("number_of_backbone_plasmids"), F.col("bp").alias("backbone_plasmids"),
        text("cc").alias("compound_clusters"), number("nc").alias("number_of_compound_clusters"), number("np").alias("number_of_compound_plasmids"), text("cp").alias("compound_plasmids"),
    )


def graph_output(s: Systems) -> DataFrame:
    return s.graph.select(F.col("src").alias("shorter_cluster"), F.col("dst").alias("longer_cluster"))


def contig_network(s: Systems) -> tuple[DataFrame, DataFrame]:
    """Vertices with labels and edges without self loops, of the contig graph."""
    t = contigs_output(s)
    label = F.format_string("contig:%s\ncluster:%s\nsystem:%s", "contig", F.col("cluster").cast("string"), "systems").alias("label")
    return t.select(F.col("contig").alias("node"), label, *[c for c in t.columns if c != "contig"]), s.edges.filter(F.col("src") != F.col("dst"))


def cluster_network(s: Systems, drop_fragments: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vertices with labels and the reduced, weighted edges of the cluster graph; ``drop_fragments`` leaves fragment clusters and their edges out."""
    t = clusters_output(s)
    label = F.format_string("cluster:%s\nrep:%s\nsystem:%s", F.col("cluster").cast("string"), "representative_contig", "systems").alias("label")
    nodes, edges = t.select(F.col("cluster").alias("node"), label, *[c for c in t.columns if c != "cluster"]), s.reduced
    if drop_fragments:
        nodes = nodes.filter("cluster_type <> 'fragment'")
        for end in ("src", "dst"):
            edges = edges.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    return nodes, edges.select("src", "dst", "weight")


def cluster_subnetwork(s: Systems, clusters: DataFrame | None = None, samples: DataFrame | None = None, genes: DataFrame | None = None,
    drop_fragments: bool = True, attributes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices ``node, node_type, cluster_type, node_size`` and edges ``src, dst, weight, edge_type`` of a part of the cluster graph; names are strings.

    ``clusters`` (``cluster``) restricts the graph, which is reduced within itself. ``samples`` (``cluster, sample``) adds an edge
    from every cluster to its samples unless a longer path says the same; then edges between clusters weigh 10 and others 1.
    ``genes`` (``accession, cluster``) adds edges from accessions as they are. ``attributes`` (``node`` and any of the vertex columns) override.
    """
    kept = s.typed.select("cluster", "cluster_type")
    if clusters is not None:
        kept = kept.join(clusters.select("cluster").distinct(), "cluster", "left_semi")
    if drop_fragments:
        kept = kept.filter("cluster_type <> 'fragment'")
    kept = s.scratch.write(kept.withColumn("node", F.col("cluster").cast("string")), "kept")
    own = kept.select("cluster")
    inner = s.graph.join(own.toDF("src"), "src", "left_semi").join(own.toDF("dst"), "dst", "left_semi")
    inner = transitive_reduction(inner).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"),
        F.col("weight").cast("long").alias("weight"))
    edges = inner.withColumn("edge_type", F.lit("cluster-cluster"))
    vertex = lambda df, kind: df.select("node", F.lit(kind).alias("node_type"), F.lit(None).cast("string").alias("cluster_type"))
    nodes = kept.select("node", F.lit("cluster").alias("node_type"), "cluster_type")
    if samples is not None:
        of = samples.join(own, "cluster", "left_semi").select(F.col("cluster").cast("string").alias("src"), F.col("sample").cast("string").alias("dst")).distinct()
        both = s.scratch.write(edges.withColumn("weight", F.lit(10).cast("long")).unionByName(of.withColumns({"weight": F.lit(1).cast("long"),
            "edge_type": F.lit("sample-cluster")})), "sampled")
        edges = transitive_reduction(both)
        nodes = nodes.unionByName(vertex(of.select(F.col("dst").alias("node")).distinct(), "sample"))
    if genes is not None:
        of = genes.join(own, "cluster", "left_semi").select(F.col("accession").alias("src"), F.col("cluster").cast("string").alias("dst")).distinct()
        edges = edges.unionByName(of.withColumns({"weight": F.lit(1).cast("long"), "edge_type": F.lit("gene-cluster")}))
        nodes = nodes.unionByName(vertex(of.select(F.col("src").alias("node")).distinct(), "gene"))
    nodes = nodes.withColumn("node_size", F.lit(1))
    if attributes is not None:
        names = [c for c in attributes.columns if c != "node"]
        given = attributes.select("node", *[F.col(c).alias(f"_{c}") for c in names])
        nodes = nodes.join(given, "node", "full_outer")
        nodes = nodes.withColumns({c: F.coalesce(f"_{c}", c) if c in nodes.columns else F.col(f"_{c}") for c in names}).drop(*[f"_{c}" for c in names])
    return nodes, edges


def cluster_scores(membership: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows ``cluster, score_min, score_median, score_max`` of a number known of contigs (``contig, score``)."""
    each = membership.join(scores.select(F.col("contig").alias("node"), "score"), "node")
    return each.groupBy("cluster").agg(F.min("score").alias("score_min"), F.median("score").alias("score_median"), F.max("score").alias("score_max"))


def derep_weak(edges: DataFrame, lengths: DataFrame) -> DataFrame:
    """Weak-component dereplication: ``representative`` (the longest, then the smaller name) and ``contig``."""
    members = weak_components(edges.filter(F.col("src") != F.col("dst"))).join(lengths.select(F.col("contig").alias("node"), "length"), "node", "left")
    rep = members.groupBy("component").agg(F.min_by("node", F.struct(-F.coalesce("length", F.lit(-1)), F.col("node"))).alias("representative"))
    return members.join(rep, "component").select("representative", F.col("node").alias("contig"))
