"""Containment queries over the pair table and the accessions of contigs: edges, components, systems, gene content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqsys.functions.names import accession_key, contig_name
from seqsys.functions.values import fraction
from seqsys.operators import edges, graph
from seqsys.operators import systems as sy
from seqsys.operators.order import sample_rows
from seqsys.plans.sql import MEMBERS, contig_sql, fraction_sql

MIN_COVERAGE, MIN_ANI = 0.9, 90.0


def ani_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The last run of every (query, reference): ``coverage`` 0..1, ``ANI`` in percent, ``full_ANI`` 0..1."""
    a = spark.read.parquet(f"{d}/ani.parquet").select("reference", "query", "c", "i_local", "i_global", "run_at")
    a = a.select(
        contig_name(F.col("query")).alias("query"), contig_name(F.col("reference")).alias("reference"),
        F.struct("run_at", fraction("c", "i_local").alias("c"), fraction("i_local").alias("l"), fraction("i_global", "c", "i_local").alias("g")).alias("run"),
    ).filter(F.col("query").isNotNull() & F.col("reference").isNotNull())
    last = a.groupBy("query", "reference").agg(F.max("run").alias("run"))
    return last.select("query", "reference", F.col("run.c").alias("coverage"), (F.col("run.l") * 100).alias("ANI"), F.col("run.g").alias("full_ANI"))


def contig_attributes(spark: SparkSession, d: str) -> DataFrame:
    """The last row of every contig: ``contig, length, circular``."""
    c = spark.read.parquet(f"{d}/contigs.parquet").select("contig", "length", "circular", "loaded_at").filter(F.col("contig").isNotNull())
    t = F.lower(F.trim("circular"))
    code = F.when(t.isin("1", "true"), 1).when(t.isin("0", "false"), 0)
    last = c.groupBy("contig").agg(F.max(F.struct("loaded_at", "length", code.alias("flag"))).alias("r"))
    return last.select("contig", F.col("r.length").alias("length"), (F.coalesce(F.col("r.flag"), F.lit(0)) == 1).alias("circular"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    kept = edges.threshold_edges(ani_pairs(spark, d), MIN_COVERAGE, MIN_ANI)
    return kept.select(F.col("query").alias("src"), F.col("reference").alias("dst"), "full_ANI")


def systems_of(spark: SparkSession, d: str) -> sy.Systems:
    return sy.Systems(ani_pairs(spark, d), contig_attributes(spark, d), MIN_ANI, MIN_COVERAGE)


def threshold_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges.threshold_edges(ani_pairs(spark, d), MIN_COVERAGE, MIN_ANI).select("query", "reference")


def reciprocal_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges.threshold_edges(ani_pairs(spark, d), MIN_COVERAGE, MIN_ANI, reciprocal=True).select("query", "reference")


def contig_universe(spark: SparkSession, d: str) -> DataFrame:
    return edges.nodes_of(ani_pairs(spark, d))


def similarity_hist(spark: SparkSession, d: str) -> DataFrame:
    p = edges.min_ani_cov(edges.drop_self(ani_pairs(spark, d))).filter(F.col("min_ani_cov").isNotNull())
    return p.groupBy(F.least(F.floor(F.col("min_ani_cov") * 20), F.lit(19)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def closure_pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(_edges(spark, d)).filter(F.col("src") != F.col("dst"))


def scc_clusters(spark: SparkSession, d: str) -> DataFrame:
    return sy.number_clusters(graph.strong_components(_edges(spark, d), edges.nodes_of(ani_pairs(spark, d))))


def wcc_clusters(spark: SparkSession, d: str) -> DataFrame:
    return graph.weak_components(_edges(spark, d), edges.nodes_of(ani_pairs(spark, d)))


def cluster_graph(spark: SparkSession, d: str) -> DataFrame:
    return systems_of(spark, d).graph


def transitive_reduction(spark: SparkSession, d: str) -> DataFrame:
    return systems_of(spark, d).reduced


def contig_table(spark: SparkSession, d: str) -> DataFrame:
    s = systems_of(spark, d)
    t = s.contigs.join(sy.system_strings(s), "cluster", "left").withColumn("systems", F.coalesce("systems", F.lit("")))
    return t.select("contig", "cluster", "circular", "nchildren_in_cluster", F.round("avgANI", 6).alias("avgani"), "cluster_size", "cluster_type",
        "cluster_four_types", "representative_contig", "systems")


def cluster_table(spark: SparkSession, d: str) -> DataFrame:
    s = systems_of(spark, d)
    t = s.clusters.join(sy.joined(s.membership, "cluster", F.col("node"), "members"), "cluster").join(sy.system_strings(s), "cluster", "left")
    lengths = [F.col(c).cast("double").alias(c) for c in ("length_min", "length_median", "length_max")]
    reps = ["rep_longest", "rep_most_children", "rep_central", "rep_circular_central"]
    sources = ["sources_parents", "sources_ancestors", "sources_circ"]
    return t.select("cluster", "members", "cluster_size", "members_circ", *lengths, "cluster_type", "cluster_four_types", *sources, *reps,
        "meta_cluster", F.coalesce("systems", F.lit("")).alias("systems"))


def systems(spark: SparkSession, d: str) -> DataFrame:
    return sy.systems_output(systems_of(spark, d))


def minmax_backbones(spark: SparkSession, d: str) -> DataFrame:
    s = systems_of(spark, d)
    return graph.extreme_elements(s.names.select(F.col("backbone").alias("node")), s.reached.select(F.col("backbone").alias("src"), F.col("cluster").alias("dst")))


def type_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many clusters and contigs there are of each type."""
    s = systems_of(spark, d)
    return s.typed.join(s.kinds, "cluster").groupBy("cluster_four_types").agg(F.count("*").alias("clusters"), F.sum("cluster_size").alias("contigs"))


def cluster_scores(spark: SparkSession, d: str) -> DataFrame:
    """Least, median and most accessions that the contigs of a cluster carry."""
    n = _gene_content(spark, d).groupBy(F.col("record").alias("contig")).agg(F.count("*").alias("score"))
    return sy.cluster_scores(systems_of(spark, d).membership, n)


def cluster_subnetwork(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the clusters that are no fragments, with the sites of their contigs as samples and one accession as gene."""
    s = systems_of(spark, d)
    of = s.membership.withColumnRenamed("node", "contig")
    samples = of.select("cluster", F.substring("contig", 1, 7).alias("sample"))
    gene = _gene_content(spark, d).filter(F.col("item") == "pd99000000").select(F.col("record").alias("contig"), F.col("item").alias("accession"))
    return sy.cluster_subnetwork(s, samples=samples, genes=of.join(gene, "contig").select("accession", "cluster"))[1]


def sampled_contigs(spark: SparkSession, d: str) -> DataFrame:
    """The same two contigs of every site, whenever they are drawn."""
    c = edges.nodes_of(ani_pairs(spark, d)).withColumn("site", F.substring("node", 1, 7))
    return sample_rows(c, 2, "node", per="site")


def derep_weak(spark: SparkSession, d: str) -> DataFrame:
    return sy.derep_weak(_edges(spark, d), contig_attributes(spark, d))


def _gene_content(spark: SparkSession, d: str) -> DataFrame:
    """The distinct accessions of every contig."""
    f = spark.read.parquet(f"{d}/gene_functions.parquet")
    return f.select(contig_name(F.col("contig")).alias("record"), accession_key(F.col("accession")).alias("item")).dropna().distinct()


def gene_content_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Contigs that share at least half of the accessions that either carries."""
    s = edges.similar_records(_gene_content(spark, d), "jaccard", 0.5, min_items=5)
    return s.select("a", "b", "shared", F.round(edges.overlap_score("jaccard", F.col("shared"), F.col("n_a"), F.col("n_b")), 6).alias("jaccard"))


def basket_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Contigs that share at least 60 % of the smaller one's accessions, by all three scores."""
    s = edges.similar_records(_gene_content(spark, d), "minsize", 0.6, min_items=5)
    score = {m: edges.overlap_score(m, F.col("shared"), F.col("n_a"), F.col("n_b")) for m in ("jaccard", "minsize", "rowsize")}
    return s.select("a", "b", "shared", *[F.round(v, 6).alias(k) for k, v in score.items()])


def basket_containment(spark: SparkSession, d: str) -> DataFrame:
    """Contigs whose accessions are contained to 80 % in another one's."""
    s = edges.similar_records(_gene_content(spark, d), "rowsize", 0.8, min_items=5)
    return s.select(F.col("a").alias("query"), F.col("b").alias("reference"), "shared")


QUERIES = {f.__name__: f for f in (threshold_edges, reciprocal_edges, contig_universe, similarity_hist, closure_pairs, scc_clusters, wcc_clusters,
    cluster_graph, transitive_reduction, contig_table, cluster_table, systems, minmax_backbones, type_counts, cluster_scores, cluster_subnetwork, sampled_contigs, derep_weak, gene_content_jaccard, basket_overlaps, basket_containment)}

_PAIRS = f"""
raw AS (SELECT {contig_sql("query")} AS query, {contig_sql("reference")} AS reference, run_at,
  {fraction_sql("c", "i_local")} AS c, {fraction_sql("i_local")} AS l, {fraction_sql("i_global", "c", "i_local")} AS g FROM ani),
pairs AS (SELECT query, reference, c, l * 100 AS ani, g FROM (SELECT *, row_number() OVER (PARTITION BY query, reference ORDER BY run_at DESC NULLS
 LAST, c DESC NULLS LAST, l DESC NULLS LAST, g DESC NULLS LAST) AS k
  FROM raw WHERE query IS NOT NULL AND reference IS NOT NULL) WHERE k = 1),
e AS (SELECT query AS src, reference AS dst, g FROM pairs WHERE c >= 0.9 AND ani >= 90),
n AS (SELECT query AS node FROM pairs UNION SELECT reference FROM pairs)"""
_REACH = "WITH RECURSIVE " + _PAIRS + """,
reach AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst AND e.src <> e.dst)"""
_CLUSTERS = _REACH + """,
comp AS (SELECT node, min(m) AS component FROM (SELECT node, node AS m FROM n UNION ALL SELECT a.src, a.dst FROM reach a JOIN reach b ON a.src = b.dst
 AND a.dst = b.src) GROUP BY 1),
cl AS (SELECT node, (dense_rank() OVER (ORDER BY component) - 1)::INT AS cluster FROM comp)"""
_GRAPH = _CLUSTERS + """,
g AS (SELECT a.cluster AS src, b.cluster AS dst, count(*) AS weight FROM (SELECT src, dst FROM e UNION SELECT node, node FROM n) x JOIN cl a ON a.node
 = x.src JOIN cl b ON b.node = x.dst GROUP BY 1, 2),
cp AS (SELECT src, dst FROM g WHERE src <> dst UNION SELECT r.src, g.dst FROM cp r JOIN g ON g.src = r.dst AND g.src <> g.dst),
paths AS (SELECT src, dst FROM cp UNION SELECT cluster, cluster FROM cl)"""
_TABLES = _GRAPH + """,
attr AS (SELECT contig, length, flag = 1 AS circular FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY loaded_at DESC NULLS LAST, length
 DESC NULLS LAST, flag DESC NULLS LAST) AS k
  FROM (SELECT contig, length, loaded_at, CASE WHEN lower(trim(circular)) IN ('1', 'true') THEN 1 WHEN lower(trim(circular)) IN ('0', 'false') THEN 0
 END AS flag FROM contigs WHERE contig IS NOT NULL)) WHERE k = 1),
w AS (SELECT x.dst AS node, count(*) FILTER (x.src <> x.dst) AS children, sum(x.g) AS s FROM e x JOIN cl a ON a.node = x.src JOIN cl b ON b.node =
 x.dst WHERE a.cluster = b.cluster GROUP BY 1),
m AS (SELECT cl.node, cluster, length, coalesce(circular, false) AS circular, coalesce(children, 0) + 1 AS nchildren, coalesce(s, 0) AS s FROM cl LEFT
 JOIN attr ON attr.contig = cl.node LEFT JOIN w ON w.node = cl.node),
reps AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY length DESC NULLS LAST, nchildren DESC, node) AS k1, row_number() OVER (PARTITION
 BY cluster ORDER BY nchildren DESC, length DESC NULLS LAST, node) AS k2,
  row_number() OVER (PARTITION BY cluster ORDER BY s DESC, nchildren DESC, length DESC NULLS LAST, node) AS k3, row_number() OVER (PARTITION BY
 cluster ORDER BY circular DESC, s DESC, nchildren DESC, length DESC NULLS LAST, node) AS k4 FROM m),
per AS (SELECT cluster, string_agg(node, '|' ORDER BY node) AS members, count(*) AS cluster_size, sum(circular::INT)::BIGINT AS members_circ,
 min(length) AS length_min, median(length)::DOUBLE AS length_median, max(length) AS length_max,
  max(node) FILTER (k1 = 1) AS rep_longest, max(node) FILTER (k2 = 1) AS rep_most_children, max(node) FILTER (k3 = 1) AS rep_central, max(node) FILTER
 (k4 = 1 AND circular) AS rep_circular_central FROM reps GROUP BY 1),
src AS (SELECT src AS cluster, max((src <> dst)::INT) = 0 AS is_source FROM g GROUP BY 1),
typed AS (SELECT per.*, is_source, CASE WHEN is_source THEN 'source' WHEN members_circ > 0 THEN 'backbone' ELSE 'fragment' END AS cluster_type FROM
 per JOIN src USING (cluster)),
bb AS (SELECT cluster AS b, 'PS' || row_number() OVER (ORDER BY cluster) AS name FROM typed WHERE cluster_type = 'backbone'),
reached AS (SELECT b, name, dst AS cluster FROM paths JOIN bb ON bb.b = paths.src),
strings AS (SELECT cluster, string_agg(name, '|' ORDER BY b) AS systems, count(*) AS nb FROM reached GROUP BY 1),
ug AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), ur AS (SELECT src, dst FROM ug UNION SELECT r.src, u.dst FROM ur r JOIN ug u ON u.src = r.dst),
meta AS (SELECT src AS cluster, min(dst) AS meta_cluster FROM ur GROUP BY 1),
full_table AS (SELECT typed.*, coalesce(systems, '') AS systems, CASE WHEN cluster_type <> 'source' THEN cluster_type WHEN coalesce(nb, 0) > 0 THEN
 'compound' ELSE 'maximal_not_in_system' END AS cluster_four_types, meta_cluster,
  (SELECT count(*) FROM g JOIN typed t ON t.cluster = g.dst WHERE g.src = typed.cluster AND t.is_source) AS sources_parents,
  (SELECT count(*) FROM paths p JOIN typed t ON t.cluster = p.dst WHERE p.src = typed.cluster AND t.is_source) AS sources_ancestors,
  (SELECT count(*) FROM paths p JOIN typed t ON t.cluster = p.dst WHERE p.src = typed.cluster AND t.is_source AND t.members_circ > 0) AS sources_circ
  FROM typed LEFT JOIN strings USING (cluster) JOIN meta USING (cluster))"""
_CONTENT = f"""WITH {MEMBERS}, z AS (SELECT contig AS r, k AS i, n FROM (SELECT *, count(*) OVER (PARTITION BY contig) AS n FROM m) WHERE n >= 5),
s AS (SELECT x.r AS a, y.r AS b, x.n AS n_a, y.n AS n_b, count(*) AS shared FROM z x JOIN z y ON x.i = y.i AND x.r <> y.r GROUP BY 1, 2, 3, 4)"""

SQL = {
    "threshold_edges": f"WITH {_PAIRS} SELECT src AS query, dst AS reference FROM e",
    "reciprocal_edges": f"WITH {_PAIRS} SELECT src AS query, dst AS reference FROM e WHERE EXISTS (SELECT 1 FROM e f WHERE f.src = e.dst AND f.dst = e.src)",
    "contig_universe": f"WITH {_PAIRS} SELECT node FROM n",
    "similarity_hist": f"""WITH {_PAIRS} SELECT least(floor(least(ani / 100, c) * 20), 19)::INT AS bin, count(*) AS n FROM pairs WHERE query <>
 reference AND (ani IS NOT NULL OR c IS NOT NULL) GROUP BY 1""",
    "closure_pairs": _REACH + " SELECT src, dst FROM reach WHERE src <> dst",
    "scc_clusters": _CLUSTERS + " SELECT node, cluster FROM cl",
    "wcc_clusters": "WITH RECURSIVE " + _PAIRS + """, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e UNION SELECT node, node FROM n), r AS
 (SELECT src, dst FROM u UNION SELECT r.src, u.dst FROM r JOIN u ON u.src = r.dst) SELECT src AS node, min(dst) AS component FROM r GROUP BY 1""",
    "cluster_graph": _GRAPH + " SELECT src, dst, weight FROM g",
    "transitive_reduction": _GRAPH + """ SELECT src, dst, weight FROM g WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM cp a JOIN cp b ON a.dst = b.src
 WHERE a.src = g.src AND b.dst = g.dst AND a.dst <> g.src AND a.dst <> g.dst)""",
    "contig_table": _TABLES + """ SELECT node AS contig, m.cluster, circular, nchildren AS nchildren_in_cluster, round(s / cluster_size, 6) AS avgani,
 cluster_size, cluster_type, cluster_four_types, rep_central AS representative_contig, systems FROM m JOIN full_table USING (cluster)""",
    "cluster_table": _TABLES + """ SELECT cluster, members, cluster_size, members_circ, length_min::DOUBLE AS length_min, length_median,
 length_max::DOUBLE AS length_max, cluster_type, cluster_four_types, sources_parents, sources_ancestors, sources_circ, rep_longest, rep_most_children,
 rep_central, rep_circular_central, meta_cluster, systems FROM full_table""",
    "systems": _TABLES + """, roster AS (SELECT r.b, r.cluster, t.members FROM reached r JOIN typed t USING (cluster) WHERE r.cluster <> r.b AND
 t.cluster_type <> 'fragment'),
 plasmids AS (SELECT DISTINCT b, unnest(string_split(members, '|')) AS p FROM roster),
 cc AS (SELECT b, string_agg(cluster::VARCHAR, '|' ORDER BY cluster) AS cc, count(*) AS n FROM roster GROUP BY 1), pp AS (SELECT b, string_agg(p, '|'
 ORDER BY p) AS cp, count(*) AS n FROM plasmids GROUP BY 1)
 SELECT name AS system_name, bb.b AS backbone_cluster, t.cluster_size::INT AS number_of_backbone_plasmids, t.members AS backbone_plasmids,
 coalesce(cc, '') AS compound_clusters, coalesce(cc.n, 0)::INT AS number_of_compound_clusters,
 coalesce(pp.n, 0)::INT AS number_of_compound_plasmids, coalesce(cp, '') AS compound_plasmids FROM bb JOIN typed t ON t.cluster = bb.b LEFT JOIN cc ON
 cc.b = bb.b LEFT JOIN pp ON pp.b = bb.b""",
    "minmax_backbones": _TABLES + """ SELECT b AS node, NOT EXISTS (SELECT 1 FROM cp JOIN bb x ON x.b = cp.src WHERE cp.dst = bb.b AND cp.src <> bb.b) AS is_minimal,
 NOT EXISTS (SELECT 1 FROM cp JOIN bb x ON x.b = cp.dst WHERE cp.src = bb.b AND cp.dst <> bb.b) AS is_maximal FROM bb""",
    "type_counts": _TABLES + " SELECT cluster_four_types, count(*) AS clusters, sum(cluster_size)::BIGINT AS contigs FROM full_table GROUP BY 1",
    "cluster_scores": _CLUSTERS + f""", {MEMBERS.replace('m AS (', 'mm AS (', 1)}, z AS (SELECT contig, count(*) AS score FROM mm GROUP BY 1) SELECT
 cluster, min(score) AS score_min, median(score)::DOUBLE AS score_median, max(score) AS score_max FROM cl JOIN z ON z.contig = cl.node GROUP BY 1""",
    "cluster_subnetwork": _TABLES + f""", {MEMBERS.replace('m AS (', 'mm AS (', 1)}, kept AS (SELECT cluster FROM typed WHERE cluster_type <> 'fragment'),
 ki AS (SELECT src, dst FROM g WHERE src <> dst AND src IN (FROM kept) AND dst IN (FROM kept)), kp AS (SELECT src, dst FROM ki UNION SELECT r.src,
 e.dst FROM kp r JOIN ki e ON e.src = r.dst),
 kr AS (SELECT src::VARCHAR AS src, dst::VARCHAR AS dst FROM ki WHERE NOT EXISTS (SELECT 1 FROM ki a JOIN kp b ON a.dst = b.src WHERE a.src = ki.src
 AND b.dst = ki.dst)),
 se AS (SELECT DISTINCT cluster::VARCHAR AS src, substr(node, 1, 7) AS dst FROM cl WHERE cluster IN (FROM kept)),
 al AS (SELECT src, dst, 10 AS weight, 'cluster-cluster' AS edge_type FROM kr UNION ALL SELECT src, dst, 1, 'sample-cluster' FROM se),
 ap AS (SELECT src, dst FROM al UNION SELECT r.src, e.dst FROM ap r JOIN al e ON e.src = r.dst)
 SELECT src, dst, weight::BIGINT AS weight, edge_type FROM al WHERE NOT EXISTS (SELECT 1 FROM al a JOIN ap b ON a.dst = b.src WHERE a.src = al.src AND
 b.dst = al.dst)
 UNION ALL SELECT DISTINCT k, cluster::VARCHAR, 1, 'gene-cluster' FROM mm JOIN cl ON cl.node = mm.contig WHERE k = 'pd99000000' AND cluster IN (FROM kept)""",
    "sampled_contigs": f"""WITH {_PAIRS} SELECT node, substr(node, 1, 7) AS site FROM n QUALIFY row_number() OVER (PARTITION BY substr(node, 1, 7)
 ORDER BY md5('123:' || node), node) <= 2""",
    "derep_weak": _TABLES + """, u AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst), wr AS (SELECT src, dst
 FROM u UNION SELECT r.src, u.dst FROM wr r JOIN u ON u.src = r.dst),
 wc AS (SELECT src AS node, min(dst) AS component FROM wr GROUP BY 1)
 SELECT first_value(wc.node) OVER (PARTITION BY component ORDER BY coalesce(length, -1) DESC, wc.node) AS representative, wc.node AS contig FROM wc
 LEFT JOIN attr ON attr.contig = wc.node""",
    "gene_content_jaccard": _CONTENT + """ SELECT a, b, shared, round(shared / (n_a + n_b - shared), 6) AS jaccard FROM s WHERE a < b AND shared * 10
 >= 5 * (n_a + n_b - shared)""",
    "basket_overlaps": _CONTENT
    + """ SELECT a, b, shared, round(shared / (n_a + n_b - shared), 6) AS jaccard, round(shared / least(n_a, n_b), 6) AS minsize, round(shared / n_a,
 6) AS rowsize FROM s WHERE a < b AND shared * 10 >= 6 * least(n_a, n_b)""",
    "basket_containment": _CONTENT + " SELECT a AS query, b AS reference, shared FROM s WHERE shared * 10 >= 8 * n_a",
}
