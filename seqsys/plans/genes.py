"""Queries over gene calls and their annotations: intervals, co-occurrence, cover, cargo."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqsys.functions.names import accession_key, contig_name
from seqsys.functions.values import present_text, rounded
from seqsys.operators import annot, cooc, coverage, intervals, layout
from seqsys.operators.order import number_rows
from seqsys.plans.containment import _TABLES, contig_attributes, systems_of
from seqsys.plans.sql import NONE, accession_sql, contig_sql

WINDOW = 1000


def calls(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of each gene call: ``gene_callers_id, contig, start, stop, direction`` (f or r), non-empty, start < stop."""
    g = spark.read.parquet(f"{d}/gene_calls.parquet").select("gene_callers_id", "contig", "start", "stop", "direction", "loaded_at")
    g = g.filter(F.col("gene_callers_id").isNotNull() & F.col("start").isNotNull() & F.col("stop").isNotNull() & (F.col("start") != F.col("stop")))
    row = F.struct("loaded_at", F.least("start", "stop").alias("start"), F.greatest("start", "stop").alias("stop"),
        F.when(F.col("direction").isin("r", "-"), "r").otherwise("f").alias("direction"), contig_name(F.col("contig")).alias("contig"))
    last = g.select("gene_callers_id", row.alias("g")).filter(F.col("g.contig").isNotNull()).groupBy("gene_callers_id").agg(F.max("g").alias("g"))
    return last.select("gene_callers_id", "g.contig", "g.start", "g.stop", "g.direction")


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """One row per gene call and accession with a source."""
    f = spark.read.parquet(f"{d}/gene_functions.parquet").select("gene_callers_id", "accession", "source")
    f = f.select("gene_callers_id", accession_key(F.col("accession")).alias("accession"), F.when(present_text(F.col("source")), F.col("source")).alias("source"))
    return f.filter((F.col("gene_callers_id") > 0) & F.col("accession").isNotNull()).groupBy("gene_callers_id",
        "accession").agg(F.coalesce(F.max("source"), F.lit("unnamed")).alias("source"))


def genes(spark: SparkSession, d: str) -> DataFrame:
    """Annotated genes with a unique ``row``."""
    return annot.merge_calls(annotations(spark, d), calls(spark, d)).withColumn("row", F.concat_ws(":", "gene_callers_id", "accession"))


def coverage_union(spark: SparkSession, d: str) -> DataFrame:
    return coverage.union_coverage(calls(spark, d), "contig", "start", "stop")


def depth_profile(spark: SparkSession, d: str) -> DataFrame:
    return coverage.depth_profile(calls(spark, d), ["contig"], "start", "stop")


def slop_intervals(spark: SparkSession, d: str) -> DataFrame:
    g = calls(spark, d).join(contig_attributes(spark, d).select("contig", "length"), "contig").filter(F.col("length").isNotNull())
    return intervals.slop(g, 250, "length").select("gene_callers_id", "contig", "start", "stop")


def merge_intervals(spark: SparkSession, d: str) -> DataFrame:
    aggs = {"n": F.count("*"), "n_reverse": F.count_if(F.col("direction") == "r"), "first_gene": F.min("gene_callers_id")}
    return intervals.merge(calls(spark, d), ["contig"], aggs=aggs)


def overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of overlapping gene calls of one contig."""
    g = calls(spark, d).select("gene_callers_id", "contig", "start", "stop")
    j = intervals.overlap_join(g, g, "contig", 2000).filter(F.col("gene_callers_id_l") < F.col("gene_callers_id_r"))
    return j.select(F.col("gene_callers_id_l").alias("gene_a"), F.col("gene_callers_id_r").alias("gene_b"),
        (F.least("stop_l", "stop_r") - F.greatest("start_l", "start_r")).alias("bases"))


def rotate_coords(spark: SparkSession, d: str) -> DataFrame:
    """Genes of circular contigs after turning the origin by a third of the length."""
    c = contig_attributes(spark, d).filter("circular and length is not null")
    g = calls(spark, d).join(c, "contig").filter(F.col("stop") <= F.col("length"))
    r = intervals.rotate(g, F.floor(F.col("length") / 3), F.col("length"))
    return r.select("gene_callers_id", "contig", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "part")


def dense_rank_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = intervals.with_run_index(calls(spark, d), "direction", ["contig"], ["start", "gene_callers_id"], "run")
    return runs.select("gene_callers_id", F.col("run").cast("int").alias("run"))


def tiers(spark: SparkSession, d: str) -> DataFrame:
    return intervals.tiers(calls(spark, d), "contig")


def gene_tiers(spark: SparkSession, d: str) -> DataFrame:
    """The row of a drawing for every gene call."""
    c = calls(spark, d)
    return c.join(intervals.interval_tiers(c, "contig"), ["contig", "start", "stop"]).select("gene_callers_id", "tier")


def locus_genes(spark: SparkSession, d: str) -> DataFrame:
    """Annotated genes inside the loci within 2,000 bases of one well-known accession."""
    g = genes(spark, d)
    lengths = contig_attributes(spark, d).select("contig", "length").filter(F.col("length").isNotNull())
    windows = layout.loci(g.filter(F.col("accession") == "pd99000000"), lengths, 2000)
    return layout.locus_genes(g, windows).select("row", "locus")


def locus_split(spark: SparkSession, d: str) -> DataFrame:
    """Loci within 500 bases of the genes with one well-known accession."""
    g = genes(spark, d).filter(F.col("accession") == "pd99000000")
    lengths = contig_attributes(spark, d).select("contig", "length").filter(F.col("length").isNotNull())
    return layout.loci(g, lengths, 500).select("contig", "start", "stop", "locus")


def centre_gaps(spark: SparkSession, d: str) -> DataFrame:
    return layout.centre(genes(spark, d), "pd99000000")


def cooc_coord(spark: SparkSession, d: str) -> DataFrame:
    """Accession pairs within a window of bases, contigs per pair and orientation."""
    return cooc.pair_counts(cooc.window_pairs(genes(spark, d), WINDOW)).withColumn("orientation", F.col("orientation").cast("int"))


def cooc_instances(spark: SparkSession, d: str) -> DataFrame:
    return cooc.pair_counts(cooc.window_pairs(genes(spark, d), WINDOW), cap_per_contig=False).groupBy("later", "earlier").agg(F.sum("n").alias("n"))


def cooc_window0(spark: SparkSession, d: str) -> DataFrame:
    """Accession pairs on genes of equal start: distance 0 in genes."""
    return cooc.pair_counts(cooc.window_pairs(genes(spark, d), 0, by_rank=True)).withColumn("orientation", F.col("orientation").cast("int"))


def cooc_gene_rank(spark: SparkSession, d: str) -> DataFrame:
    """Accession pairs on genes at most two ranks apart."""
    return cooc.pair_counts(cooc.window_pairs(genes(spark, d), 2, by_rank=True)).withColumn("orientation", F.col("orientation").cast("int"))


def _symmetric(spark: SparkSession, d: str) -> DataFrame:
    return cooc.symmetric_counts(cooc.pair_counts(cooc.window_pairs(genes(spark, d), WINDOW)))


def cooc_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return _symmetric(spark, d)


def cooc_norms(spark: SparkSession, d: str) -> DataFrame:
    n = cooc.window_norms(genes(spark, d), WINDOW)
    return n.select("a", "b", "total", *[rounded(c, 6).alias(c) for c in n.columns[3:]])


def exact_overlap(spark: SparkSession, d: str) -> DataFrame:
    return cooc.exact_overlaps(genes(spark, d))


def topk_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cooc.top_pairs(_symmetric(spark, d).filter("a < b"), "total", 50).select("a", "b", "total")


def bottomk_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cooc.top_pairs(_symmetric(spark, d).filter("a < b"), "total", 50, largest=False).select("a", "b", "total")


def topk_masked(spark: SparkSession, d: str) -> DataFrame:
    """Both ends of the pairs of one accession family with any but the most frequent accession."""
    scored = _symmetric(spark, d)
    return cooc.top_pairs(scored, "total", 25, keep=(F.col("a").startswith("pd"), None), drop=(["pd99000000"], ["pd99000000"]), symmetric=True,
        tail=True).select("a", "b", "total", "is_tail")


def greedy_matching(spark: SparkSession, d: str) -> DataFrame:
    """Accessions paired one to one by how often they stand together, pairs on 3 contigs or more."""
    return cooc.greedy_matching(_symmetric(spark, d).filter("a < b and total >= 3").select("a", "b", "total"), "total")


def accession_freq(spark: SparkSession, d: str) -> DataFrame:
    f = cooc.frequencies(genes(spark, d), "source")
    return f.select("accession", "instances", "contigs", "groups", *[F.round(f"{c}_ratio", 8).alias(f"{c}_ratio") for c in ("instances", "contigs", "groups")])


def grouped_freq(spark: SparkSession, d: str) -> DataFrame:
    """Accessions by sources, sites and directions."""
    g = genes(spark, d).withColumn("site", F.substring("contig", 1, 7))
    f = cooc.grouped_frequencies(g, ["source", "site", "direction"])
    return f.select(*[c if not c.endswith("_ratio") else F.round(c, 8).alias(c) for c in f.columns])


def label_odds(spark: SparkSession, d: str) -> DataFrame:
    """Accessions on circular against other contigs."""
    g = genes(spark, d).join(contig_attributes(spark, d).select("contig", "circular"), "contig")
    o = cooc.label_odds(g, "circular", True, False)
    return o.select("accession", "contigs_first", "contigs_second", *[F.round(c, 6).alias(c) for c in ("ratio_first", "ratio_second", "odds")])


def gene_call_merge(spark: SparkSession, d: str) -> DataFrame:
    return genes(spark, d).select("gene_callers_id", "accession", "source", "contig", "start", "stop", "direction")


def gene_call_merge_outer(spark: SparkSession, d: str) -> DataFrame:
    return annot.merge_calls(annotations(spark, d), calls(spark, d), dummies=True).select("gene_callers_id", "accession", "source", "contig", "start",
        "stop", """direction""")


def gene_pivot(spark: SparkSession, d: str) -> DataFrame:
    g = genes(spark, d)
    return annot.gene_pivot(g, cooc.frequencies(g))


def symbol_merge(spark: SparkSession, d: str) -> DataFrame:
    g = genes(spark, d)
    pivot = annot.gene_pivot(g, cooc.frequencies(g))
    return annot.symbol_merge(pivot, annot.symbol_members(g, pivot))


def symbol_sources(spark: SparkSession, d: str) -> DataFrame:
    """Accessions met with each representative, by source."""
    g = genes(spark, d)
    return annot.symbol_members(g, annot.gene_pivot(g, cooc.frequencies(g)))


def accession_contigs(spark: SparkSession, d: str) -> DataFrame:
    return annot.accession_contigs(genes(spark, d))


def _described(spark: SparkSession, d: str) -> DataFrame:
    f = spark.read.parquet(f"{d}/gene_functions.parquet").select("accession", "description")
    return f.select(accession_key(F.col("accession")).alias("accession"), F.when(present_text(F.col("description")), F.col("description")).alias("description"))


def described_accessions(spark: SparkSession, d: str) -> DataFrame:
    """Accessions of genes with their frequency and description."""
    return annot.describe(cooc.frequencies(genes(spark, d)).select("accession", "contigs"), annot.descriptions(_described(spark, d)))


def anchor_directions(spark: SparkSession, d: str) -> DataFrame:
    """Direction of the first of the most frequent accessions on each contig."""
    g = genes(spark, d)
    top = number_rows(cooc.frequencies(g).orderBy(F.col("contigs").desc(), "accession").limit(20).select("accession", "contigs"),
        [F.col("contigs").desc(), "accession"], "position")
    return annot.anchor_directions(g, top).select("contig", "accession", "direction")


def cargo_split(spark: SparkSession, d: str) -> DataFrame:
    s = systems_of(spark, d)
    return annot.cargo(genes(spark, d), s.membership.withColumnRenamed("node", "contig"), s.reached, strict=False)


def cargo_strict(spark: SparkSession, d: str) -> DataFrame:
    """Strict cargo, with regard to the annotations of one source, and the sites it was met at."""
    s, g = systems_of(spark, d), genes(spark, d)
    of = s.membership.withColumnRenamed("node", "contig")
    sites = of.select("contig", F.substring("contig", 1, 3).alias("sample"))
    return annot.cargo(g, of, s.reached, strict_sources=["ProFam_v9"], detected=sites).drop("is_strict")


def anchor_cover(spark: SparkSession, d: str) -> DataFrame:
    """The anchors that cover the contigs of all systems."""
    s = systems_of(spark, d)
    contigs = s.membership.join(s.reached.select("cluster").distinct(), "cluster").select(F.col("node").alias("contig"))
    return annot.anchor_cover(genes(spark, d).join(contigs, "contig", "left_semi"))


def pair_summary(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as alignment blocks: part on supplier, 10 bases per line and unit."""
    l = spark.read.parquet(f"{d}/lineitem.parquet")
    start = F.col("l_linenumber") * 10
    b = l.select(
        F.col("l_suppkey").alias("ref"), F.col("l_partkey").alias("query"), F.lit(1000).alias("query_len"), start.alias("query_start"),
        (start + F.col("l_quantity").cast("int")).alias("query_end"), (F.col("l_discount") * 100).cast("int").alias("mismatches"),
    )
    s = coverage.pair_summary(b)
    return s.select("ref", "query", "mismatches", "nblocks", *[F.round(c, 10).alias(c.lower()) for c in ("query_cov", "query_cov_uniq", "ANI", "full_ANI")])


QUERIES = {
    f.__name__: f
    for f in (
        coverage_union, depth_profile, slop_intervals, merge_intervals, overlap_join, rotate_coords, dense_rank_runs, tiers, gene_tiers, locus_split, locus_genes, centre_gaps,
        cooc_coord, cooc_instances, cooc_gene_rank, cooc_window0, cooc_symmetric, cooc_norms, exact_overlap, topk_pairs, bottomk_pairs, topk_masked, greedy_matching,
        accession_freq, grouped_freq, label_odds, gene_call_merge, gene_call_merge_outer, gene_pivot, symbol_merge, symbol_sources, accession_contigs,
        described_accessions, anchor_directions, cargo_split, cargo_strict, anchor_cover, pair_summary,
    )
}

_KEY = f"lower({accession_sql('accession')})"
_CALLS = f"""
calls AS (SELECT * EXCLUDE (k, loaded_at) FROM (SELECT *, row_number() OVER (PARTITION BY gene_callers_id ORDER BY loaded_at DESC NULLS LAST, start
 DESC, stop DESC, direction DESC, contig DESC) AS k FROM
  (SELECT gene_callers_id, {contig_sql("contig")} AS contig, least(start, stop) AS start, greatest(start, stop) AS stop, CASE WHEN direction IN ('r',
 '-') THEN 'r' ELSE 'f' END AS direction, loaded_at
   FROM gene_calls WHERE gene_callers_id IS NOT NULL AND start <> stop) WHERE contig IS NOT NULL) WHERE k = 1)"""
_GENES = _CALLS + f""",
ann AS (SELECT gene_callers_id, k AS accession, coalesce(max(source), 'unnamed') AS source FROM (SELECT gene_callers_id, {_KEY} AS k, CASE WHEN
 lower(trim(source)) NOT IN {NONE} THEN source END AS source FROM gene_functions WHERE gene_callers_id > 0)
  WHERE k IS NOT NULL AND k NOT IN {NONE} GROUP BY 1, 2),
genes AS (SELECT ann.*, contig, start, stop, direction, gene_callers_id || ':' || accession AS row FROM ann JOIN calls USING (gene_callers_id))"""
_ATTR = """,
attr AS (SELECT contig, length, coalesce(flag, 0) = 1 AS circular FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY loaded_at DESC NULLS
 LAST, length DESC NULLS LAST, flag DESC NULLS LAST) AS k
  FROM (SELECT contig, length, loaded_at, CASE WHEN lower(trim(circular)) IN ('1', 'true') THEN 1 WHEN lower(trim(circular)) IN ('0', 'false') THEN 0
 END AS flag FROM contigs WHERE contig IS NOT NULL)) WHERE k = 1)"""
_ISLAND = """, o AS (SELECT *, max(stop) OVER (PARTITION BY contig ORDER BY start, stop, gene_callers_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1
 PRECEDING) AS reached FROM calls),
i AS (SELECT *, sum(CASE WHEN start < reached THEN 0 ELSE 1 END) OVER (PARTITION BY contig ORDER BY start, stop, gene_callers_id ROWS UNBOUNDED
 PRECEDING) AS k FROM o)"""
_EVENTS = """, ev AS (SELECT contig, pos, sum(x) AS delta FROM (SELECT contig, start AS pos, 1 AS x FROM calls UNION ALL SELECT contig, stop, -1 FROM
 calls) GROUP BY 1, 2),
dp AS (SELECT contig, pos, delta, sum(delta) OVER (PARTITION BY contig ORDER BY pos) AS depth FROM ev)"""
_WPAIRS = _GENES + f""", wp AS (SELECT i.contig, i.accession AS later, j.accession AS earlier, 2 * (i.direction = 'r')::INT + (j.direction = 'r')::INT
 AS orientation FROM genes i JOIN genes j ON i.contig = j.contig
  AND (j.start < i.start OR (j.start = i.start AND j.row < i.row)) AND (j.stop > i.start OR i.start - j.start <= {WINDOW})),
pc AS (SELECT later, earlier, orientation, count(DISTINCT contig) AS n FROM wp GROUP BY 1, 2, 3)"""
_SYM = _WPAIRS + """, sym AS (SELECT a, b, sum(n)::BIGINT AS total, sum(CASE WHEN o = 2 THEN n ELSE 0 END)::BIGINT AS inward, sum(CASE WHEN o = 1 THEN
 n ELSE 0 END)::BIGINT AS outward, sum(CASE WHEN a = b THEN 0 WHEN o = fw THEN n ELSE 0 END)::BIGINT AS forward,
  sum(CASE WHEN a = b THEN 0 WHEN o = 3 - fw THEN n ELSE 0 END)::BIGINT AS reverse FROM (SELECT later AS a, earlier AS b, orientation AS o, n, 3 AS fw
 FROM pc UNION ALL SELECT earlier, later, orientation, n, 0 FROM pc) GROUP BY 1, 2)"""
_FREQ = """, fr AS (SELECT accession, count(*) AS instances, count(DISTINCT contig) AS contigs, count(DISTINCT source) AS groups FROM genes GROUP BY 1)"""
_PIVOT = _GENES + _FREQ + """, pv AS (SELECT contig, start, stop, arg_min(accession, (-contigs, accession)) AS accession_representative,
 string_agg(DISTINCT accession, '|' ORDER BY accession) AS accessions, string_agg(DISTINCT g.source, '|' ORDER BY g.source) AS sources
  FROM genes g JOIN fr USING (accession) GROUP BY 1, 2, 3)"""

# one pair after the other, with the ends taken so far
_SYM_WALK = "WITH RECURSIVE" + _SYM + """, rk AS (SELECT a, b, total, row_number() OVER (ORDER BY total DESC, a, b) AS i FROM sym WHERE a < b AND total >= 3),
walk AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS la, []::VARCHAR[] AS lb, NULL::VARCHAR AS a, NULL::VARCHAR AS b, NULL::BIGINT AS total
 UNION ALL SELECT r.i, CASE WHEN ok THEN list_append(la, r.a) ELSE la END, CASE WHEN ok THEN list_append(lb, r.b) ELSE lb END, CASE WHEN ok THEN r.a
 END, CASE WHEN ok THEN r.b END, CASE WHEN ok THEN r.total END
 FROM (SELECT w.la, w.lb, rk.*, NOT list_contains(w.la, rk.a) AND NOT list_contains(w.lb, rk.b) AS ok FROM walk w JOIN rk ON rk.i = w.i + 1) r)
SELECT a, b, total FROM walk WHERE a IS NOT NULL"""

SQL = {
    "coverage_union": "WITH" + _CALLS + _ISLAND + """ SELECT contig, sum(stop - start)::BIGINT AS cov, (SELECT sum(e - s) FROM (SELECT k, min(start)
 AS s, max(stop) AS e FROM i x WHERE x.contig = i.contig GROUP BY k))::BIGINT AS cov_uniq, count(*) AS n FROM i GROUP BY contig""",
    "depth_profile": "WITH" + _CALLS + _EVENTS + """ SELECT contig, pos AS start, nxt AS stop, depth::BIGINT AS depth FROM (SELECT *, lead(pos) OVER
 (PARTITION BY contig ORDER BY pos) AS nxt FROM dp WHERE delta <> 0) WHERE depth > 0""",
    "slop_intervals": "WITH" + _CALLS + _ATTR + """ SELECT gene_callers_id, contig, greatest(0, start - 250) AS start, least(stop + 250, length) AS
 stop FROM calls JOIN attr USING (contig) WHERE length IS NOT NULL""",
    "merge_intervals": "WITH" + _CALLS + _ISLAND + """ SELECT contig, min(start) AS start, max(stop) AS stop, count(*) AS n, count(*) FILTER
 (direction = 'r') AS n_reverse, min(gene_callers_id) AS first_gene FROM i GROUP BY contig, k""",
    "overlap_join": "WITH" + _CALLS + """ SELECT a.gene_callers_id AS gene_a, b.gene_callers_id AS gene_b, least(a.stop, b.stop) - greatest(a.start,
 b.start) AS bases FROM calls a JOIN calls b ON a.contig = b.contig AND a.start < b.stop AND b.start < a.stop AND a.gene_callers_id <
 b.gene_callers_id""",
    "rotate_coords": "WITH" + _CALLS + _ATTR + """, t AS (SELECT gene_callers_id, contig, length AS n, start + length // 3 AS s, stop + length // 3 AS
 e FROM calls JOIN attr USING (contig) WHERE circular AND length IS NOT NULL AND stop <= length)
 SELECT gene_callers_id, contig, (s % n)::BIGINT AS start, CASE WHEN s // n <> (e - 1) // n THEN n ELSE (e - 1) % n + 1 END::BIGINT AS stop, 0 AS part
 FROM t UNION ALL SELECT gene_callers_id, contig, 0, (e - 1) % n + 1, 1 FROM t WHERE s // n <> (e - 1) // n""",
    "dense_rank_runs": "WITH" + _CALLS + """, x AS (SELECT *, CASE WHEN direction <> lag(direction) OVER w THEN 1 ELSE 0 END AS c FROM calls WINDOW w
 AS (PARTITION BY contig ORDER BY start, gene_callers_id)) SELECT gene_callers_id, sum(c) OVER (PARTITION BY contig ORDER BY start, gene_callers_id
 ROWS UNBOUNDED PRECEDING)::INT AS run FROM x""",
    "tiers": "WITH" + _CALLS + _EVENTS + " SELECT contig, max(depth)::BIGINT AS tiers FROM dp GROUP BY 1",
    "gene_tiers": "WITH" + _CALLS + """, d AS (SELECT DISTINCT contig, start, stop FROM calls),
 o AS (SELECT contig, start, stop, (SELECT count(*) FROM d e WHERE e.contig = d.contig AND e.stop > d.start AND (e.start < d.start OR (e.start = d.start AND e.stop < d.stop))) AS n FROM d),
 t AS (SELECT contig, start, stop, max(n) OVER (PARTITION BY contig ORDER BY start, stop) AS tier FROM o)
 SELECT gene_callers_id, tier::INT AS tier FROM calls JOIN t USING (contig, start, stop)""",
    "locus_genes": "WITH" + _GENES + _ATTR + """, calls2 AS (SELECT DISTINCT contig, greatest(0, start - 2000) AS start, least(stop + 2000, length) AS
 stop FROM genes JOIN attr USING (contig) WHERE accession = 'pd99000000' AND length IS NOT NULL),
 o AS (SELECT *, max(stop) OVER (PARTITION BY contig ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM calls2),
 i AS (SELECT *, sum(CASE WHEN start < reached THEN 0 ELSE 1 END) OVER (PARTITION BY contig ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS k FROM
 o), m AS (SELECT contig, min(start) AS start, max(stop) AS stop FROM i GROUP BY contig, k),
 w AS (SELECT contig, start AS ws, stop AS we, CASE WHEN count(*) OVER (PARTITION BY contig) > 1 THEN contig || '_locus_' || (row_number() OVER (PARTITION BY contig ORDER BY start) - 1) ELSE contig END AS locus FROM m)
 SELECT row, locus FROM genes JOIN w USING (contig) WHERE start >= ws AND stop <= we""",
    "locus_split": "WITH" + _GENES + _ATTR + """, calls2 AS (SELECT DISTINCT contig, greatest(0, start - 500) AS start, least(stop + 500, length) AS
 stop FROM genes JOIN attr USING (contig) WHERE accession = 'pd99000000' AND length IS NOT NULL),
 o AS (SELECT *, max(stop) OVER (PARTITION BY contig ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM calls2),
 i AS (SELECT *, sum(CASE WHEN start < reached THEN 0 ELSE 1 END) OVER (PARTITION BY contig ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS k FROM
 o), m AS (SELECT contig, min(start) AS start, max(stop) AS stop FROM i GROUP BY contig, k)
 SELECT contig, start, stop, CASE WHEN count(*) OVER (PARTITION BY contig) > 1 THEN contig || '_locus_' || (row_number() OVER (PARTITION BY contig
 ORDER BY start) - 1) ELSE contig END AS locus FROM m""",
    "centre_gaps": "WITH" + _GENES + """, x AS (SELECT contig, min(start) AS xmin, max(stop) AS xmax FROM genes GROUP BY 1), f AS (SELECT contig,
 start AS s, stop AS e, direction AS dir FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY start, stop, direction) AS k FROM genes WHERE
 accession = 'pd99000000') WHERE k = 1),
 y AS (SELECT contig, xmin, xmax, CASE WHEN dir = 'r' THEN xmax - e ELSE s - xmin END AS l, CASE WHEN dir = 'r' THEN s - xmin ELSE xmax - e END AS r
 FROM x JOIN f USING (contig))
 SELECT contig, l AS left_gap, r AS right_gap, xmin - ((SELECT max(l) FROM y) - l) AS view_start, xmax + (SELECT max(r) FROM y) - r AS view_stop FROM y""",
    "cooc_coord": "WITH" + _WPAIRS + " SELECT later, earlier, orientation, n FROM pc",
    "cooc_instances": "WITH" + _WPAIRS + " SELECT later, earlier, count(*) AS n FROM wp GROUP BY 1, 2",
    "cooc_gene_rank": "WITH" + _GENES + """, rk AS (SELECT *, dense_rank() OVER (PARTITION BY contig ORDER BY start) AS k FROM genes)
 SELECT i.accession AS later, j.accession AS earlier, 2 * (i.direction = 'r')::INT + (j.direction = 'r')::INT AS orientation, count(DISTINCT i.contig)
 AS n FROM rk i JOIN rk j ON i.contig = j.contig AND j.k < i.k AND i.k - j.k <= 2 GROUP BY 1, 2, 3""",
    "cooc_symmetric": "WITH" + _SYM + " SELECT * FROM sym",
    "cooc_norms": "WITH" + _SYM + _FREQ + """, mg AS (SELECT a, sum(total) AS m FROM sym GROUP BY 1), x AS (SELECT s.a, s.b, s.total, s.total::DOUBLE
 AS c, p.m::DOUBLE AS ma, q.m::DOUBLE AS mb, f.contigs::DOUBLE AS ca, g.contigs::DOUBLE AS cb, f.instances::DOUBLE AS ia, g.instances::DOUBLE AS ib
 FROM sym s JOIN mg p ON p.a = s.a JOIN mg q ON q.a = s.b JOIN fr f ON f.accession = s.a JOIN fr g ON g.accession = s.b)
 SELECT a, b, total, round(c / (ma * mb), 6) AS hyperz_marg, round(c / (ma + mb - c), 6) AS jacc_marg, round(c / ma, 6) AS cond_marg, round(c / (ca *
 cb), 6) AS hyperz_groups, round(c / (ca + cb - c), 6) AS jacc_groups, round(c / ca, 6) AS cond_groups, round(c / ca, 6) AS cond_contigs,
 round(ln(c * (SELECT sum(total) FROM sym) / (ia * ib)), 6) AS pmi_instances FROM x""",
    "cooc_window0": "WITH" + _GENES + """ SELECT i.accession AS later, j.accession AS earlier, 2 * (i.direction = 'r')::INT + (j.direction = 'r')::INT
 AS orientation, count(DISTINCT i.contig) AS n
 FROM genes i JOIN genes j ON i.contig = j.contig AND i.start = j.start AND j.row < i.row GROUP BY 1, 2, 3""",
    "topk_masked": "WITH" + _SYM + """, t AS (SELECT a, b, total FROM sym WHERE a <= b AND a LIKE 'pd%' AND a <> 'pd99000000' AND b <> 'pd99000000')
 SELECT * FROM (SELECT a, b, total, false AS is_tail FROM t ORDER BY total DESC, a, b LIMIT 25) UNION ALL SELECT * FROM (SELECT a, b, total, true FROM
 t ORDER BY total, a, b LIMIT 25)""",
    "greedy_matching": _SYM_WALK,
    "grouped_freq": "WITH" + _GENES + """, x AS (SELECT *, substr(contig, 1, 7) AS site FROM genes),
 t AS (SELECT count(*) AS i, count(DISTINCT contig) AS c, count(DISTINCT source) AS s, count(DISTINCT site) AS e, count(DISTINCT direction) AS d FROM x),
 y AS (SELECT accession, count(*) AS instances, count(DISTINCT contig) AS contigs, count(DISTINCT source) AS source, count(DISTINCT site) AS site,
 count(DISTINCT direction) AS direction FROM x GROUP BY 1)
 SELECT y.*, round(instances / t.i, 8) AS instances_ratio, round(contigs / t.c, 8) AS contigs_ratio, round(source / t.s, 8) AS source_ratio,
 round(site / t.e, 8) AS site_ratio, round(direction / t.d, 8) AS direction_ratio FROM y, t""",
    "symbol_sources": "WITH" + _PIVOT + " SELECT DISTINCT accession_representative, g.source, g.accession FROM genes g JOIN pv USING (contig, start, stop)",
    "accession_contigs": "WITH" + _GENES + " SELECT accession, contig, count(*) AS instances FROM genes GROUP BY 1, 2",
    "described_accessions": "WITH" + _GENES + _FREQ + f""", de AS (SELECT k, arg_min(description, (-n, description)) AS description FROM (SELECT
 {_KEY} AS k, description, count(*) AS n FROM gene_functions
  WHERE description IS NOT NULL AND lower(trim(description)) NOT IN {NONE} GROUP BY 1, 2) GROUP BY 1)
 SELECT fr.accession, contigs, description FROM fr LEFT JOIN de ON de.k = fr.accession""",
    "anchor_directions": "WITH" + _GENES + _FREQ + """, tp AS (SELECT accession, row_number() OVER (ORDER BY contigs DESC, accession) AS p FROM fr QUALIFY p <= 20)
 SELECT contig, accession, direction FROM genes JOIN tp USING (accession) QUALIFY row_number() OVER (PARTITION BY contig ORDER BY p, start, stop, direction) = 1""",
    "exact_overlap": "WITH" + _GENES + """ SELECT x.accession AS a, y.accession AS b, count(DISTINCT x.contig) AS n FROM genes x JOIN genes y ON
 x.contig = y.contig AND x.start = y.start AND x.stop = y.stop AND x.accession < y.accession GROUP BY 1, 2""",
    "topk_pairs": "WITH" + _SYM + " SELECT a, b, total FROM sym WHERE a < b ORDER BY total DESC, a, b LIMIT 50",
    "bottomk_pairs": "WITH" + _SYM + " SELECT a, b, total FROM sym WHERE a < b ORDER BY total, a, b LIMIT 50",
    "accession_freq": "WITH" + _GENES + _FREQ + """, t AS (SELECT count(*) AS i, count(DISTINCT contig) AS c, count(DISTINCT source) AS g FROM genes)
 SELECT accession, instances, contigs, groups, round(instances / t.i, 8) AS instances_ratio, round(contigs / t.c, 8) AS contigs_ratio, round(groups /
 t.g, 8) AS groups_ratio FROM fr, t""",
    "label_odds": "WITH" + _GENES + _ATTR + """, x AS (SELECT accession, contig, circular FROM genes JOIN attr USING (contig)), t AS (SELECT
 count(DISTINCT contig) FILTER (circular) AS a, count(DISTINCT contig) FILTER (NOT circular) AS b FROM x),
 y AS (SELECT accession, count(DISTINCT contig) FILTER (circular) AS contigs_first, count(DISTINCT contig) FILTER (NOT circular) AS contigs_second FROM x GROUP BY 1)
 SELECT accession, contigs_first, contigs_second, round(contigs_first / t.a, 6) AS ratio_first, round(contigs_second / t.b, 6) AS ratio_second,
 round(CASE WHEN contigs_second > 0 THEN (contigs_first / t.a) / (contigs_second / t.b) END, 6) AS odds FROM y, t""",
    "gene_call_merge": "WITH" + _GENES + " SELECT gene_callers_id, accession, source, contig, start, stop, direction FROM genes",
    "gene_call_merge_outer": "WITH" + _GENES + """ SELECT gene_callers_id, coalesce(accession, contig || '_' || start || '_' || stop || '_' ||
 direction) AS accession, coalesce(source, 'dummy_annotation') AS source, contig, start, stop, direction FROM calls LEFT JOIN ann USING
 (gene_callers_id)""",
    "gene_pivot": "WITH" + _PIVOT + " SELECT * FROM pv",
    "symbol_merge": "WITH" + _PIVOT + """, u AS (SELECT accession_representative, contig, unnest(string_split(accessions, '|')) AS a FROM pv) SELECT
 p.accession_representative, p.instances, p.ncontigs, q.accessions FROM (SELECT accession_representative, count(*) AS instances, count(DISTINCT
 contig) AS ncontigs FROM pv GROUP BY 1) p JOIN (SELECT accession_representative, string_agg(DISTINCT a, '|' ORDER BY a) AS accessions FROM u GROUP BY
 1) q USING (accession_representative)""",
    "cargo_split": _TABLES + "," + _GENES + """, mem AS (SELECT m.node AS contig, r.b AS backbone FROM m JOIN reached r ON r.cluster = m.cluster),
 onb AS (SELECT DISTINCT m.cluster AS backbone, accession FROM genes JOIN m ON m.node = genes.contig),
 rw AS (SELECT DISTINCT mem.backbone, genes.contig, start, stop, genes.accession, source, onb.backbone IS NOT NULL AS hit FROM genes JOIN mem USING
 (contig) LEFT JOIN onb ON onb.backbone = mem.backbone AND onb.accession = genes.accession),
 sp AS (SELECT DISTINCT backbone, contig, start, stop, true AS spoiled FROM rw WHERE hit)
 SELECT backbone, contig, start, stop, accession, source, spoiled IS NULL AS is_strict FROM rw LEFT JOIN sp USING (backbone, contig, start, stop) WHERE NOT hit""",
    "cargo_strict": _TABLES + "," + _GENES + """, mem AS (SELECT m.node AS contig, r.b AS backbone FROM m JOIN reached r ON r.cluster = m.cluster),
 onb AS (SELECT DISTINCT m.cluster AS backbone, accession FROM genes JOIN m ON m.node = genes.contig),
 rw AS (SELECT DISTINCT mem.backbone, genes.contig, start, stop, genes.accession, source, onb.backbone IS NOT NULL AS hit FROM genes JOIN mem USING
 (contig) LEFT JOIN onb ON onb.backbone = mem.backbone AND onb.accession = genes.accession)
 SELECT backbone, contig, start, stop, accession, source, substr(contig, 1, 3) AS sample FROM rw WHERE NOT hit AND NOT EXISTS (SELECT 1 FROM rw x
 WHERE x.hit AND x.source = 'ProFam_v9' AND x.backbone = rw.backbone AND x.contig = rw.contig AND x.start = rw.start AND x.stop = rw.stop)""",
    # the best accession of what is left, then without its contigs, until nothing is left
    "anchor_cover": _TABLES + "," + _GENES + """, g0 AS (SELECT genes.contig, start, accession FROM genes WHERE contig IN (SELECT m.node FROM m JOIN
 reached r ON r.cluster = m.cluster)),
 cover AS (SELECT -1 AS position, contig, start, accession, NULL::VARCHAR AS picked FROM g0
  UNION ALL (WITH per AS (SELECT accession, count(DISTINCT contig) AS nc, count(*) AS ni, min(contig) AS c, min(start) AS s FROM cover WHERE contig IS
 NOT NULL GROUP BY 1),
   best AS (SELECT accession AS x FROM per ORDER BY CASE WHEN nc > 1 THEN -nc ELSE 1 END, CASE WHEN nc > 1 THEN -ni ELSE 1 END, CASE WHEN nc > 1 THEN
 '' ELSE c END, s, accession LIMIT 1),
   gone AS (SELECT DISTINCT contig AS y FROM cover JOIN best ON accession = x)
   SELECT position + 1, contig, start, accession, NULL FROM cover WHERE contig IS NOT NULL AND contig NOT IN (SELECT y FROM gone)
   UNION ALL SELECT (SELECT max(position) + 1 FROM cover), NULL, NULL, NULL, x FROM best))
 SELECT position::INT AS position, picked AS accession FROM cover WHERE picked IS NOT NULL""",
    "pair_summary": """WITH b AS (SELECT l_suppkey AS ref, l_partkey AS query, l_linenumber * 10 - 1 AS s, l_linenumber * 10 + l_quantity::INT AS e,
 (l_discount * 100)::INT AS mm, trunc(l_discount * 100)::INT AS mt FROM lineitem),
 o AS (SELECT *, max(e) OVER (PARTITION BY ref, query ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM b), g AS (SELECT ref,
 query, sum(e - s) AS cov, sum(greatest(0, e - greatest(s, coalesce(p, s)))) AS u, sum(mt)::BIGINT AS mm, count(*) AS n FROM o GROUP BY 1, 2)
 SELECT ref, query, mm AS mismatches, n AS nblocks, round(cov / 1000, 10) AS query_cov, round(u / 1000, 10) AS query_cov_uniq, round((cov - mm) / cov,
 10) AS ani, round((cov - mm) / cov * (u / 1000), 10) AS full_ani FROM g""",
}
