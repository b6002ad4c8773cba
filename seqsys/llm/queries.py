"""Queries of the training-data operators over the driver's tables, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqsys.functions.names import accession_key, accession_raw, accession_styles, contig_name, with_accession_style
from seqsys.functions.values import fraction, present_text
from seqsys.llm.components import components
from seqsys.llm.leaks import leaks
from seqsys.llm.memberships import memberships
from seqsys.llm.setpairs import similar_pairs
from seqsys.llm.subjects import subjects
from seqsys.llm.survivors import survivors
from seqsys.llm.terms import gram_statistics, sequence_suffixes, term_suffixes
from seqsys.llm.together import together
from seqsys.llm.tokens import encode_corpus
from seqsys.plans.sql import NONE, accession_sql, contig_sql, fraction_sql
from seqsys.session import Scratch


def _read(spark: SparkSession, d: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet").select(*columns)


def _styles(annotations: DataFrame) -> DataFrame:
    """The written style table of the accession prefixes."""
    counted = annotations.select(accession_raw(F.col("accession")).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    return Scratch(annotations.sparkSession, "styles").write(accession_styles(counted.filter(F.col("raw").isNotNull()), "raw", "n"))


def _members(annotations: DataFrame) -> DataFrame:
    return memberships(annotations, contig_name(F.col("contig")), accession_key(F.col("accession")))


def ani_matches(ani: DataFrame, min_c: float = 0.9, min_global: float = 0.85) -> DataFrame:
    """Rows ``a, b`` of a pair table that match two different contigs.

    A value above 1 is a percentage; so is each value of a row with c or i_local above 1,
    which carries percentages throughout. NaN is a missing number.
    """
    kept = ani.filter((fraction("c", "i_local") >= min_c) & (fraction("i_global", "c", "i_local") >= min_global))
    named = kept.select(contig_name(F.col("reference")).alias("a"), contig_name(F.col("query")).alias("b"))
    return named.filter(F.col("a") != F.col("b"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    matches = ani_matches(_read(spark, d, "ani", "reference", "query", "c", "i_local", "i_global"))
    return components(matches, "a", "b").select(F.col("node").alias("contig"), F.col("component").alias("group_contig"))


def _term_table(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    f = _read(spark, d, "gene_functions", "accession", "contig")
    named = f.select(accession_key(F.col("accession")).alias("term"), contig_name(F.col("contig")).alias("contig"))
    n = named.filter(F.col("term").isNotNull() & F.col("contig").isNotNull()).select("contig").distinct().count()
    return gram_statistics(term_suffixes(named, F.col("contig"), F.col("term"))), _styles(f), n


def _mark(n: int):
    """Too rare: on at most 2 records; too common: on more than 5 % of them."""
    return F.when(F.col("records") <= 2, "rare").when(F.col("records") * 20 > n, "common")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    grams, styles, n = _term_table(spark, d)
    marked = grams.withColumn("mark", _mark(n)).filter(F.col("mark").isNotNull())
    return with_accession_style(marked, "gram", styles, "accession").select("accession", "mark")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    grams, styles, n = _term_table(spark, d)
    out = with_accession_style(grams, "gram", styles, "accession")
    return out.select("accession", F.col("occurrences").alias("n_rows"), F.col("records").alias("n_contigs"), F.coalesce(_mark(n), F.lit("useful")).alias("mark"))


def p2_grams(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one to three accessions along the contigs, in the order of their genes, that are on three contigs or more."""
    f = _read(spark, d, "gene_functions", "contig", "gene_callers_id", "entry_id", "accession")
    gene = F.coalesce("gene_callers_id", F.lit(0)).alias("gene")
    rows = f.select(contig_name(F.col("contig")).alias("contig"), gene, "entry_id", accession_key(F.col("accession")).alias("k")).dropna().distinct()
    grams = gram_statistics(sequence_suffixes(rows, "contig", ["gene", "entry_id", "k"], "k", 3)).filter("records >= 3")
    return grams.select(F.translate("gram", "\u0001", "|").alias("accessions"), F.col("occurrences").alias("n_rows"), F.col("records").alias("n_contigs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    members = _members(_read(spark, d, "gene_functions", "accession", "contig"))
    return similar_pairs(members, threshold=0.8, min_size=5).select(F.col("a").alias("contig_a"), F.col("b").alias("contig_b"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    f = _read(spark, d, "gene_functions", "accession", "contig")
    found = together(_members(f), min_count=12, min_lift=4).select("item_a", "item_b")
    styles = _styles(f)
    out = with_accession_style(with_accession_style(found, "item_a", styles, "x"), "item_b", styles, "y")
    return out.select(F.least("x", "y").alias("accession_a"), F.greatest("x", "y").alias("accession_b"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    c = _read(spark, d, "clusters", "row_id", "accession_representative", "ncontigs", "ncontigs_gain", "instances", "source", "description", "trust", "updated_at")
    has_n = F.coalesce(F.col("ncontigs") >= 1, F.lit(False))
    present = [has_n, F.col("ncontigs_gain").isNotNull(), F.col("instances").isNotNull(), present_text(F.col("source")),
        present_text(F.col("description")), F.col("trust").isNotNull(), F.col("updated_at").isNotNull()]
    filled = sum((p.cast("int") for p in present[1:]), present[0].cast("int"))
    trust, when = F.col("trust"), F.unix_micros(F.col("updated_at").cast("timestamp"))
    zero = F.lit(0)
    rules = {
        "record": (F.lit(True), [filled, when, trust]),
        "description": (present_text(F.col("description")), [trust, when, zero]),
        "ncontigs": (has_n, [when, trust, zero]),
    }
    best = survivors(c, accession_key(F.col("accession_representative")), F.col("row_id"), rules)
    return best.select(F.col("group_row").alias("group_row_id"), "field_name", F.col("row").alias("row_id"))


#: Where the vocabulary of p8 lies; a parameter of `encode_corpus`, not part of this repository.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(_read(spark, d, "documents", "doc_id", "text"), "doc_id", "text", BYTE_BPE)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks(
        _read(spark, d, "documents", "doc_id", "text", "raw_bytes"), _read(spark, d, "benchmark", "item_id", "passage", "question"),
        doc="doc_id", text="text", raw="raw_bytes", item="item_id", passage="passage", question="question",
    )
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    allowed = [r.subject for r in _read(spark, d, "subjects", "subject").filter(F.col("subject").isNotNull()).collect()]
    return subjects(
        _read(spark, d, "documents", "doc_id", "text", "raw_bytes"), _read(spark, d, "labels", "doc_id", "subject"),
        doc="doc_id", text="text", raw="raw_bytes", label_doc="doc_id", label="subject", allowed=allowed,
    )


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select(F.col("doc").alias("doc_id"), "subject").distinct()


def p10_mix(spark: SparkSession, d: str) -> DataFrame:
    """How the corpus is composed: pages per subject and the sum of their shares."""
    return _subjects(spark, d).groupBy("subject").agg(F.count("*").alias("n_pages"), F.round(F.sum("share"), 3).alias("share_sum"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_counts, p2_grams, p4_found, p5_found, p7_found, p8_ids, p9_found, p10_found, p10_mix)}

_NAMED = f"""
WITH f AS (SELECT {accession_sql("accession")} AS raw, {contig_sql("contig")} AS contig FROM gene_functions),
named AS (SELECT lower(raw) AS k, contig FROM f WHERE raw IS NOT NULL AND lower(raw) NOT IN {NONE}),
style AS (SELECT prefix, arg_max(style, n) AS style FROM (SELECT lower(regexp_replace(raw, '[0-9]+$', '')) AS prefix,
          regexp_replace(raw, '[0-9]+$', '') AS style, count(*) AS n FROM f WHERE raw IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
"""
_COUNTS = _NAMED + """
total AS (SELECT count(DISTINCT contig) AS n FROM named),
counts AS (SELECT k, count(*) AS n_rows, count(DISTINCT contig) AS n_contigs FROM named GROUP BY 1),
marked AS (SELECT style.style || regexp_extract(k, '[0-9]*$') AS accession, n_rows, n_contigs,
           CASE WHEN n_contigs <= 2 THEN 'rare' WHEN n_contigs * 20 > total.n THEN 'common' ELSE 'useful' END AS mark
           FROM counts JOIN style ON style.prefix = regexp_replace(k, '[0-9]+$', ''), total)
"""
_MEMBERS = _NAMED + "m AS (SELECT DISTINCT contig, k FROM named WHERE contig IS NOT NULL), sizes AS (SELECT contig, count(*) AS n FROM m GROUP BY 1),"
_PRESENT = "(coalesce(lower(trim({c})), 'none') NOT IN ('', '-', '.', '?', 'na', 'n/a', 'none', 'null', 'unknown'))"

SQL = {
    "p1_found": f"""
WITH RECURSIVE f AS (SELECT {contig_sql("reference")} AS a, {contig_sql("query")} AS b, {fraction_sql("c", "i_local")} AS c,
 {fraction_sql("i_global", "c", "i_local")} AS g FROM ani),
e AS (SELECT DISTINCT least(a, b) AS x, greatest(a, b) AS y FROM f WHERE c >= 0.9 AND g >= 0.85 AND a <> b),
both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (SELECT x, x AS y FROM both_ways UNION SELECT r.x, w.y FROM reach r JOIN both_ways w ON w.x = r.y)
SELECT x AS contig, min(y) AS group_contig FROM reach GROUP BY 1""",
    "p2_found": _COUNTS + "SELECT accession, mark FROM marked WHERE mark <> 'useful'",
    "p2_counts": _COUNTS + "SELECT * FROM marked",
    "p2_grams": f"""
WITH r AS (SELECT DISTINCT {contig_sql("contig")} AS contig, coalesce(gene_callers_id, 0) AS gene, entry_id, lower({accession_sql("accession")}) AS k
 FROM gene_functions),
s AS (SELECT contig, k, lead(k, 1) OVER w AS k2, lead(k, 2) OVER w AS k3 FROM r WHERE contig IS NOT NULL AND k NOT IN {NONE} WINDOW w AS (PARTITION BY
 contig ORDER BY gene, entry_id, k)),
g AS (SELECT contig, k AS accessions FROM s UNION ALL SELECT contig, k || '|' || k2 FROM s WHERE k2 IS NOT NULL UNION ALL SELECT contig, k || '|' ||
 k2 || '|' || k3 FROM s WHERE k3 IS NOT NULL)
SELECT accessions, count(*) AS n_rows, count(DISTINCT contig) AS n_contigs FROM g GROUP BY 1 HAVING count(DISTINCT contig) >= 3""",
    "p4_found": _MEMBERS + """
big AS (SELECT m.contig, k, n FROM m JOIN sizes USING (contig) WHERE n >= 5),
common AS (SELECT a.contig AS x, b.contig AS y, a.n AS nx, b.n AS ny, count(*) AS s FROM big a JOIN big b ON a.k = b.k AND a.contig < b.contig GROUP BY 1, 2, 3, 4)
SELECT x AS contig_a, y AS contig_b FROM common WHERE s * 10 >= 8 * (nx + ny - s)""",
    "p5_found": _MEMBERS + """
c AS (SELECT k, count(*) AS n FROM m GROUP BY 1), big AS (SELECT contig, k, n FROM m JOIN c USING (k) WHERE n >= 12),
t AS (SELECT count(*) AS n FROM sizes),
pair AS (SELECT a.k AS x, b.k AS y, a.n AS nx, b.n AS ny, count(*) AS s FROM big a JOIN big b ON a.contig = b.contig AND a.k < b.k GROUP BY 1, 2, 3, 4
 HAVING count(*) >= 12),
named_pair AS (SELECT p.style || regexp_extract(x, '[0-9]*$') AS x, q.style || regexp_extract(y, '[0-9]*$') AS y
    FROM pair JOIN style p ON p.prefix = regexp_replace(x, '[0-9]+$', '') JOIN style q ON q.prefix = regexp_replace(y, '[0-9]+$', ''), t WHERE s * t.n
 >= 4 * nx * ny)
SELECT least(x, y) AS accession_a, greatest(x, y) AS accession_b FROM named_pair""",
    "p7_found": f"""
WITH c AS (SELECT *, lower({accession_sql("accession_representative")}) AS k, {_PRESENT.format(c="source")} AS has_s,
 {_PRESENT.format(c="description")} AS has_d, coalesce(ncontigs >= 1, false) AS has_n FROM clusters),
r AS (SELECT *, has_n::INT + (ncontigs_gain IS NOT NULL)::INT + (instances IS NOT NULL)::INT + has_s::INT + has_d::INT + (trust IS NOT NULL)::INT +
 (updated_at IS NOT NULL)::INT AS filled
      FROM c WHERE k IS NOT NULL AND k NOT IN {NONE}),
g AS (SELECT k, min(row_id) AS g, count(*) AS n FROM r GROUP BY 1),
x AS (SELECT k, 'record' AS field_name, row_id, row_number() OVER (PARTITION BY k ORDER BY filled DESC, updated_at DESC NULLS LAST, trust DESC NULLS
 LAST, row_id DESC) AS i FROM r
 UNION ALL SELECT k, 'description', row_id, row_number() OVER (PARTITION BY k ORDER BY trust DESC NULLS LAST, updated_at DESC NULLS LAST, row_id DESC)
 FROM r WHERE has_d
 UNION ALL SELECT k, 'ncontigs', row_id, row_number() OVER (PARTITION BY k ORDER BY updated_at DESC NULLS LAST, trust DESC NULLS LAST, row_id DESC)
 FROM r WHERE has_n)
SELECT g.g AS group_row_id, field_name, row_id FROM x JOIN g USING (k) WHERE i = 1 AND n >= 2""",
}
