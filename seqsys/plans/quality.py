"""Queries of the general data-quality problems: p3 (orphans) and p6 (stretches)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqsys.functions.names import contig_name
from seqsys.operators.orphans import orphan_report, orphan_rows
from seqsys.operators.runs import stretches_and_gaps
from seqsys.plans.sql import contig_sql


def _read(spark: SparkSession, d: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet").select(*columns)


def _orphans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = _read(spark, d, "gene_functions", "entry_id", "gene_callers_id", "loaded_at")
    g = _read(spark, d, "gene_calls", "gene_callers_id", "loaded_at", "withdrawn_at")
    o = orphan_rows(
        f, g, row="entry_id", key="gene_callers_id", at="loaded_at", parent_key="gene_callers_id", valid_from="loaded_at", valid_to="withdrawn_at", table="gene_functions"
    )
    return o, f


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    o, _ = _orphans(spark, d)
    return o.select(F.col("row").alias("entry_id"), F.date_format("at", "yyyy-MM").alias("load_month"), "kind").distinct()


def p3_by_month(spark: SparkSession, d: str) -> DataFrame:
    o, f = _orphans(spark, d)
    return orphan_report(o, f, key="gene_callers_id", at="loaded_at", table="gene_functions")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    g = _read(spark, d, "gene_calls", "contig", "start", "stop")
    g = g.filter(F.col("start").isNotNull() & F.col("stop").isNotNull()).select(
        contig_name(F.col("contig")).alias("contig"), F.least("start", "stop").alias("start"), F.greatest("start", "stop").alias("stop")
    )
    return stretches_and_gaps(g, "contig", "start", "stop").select("contig", "kind", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))


_CASES = """
WITH c AS (SELECT DISTINCT entry_id, gene_callers_id AS k, loaded_at AS t FROM gene_functions
           WHERE gene_callers_id > 0 AND loaded_at IS NOT NULL),
first AS (SELECT gene_callers_id AS k, min(loaded_at) AS f FROM gene_calls GROUP BY 1),
cases AS (SELECT c.*, CASE WHEN first.k IS NULL THEN 'missing' WHEN first.f > c.t THEN 'late' ELSE 'withdrawn' END AS kind
          FROM c LEFT JOIN first ON first.k = c.k
          WHERE NOT EXISTS (SELECT 1 FROM gene_calls g WHERE g.gene_callers_id = c.k AND g.loaded_at <= c.t
                            AND (g.withdrawn_at IS NULL OR g.withdrawn_at > c.t)))
"""

QUERIES = {"p3_found": p3_found, "p3_by_month": p3_by_month, "p6_found": p6_found}

SQL = {
    "p3_found": _CASES + "SELECT DISTINCT entry_id, strftime(t, '%Y-%m') AS load_month, kind FROM cases",
    "p3_by_month": _CASES
    + """SELECT 'gene_functions' AS child_table, m.period, kind, m.orphan_rows, m.orphan_keys, t.refs AS "references" FROM (
    SELECT strftime(t, '%Y-%m') AS period, kind, count(*) AS orphan_rows, count(DISTINCT k) AS orphan_keys FROM cases GROUP BY 1, 2) m
    JOIN (SELECT strftime(loaded_at, '%Y-%m') AS period, count(*) AS refs FROM gene_functions WHERE gene_callers_id > 0 AND loaded_at IS NOT NULL GROUP BY 1) t USING (period)""",
    "p6_found": f"""
WITH c AS (SELECT DISTINCT {contig_sql("contig")} AS contig, least(start, stop) AS s, greatest(start, stop) AS e
           FROM gene_calls WHERE start IS NOT NULL AND stop IS NOT NULL AND start <> stop),
o AS (SELECT *, max(e) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM c WHERE contig IS NOT NULL),
i AS (SELECT *, sum(CASE WHEN p > s THEN 0 ELSE 1 END) OVER (PARTITION BY contig ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o),
m AS (SELECT contig, k, min(s) AS s, max(e) AS e FROM i GROUP BY 1, 2),
g AS (SELECT contig, lag(e) OVER (PARTITION BY contig ORDER BY s) AS s, s AS e FROM m)
SELECT contig, 'covered' AS kind, s AS start, e AS stop FROM m
UNION ALL SELECT contig, 'gap', s, e FROM g WHERE e > s""",
}
