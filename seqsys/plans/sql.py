"""Pieces of SQL that the queries' DuckDB texts share: names, accessions, fractions."""

from __future__ import annotations

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")

#: Texts that stand for no value, in lower case.
NONE = "('', '-', '.', '?', 'na', 'n/a', 'none', 'null', 'unknown')"


def contig_sql(c: str) -> str:
    """The plain spelling of a contig name."""
    return f"nullif(upper(regexp_extract({c}, '([A-Za-z]{{3}}[0-9]{{4}}(_[0-9]{{2}})?_[0-9]{{12}})', 1)), '')"


def accession_sql(c: str) -> str:
    """An accession without blanks, odd characters and release number, in the case it was written in."""
    return rf"regexp_replace(regexp_replace(translate({c}, '{_WIDE}', '{_ASCII}'), '[\s\p{{Z}}\p{{Cf}}]', '', 'g'), '\.[0-9]+$', '')"


def fraction_sql(x: str, *whole_row: str) -> str:
    """A value above 1, or one in a row with such a value, as a fraction; NaN as null."""
    percent = " OR ".join([f"{x} > 1"] + [f"({o} > 1 AND NOT isnan({o}))" for o in whole_row])
    return f"CASE WHEN isnan({x}) THEN NULL WHEN {percent} THEN {x} / 100 ELSE {x} END"


#: Table ``m``: the distinct accessions ``k`` of every contig.
MEMBERS = f"""m AS (SELECT DISTINCT contig, k FROM (SELECT {contig_sql("contig")} AS contig, lower({accession_sql("accession")}) AS k FROM gene_functions)
  WHERE contig IS NOT NULL AND k IS NOT NULL AND k NOT IN {NONE})"""
