"""Writers: TSV, FASTA, GraphML. All write folders of part files, from many tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flat(df: DataFrame) -> DataFrame:
    """Arrays as strings joined by ``|``, booleans as 0/1."""

    def show(c: str, kind: str) -> Column:
        if kind.startswith("array"):
            return F.array_join(F.col(c).cast("array<string>"), "|")
        return F.col(c).cast("int") if kind == "boolean" else F.col(c)

    return df.select(*[show(c, kind).alias(c) for c, kind in df.dtypes])


def write_tsv(df: DataFrame, path: str) -> None:
    """A TSV folder whose parts have headers."""
    flat(df).write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """The pair table in its file dialect (fractions)."""
    write_tsv(pairs.select("reference", "query", F.col("coverage").alias("C"), (F.col("ANI") / 100).alias("I_local"), F.col("full_ANI").alias("I_global")), path)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """The alignment blocks, for `readers.read_blocks`."""
    write_tsv(blocks.select("ref", "query", "ref_len", "query_len", "ref_start", "ref_end", "query_start", "query_end", "errors", "mismatches", "nonalpha"), path)


def write_fasta(df: DataFrame, path: str) -> None:
    """Rows ``contig, seq`` as FASTA."""
    df.select(F.concat(F.lit(">"), "contig", F.lit("\n"), "seq")).write.mode("overwrite").text(path)


def write_dereplicated(derep: DataFrame, sequences: DataFrame, path: str) -> None:
    """Rows ``representative, contig`` as ``path_components`` and the representatives' sequences as ``path_representatives``."""
    write_tsv(derep.select("representative", "contig"), f"{path}_components")
    kept = sequences.join(derep.select(F.col("representative").alias("contig")).distinct(), "contig", "left_semi")
    write_fasta(kept, f"{path}_representatives")


def _escaped(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, node: str = "node") -> None:
    """Directed GraphML with all columns as attributes, as a folder whose parts in the order of their names are the file.

    ``nodes`` hold ``node``, ``edges`` hold ``src, dst``. Head, nodes, edges and foot are one union, whose partitions keep
    their order, so every part is written where its rows are.
    """
    spark = nodes.sparkSession
    nodes, edges = flat(nodes), flat(edges)
    kinds = {"double": "double", "float": "double", "int": "long", "bigint": "long", "boolean": "boolean"}
    sides = (("node", nodes, [node]), ("edge", edges, ["src", "dst"]))
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f' <key id="{side}_{c}" for="{side}" attr.name="{c}" attr.type="{kinds.get(t, "string")}"/>' for side, df, own in sides for c,
        t in df.dtypes if c not in own]
    head.append(' <graph id="G" edgedefault="directed">')

    def line(side: str, df: DataFrame, own: list[str], names: list[str]) -> DataFrame:
        text = lambda c: _escaped(F.col(c).cast("string"))
        begin = [x for c, name in zip(own, names) for x in (F.lit(f' {name}="'), text(c), F.lit('"'))]
        data = [F.coalesce(F.concat(F.lit(f'<data key="{side}_{c}">'), text(c), F.lit("</data>")), F.lit("")) for c in df.columns if c not in own]
        return df.select(F.concat(F.lit(f"  <{side}"), *begin, F.lit(">"), *data, F.lit(f"</{side}>")).alias("value"))

    fixed = lambda lines: spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1)
    parts = [fixed(head), line("node", nodes, [node], ["id"]), line("edge", edges, ["src", "dst"], ["source", "target"]), fixed([" </graph>", "</graphml>"])]
    reduce(DataFrame.unionAll, parts).write.mode("overwrite").text(path)
