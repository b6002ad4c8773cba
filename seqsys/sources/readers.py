"""Readers of sequence, alignment, pair and annotation files. No schema is inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS = "reference string, query string, C double, I_local double, I_global double"
FRAGMENTS = "query string, reference string, ANI double, fragments_matched int, total_query_fragments int"
SKETCH = "s1 string, s2 string, dist float, p_value float, kmers string"
BLOCKS = "ref string, query string, ref_len int, query_len int, ref_start int, ref_end int, query_start int, query_end int, errors int, mismatches int, nonalpha int"
ANNOTATIONS = "contig string, start int, stop int, direction string, accession string, source string, description string"
ANNOTATIONS_BY_CALL = "gene_callers_id long, accession string, source string, function string"
CALLS = "gene_callers_id long, contig string, start int, stop int, direction string"


def _tsv(spark: SparkSession, path, schema: str, header: bool = True, comment: str | None = None) -> DataFrame:
    r = spark.read.schema(schema).option("sep", "\t").option("header", header).option("enforceSchema", False)
    return (r.option("comment", comment) if comment else r).csv(path)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The frame itself, or an error that names its missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def checked_fraction(c: str) -> Column:
    """A column that must be in 0..1; null stays null, anything else is an error."""
    outside = F.raise_error(F.concat(F.lit(f"{c} is not within 0..1: "), F.col(c).cast("string"))).cast("double")
    return F.when(F.col(c).isNull() | F.col(c).between(0, 1), F.col(c)).otherwise(outside).alias(c)


def _by_name(spark: SparkSession, path, schema: str, aliases: dict[str, str] | None = None, comment: str | None = None, needed: list[str] | None = None) -> DataFrame:
    """A TSV whose columns are found by name, renamed, cast to ``schema``; missing ones are null, if they are not ``needed``."""
    r = spark.read.option("sep", "\t").option("header", True)
    paths = [path] if isinstance(path, str) else list(path)
    frames = [require((r.option("comment", comment) if comment else r).csv(p).withColumnsRenamed(aliases or {}), needed or []) for p in paths]
    want = [c.strip().rsplit(" ", 1) for c in schema.split(",")]
    cast = lambda f: f.select(*[(F.col(n) if n in f.columns else F.lit(None)).cast(t).alias(n) for n, t in want])
    return reduce(DataFrame.unionAll, map(cast, frames))


def _records(spark: SparkSession, path) -> DataFrame:
    """The records of a file in which each begins with ``>`` at the start of a line, without that sign; one row ``value`` each.

    A ``>`` elsewhere does not end a record, so no line order is needed across rows and files split anywhere.
    """
    return spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("value"))


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """``contig, seq, length``; bodies may span lines, blank lines are skipped, the name ends at the first blank."""
    records = _records(spark, path).filter(F.trim("value") != "")
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.expr("substring(value, length(head) + 1)"), r"\s+", "")
    out = records.withColumn("head", head).select(F.regexp_extract(F.trim("head"), r"^(\S+)", 1).alias("contig"), seq.alias("seq"))
    return out.withColumn("length", F.length("seq"))


def flag(c: Column) -> Column:
    """0/1/True/False as boolean, null stays null, anything else is an error."""
    t = F.lower(F.trim(c))
    return F.when(t.isin("1", "true"), True).when(t.isin("0", "false"), False).when(c.isNull(), F.lit(None).cast("boolean")).otherwise(
        F.raise_error(F.concat(F.lit("not a flag: "), c)).cast("boolean")
    )


def read_complete(spark: SparkSession, path) -> DataFrame:
    """``contig, circular`` of a header-less table."""
    return _tsv(spark, path, "contig string, flag string", header=False).select("contig", flag(F.col("flag")).alias("circular"))


def read_pairs(spark: SparkSession, path) -> DataFrame:
    """``reference, query, coverage, ANI, full_ANI`` of a pair table, either header, ``#`` comments skipped. Numbers outside 0..1 are an error. ANI in percent."""
    raw = _by_name(spark, path, PAIRS, {"Reference_Sequence": "reference", "Query_Sequence": "query"}, comment="#",
        needed=["reference", "query", "C", "I_local", "I_global"])
    raw = raw.select("reference", "query", *[checked_fraction(c) for c in ("C", "I_local", "I_global")])
    return raw.select("reference", "query", F.col("C").alias("coverage"), (F.col("I_local") * 100).alias("ANI"), F.col("I_global").alias("full_ANI"))


def read_fragments(spark: SparkSession, path, names: DataFrame | None = None) -> DataFrame:
    """Fragment-ANI table with file paths turned into names (folder and ``.fa`` off), or mapped by ``names`` (file, name)."""
    df = _tsv(spark, path, FRAGMENTS, header=False)
    if names is not None:
        for c in ("query", "reference"):
            df = df.join(names.select(F.col("file").alias(c), F.col("name").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
        return df
    name = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"\.fa$", "")
    return df.withColumns({c: name(F.col(c)) for c in ("query", "reference")})


def read_sketch_distances(spark: SparkSession, path) -> DataFrame:
    """Sketch distances with ``sim = 1 - dist``; names lose folder and ``.fa``, dots become underscores."""
    name = lambda c: F.replace(F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"\.fa$", ""), F.lit("."), F.lit("_"))
    return _tsv(spark, path, SKETCH, header=False).withColumns({"s1": name(F.col("s1")), "s2": name(F.col("s2")), "sim": 1 - F.col("dist")})


def read_delta(spark: SparkSession, path) -> DataFrame:
    """Alignment blocks of a delta file. Each record is one row."""
    rec = _records(spark, path).select(F.split("value", r"\r?\n").alias("lines"))
    head = rec.select(F.split(F.trim(F.col("lines")[0]), r"\s+").alias("h"), F.slice("lines", 2, 1_000_000_000).alias("lines")).filter(F.size("h") == 4)
    block = head.select("h", F.explode("lines").alias("line")).select("h", F.split(F.trim("line"), r"\s+").alias("b")).filter(F.size("b") == 7)
    h, b = (lambda k: F.col("h")[k]), (lambda k: F.col("b")[k].cast("int"))
    names = ["ref_start", "ref_end", "query_start", "query_end", "errors", "mismatches", "nonalpha"]
    return block.select(h(0).alias("ref"), h(1).alias("query"), h(2).cast("int").alias("ref_len"), h(3).cast("int").alias("query_len"),
        *[b(k).alias(n) for k, n in enumerate(names)])


def read_blocks(spark: SparkSession, path) -> DataFrame:
    """A saved block table, as `sinks.write_blocks` makes it."""
    return _by_name(spark, path, BLOCKS, needed=["ref", "query", "query_len", "query_start", "query_end"])


def read_annotations(spark: SparkSession, paths, by_call: bool = False) -> DataFrame:
    """Annotation tables with coordinates, or by gene call; several paths are one table, a ``function`` column is the description."""
    if by_call:
        return _by_name(spark, paths, ANNOTATIONS_BY_CALL, {"description": "function"}, needed=["gene_callers_id", "accession", "source"])
    return _by_name(spark, paths, ANNOTATIONS, {"function": "description"}, needed=["contig", "start", "stop", "direction", "accession", "source"])


def read_calls(spark: SparkSession, path) -> DataFrame:
    return _by_name(spark, path, CALLS, needed=["gene_callers_id", "contig", "start", "stop", "direction"])


def read_metadata(spark: SparkSession, path) -> DataFrame:
    """A table of anything known about contigs, all columns as text, by ``contig``."""
    return require(spark.read.option("sep", "\t").option("header", True).csv(path), ["contig"])
