"""Contig and accession names in their many spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqsys.functions.values import STAND_INS, plain_width

# One pass over a dirty name: leading '>', folders, the name, a sequence-file ending, notes after a blank.
_CONTIG = r"^[\s>]*(?:\S*/)?([^\s/]*?)(?:\.(?:fa|fna|ffn|fasta|fas)(?:\.gz)?)?(?:\s.*)?$"
_CLEAN_CONTIG = r"^[A-Z0-9]+_[A-Z0-9_]+\z"
_CLEAN_ACCESSION = r"^[A-Za-z0-9_]*[0-9]\z"
_CLEAN_RELEASE = r"^[A-Za-z0-9_]*[0-9]\.[0-9]+\z"


def contig_name(c: Column) -> Column:
    """The plain spelling of a contig name; null where there is no name.

    Plain names are upper case. Undone are: case, ``>``, folders, file endings,
    notes after a blank (``len=..``), blanks of any kind, full-width and
    invisible characters. Null, blank and stand-in texts give null.
    """
    tidy = F.trim(plain_width(c))
    dirty = F.upper(F.regexp_extract(tidy, _CONTIG, 1))
    # stand-ins are told before folders are cut off, as N/A has a slash
    named = F.when(~F.lower(tidy).isin(STAND_INS) & (dirty != ""), dirty)
    return F.when(c.rlike(_CLEAN_CONTIG), c).otherwise(named)


def accession_raw(c: Column) -> Column:
    """An accession without blanks, odd characters and release number, in the case it was written in; null where there is none."""
    tidy = F.regexp_replace(F.regexp_replace(plain_width(c), " +", ""), r"\.[0-9]+$", "")
    named = F.when(~F.lower(tidy).isin(STAND_INS), tidy)
    return F.when(c.rlike(_CLEAN_ACCESSION), c).when(c.rlike(_CLEAN_RELEASE), F.substring_index(c, ".", 1)).otherwise(named)


def accession_key(c: Column) -> Column:
    """One key for all spellings of an accession; null where there is none."""
    return F.lower(accession_raw(c))


def accession_styles(counted: DataFrame, raw: str, n: str) -> DataFrame:
    """How most rows write each accession prefix: ``prefix``, ``style``.

    ``counted`` holds distinct spellings from `accession_raw` with row counts. A
    source writes one prefix, so the majority per prefix is that of its source.
    """
    written = F.regexp_replace(F.col(raw), "[0-9]+$", "")
    per = counted.groupBy(F.lower(written).alias("prefix"), written.alias("style")).agg(F.sum(n).alias("n"))
    # most rows first, then the smaller spelling in byte order
    return per.groupBy("prefix").agg(F.min_by("style", F.struct(-F.col("n"), F.col("style"))).alias("style"))


#: Broadcast bound of the style table: prefixes name annotation sources, of which there are few.
MAX_BROADCAST_STYLES = 100_000


def with_accession_style(df: DataFrame, key: str, styles: DataFrame, out: str, max_broadcast: int = MAX_BROADCAST_STYLES) -> DataFrame:
    """Add ``out``, the accession ``key`` as most rows of its source write it.

    ``styles`` must be a written table. It is broadcast if it has at most
    ``max_broadcast`` rows, else joined by shuffle.
    """
    small = styles.limit(max_broadcast + 1).count() <= max_broadcast
    styles = styles.select(F.col("prefix").alias("_prefix"), F.col("style").alias("_style"))
    digits = F.regexp_extract(F.col(key), "[0-9]*$", 0)
    keyed = df.withColumn("_key_prefix", F.regexp_replace(F.col(key), "[0-9]+$", ""))
    joined = keyed.join(F.broadcast(styles) if small else styles, keyed["_key_prefix"] == styles["_prefix"], "left")
    return joined.withColumn(out, F.concat(F.coalesce("_style", "_key_prefix"), digits)).drop("_prefix", "_style", "_key_prefix")
