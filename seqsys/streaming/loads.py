"""Incremental views of tables that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqsys.operators.runs import stretches_and_gaps


def read_arrivals(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the Parquet files that appear under ``path``."""
    return spark.readStream.schema(schema).parquet(path)


def _state(spark: SparkSession, path: str, epoch: int, name: str, schema: str) -> DataFrame:
    """A table of the state after ``epoch``; before the first one it is empty."""
    return spark.read.schema(schema).parquet(f"{path}/{name}/epoch={epoch}") if epoch >= 0 else spark.createDataFrame([], schema)


def maintain_coverage(stream: DataFrame, key: str, start: str, stop: str, path: str, checkpoint: str):
    """Keep the union coverage per key of all intervals seen so far.

    The state is the covered stretches of every key, not the intervals, so a batch is joined with what earlier ones cover and
    never with their rows. Each batch writes the state under its own number, from the state before, so that a repeated batch overwrites itself.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.select(F.col(key).cast("string").alias("key"), F.col(start).cast("long").alias("start"), F.col(stop).cast("long").alias("stop"))
        covered = _state(spark, path, epoch - 1, "covered", "key string, start long, stop long")
        touched = new.select("key").distinct()
        again = stretches_and_gaps(covered.join(touched, "key", "left_semi").unionByName(new), "key", "start", "stop").filter("kind = 'covered'")
        rest = covered.join(touched, "key", "left_anti")
        rest.unionByName(again.select("key", "start", "stop")).write.mode("overwrite").parquet(f"{path}/covered/epoch={epoch}")
        counts = _state(spark, path, epoch - 1, "counts", "key string, cov long, n long")
        more = new.select("key", (F.col("stop") - F.col("start")).alias("cov"), F.lit(1).cast("long").alias("n"))
        total = counts.unionByName(more).groupBy("key").agg(F.sum("cov").alias("cov"), F.sum("n").alias("n"))
        total.write.mode("overwrite").parquet(f"{path}/counts/epoch={epoch}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_coverage(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    """Rows ``key, cov, cov_uniq, n`` after a batch."""
    counts = spark.read.parquet(f"{path}/counts/epoch={epoch}")
    union = spark.read.parquet(f"{path}/covered/epoch={epoch}").groupBy("key").agg(F.sum(F.col("stop") - F.col("start")).alias("cov_uniq"))
    return counts.join(union, "key", "left").select("key", "cov", F.coalesce("cov_uniq", F.lit(0)).alias("cov_uniq"), "n")
