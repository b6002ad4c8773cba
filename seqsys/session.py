"""Session and scratch-table helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests, the bench and the command line; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("seqsys")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir`` (or by ``setCheckpointDir``). Only in local mode, where that is unset
    (tests, a laptop), a temporary folder is made, once per application; on a cluster that is an error, as
    every machine would write to a disk of its own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is not set: it must name a folder that all machines of {master} share")
        where = tempfile.mkdtemp(prefix="spark-seqsys-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Roots of the scratch tables of every application that are still there.
_roots: dict[str, list[str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables made so far; call it when the results that read them are written."""
    for root in _roots.pop(spark.sparkContext.applicationId, []):
        _delete(spark, root)


class Scratch:
    """Tables that cut lineage, written as Parquet into the shared folder.

    A written table survives the loss of any executor, is columnar and
    compressed, and carries sizes for the planner, which RDD checkpoints do not. It lives until `release`, or
    at most until the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _roots.setdefault(spark.sparkContext.applicationId, []).append(self.root)
        p = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return the table read back; ``.path`` of it is in ``last``."""
        self._n += 1
        self.last = f"{self.root}/{self._n:03d}-{name}"
        df.write.parquet(self.last)
        return self.spark.read.schema(df.schema).parquet(self.last)

    def drop(self, path: str) -> None:
        """Delete a table of this scratch that nothing reads any more."""
        _delete(self.spark, path)

    def size(self, path: str) -> int:
        """Bytes on disk of a written table."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of each job inside when it ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session; thresholds for hot keys follow it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application.

    The same as ``--py-files``: the package is zipped and added to the context, so
    that Arrow functions find it wherever the workers run.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="seqsys-ship-")) / "seqsys.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(target))
    _shipped[sc.applicationId] = str(target)
