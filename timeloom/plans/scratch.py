"""Tables that cut lineage, written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a temporary one is set on a single machine; a cluster
    must name one, since its executors don't share local folders."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="timeloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The written table survives lost executors, and its known size lets Spark decide on
    broadcasts by itself. Files stay until the session's folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote, once nothing reads it any more; other tables are left alone."""
    spark = table.sparkSession
    own = f"/{spark.sparkContext.applicationId}/"
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if own in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written_text(df: DataFrame, label: str, by: str) -> DataFrame:
    """Write the column ``value`` as text, a folder per ``by``, in the shared folder, and read it back with the column ``by``.
    Records end in a control character, so that they may hold line feeds."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("lineSep", "\x1e").partitionBy(by).text(path)
    return spark.read.option("lineSep", "\x1e").schema(f"value string, {by} long").text(path)


def listed(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``path, length, modificationTime`` of the files below ``path`` whose name fits the pattern; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "modificationTime")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While it holds, Arrow batches to and from Python have at most ``rows`` rows: of long texts the default of 10,000
    makes large buffers in the JVM and in each worker. For work that runs before the block ends, such as ``materialise``."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
