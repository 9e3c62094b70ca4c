"""Where intermediate tables go.

A stage that is read more than once, or that ends a long lineage, is written to the folder that all
executors share (``spark.checkpoint.dir``) and read again.  A lost executor then costs only the
running tasks.  Queries are lazy, so their tables stay until ``clear`` is called once results are consumed.  Only a session without that setting (tests, a laptop) gets a folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a local one is made only where none is set."""
    known = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="askmill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set(SETTING, "file://" + folder)
    return "file://" + folder


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; for when the results of its queries are consumed or saved."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def settle(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table (column types kept)."""
    spark = df.sparkSession
    path = f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    spark.sparkContext._jvm.System.gc()  # frees the shuffle files of what is written now; else they stay until the driver happens to collect garbage
    return spark.read.schema(df.schema).parquet(path)
