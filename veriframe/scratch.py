"""Scratch tables in the folder that all executors share, for results that a plan uses more than once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; only where that is unset on one machine (tests), a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="veriframe-")
            atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
        path = _own_dirs[app]
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables that materialize() has written to the shared folder; no result made before is readable after."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/veriframe")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage, survives a lost executor.

    The shuffle files of the write are of no use once the table is there, so they are deleted as it ends. codec names a
    compression other than the session's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/veriframe/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_SHUFFLES, "false")
    spark.conf.set(_CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(_CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a table that materialize() wrote; call it once nothing reads the table any more."""
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def in_ranges(df: DataFrame, key: str, name: str) -> DataFrame:
    """df as a table cut into ranges of key, whose number, in the order of the ranges, is column `name`.

    It is written because a plan that reads ranges twice may have their partitions joined together in two ways, so that
    partition numbers don't agree.
    """
    return materialize(df.repartitionByRange(key).withColumn(name, F.spark_partition_id()), "ranges")
