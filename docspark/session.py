"""The shared work folder for tables that cut lineage, and its removal."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

@functools.cache
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="docspark-")


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name below the cluster's shared ``spark.checkpoint.dir``.

    Only a local session without that setting gets a machine-local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = _local_base()
    folder = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


_made: dict[str, list[str]] = {}


def remove_work(spark: SparkSession) -> int:
    """Delete the work folders this application made, once their results are read or written.

    Tables made of them can't be read afterwards. Returns how many there were.
    """
    folders = _made.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(folders)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_and_read(df: DataFrame, purpose: str, *partition_by: str) -> DataFrame:
    """Cut lineage by a written table, so lost executors cost no recomputation.

    The table stands for the shuffles that made it, so their files are removed once it is
    written, not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    folder = work_folder(spark, purpose)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(folder)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)
