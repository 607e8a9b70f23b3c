"""Intermediate results in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


#: Where this process has written intermediate results that are still there.
_PATHS: list[str] = []


@cache
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the warehouse, or in local mode a temporary folder."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return _own_dir()
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    _PATHS.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Deletes all that written() has made in this process, and says how many tables that were.

    To be called once results have been saved: what still is to be computed from such tables can no longer be.
    """
    paths = [_PATHS.pop() for _ in range(len(_PATHS))]
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)
