"""Tables in the folder that driver and executors share: lineage is cut there, and lost executors only cost their tasks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and the session is local (tests), a folder of this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return _own_folder()
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


@lru_cache(1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="talus-tables-")


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of ``path``, the path in its terms)."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, path: str) -> None:
    files, target = file_system(spark, path)
    files.delete(target, True)


def _delete_late(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001 - the session may have been stopped already
        pass


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder, parted by a column if one is given, and read back; it goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/talus-{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    atexit.register(_delete_late, spark, path)
    return spark.read.schema(df.schema).parquet(path)
