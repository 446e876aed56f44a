"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's spark.checkpoint.dir, removed when the driver ends; in local mode, where that is unset, below a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="glotspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return path.toString()


def keeper(spark: SparkSession, name: str) -> Callable[[DataFrame, str], DataFrame]:
    """Stores a table once in a folder of its own."""
    base = shared_folder(spark, name)

    def keep(df: DataFrame, part: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{base}/{part}")
        return spark.read.schema(df.schema).parquet(f"{base}/{part}")

    return keep
