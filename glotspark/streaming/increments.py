"""Locale entries that arrive bit by bit, merged into a versioned table.

Each micro-batch writes one version of the table, named after the batch. A batch that is run again
after a failure overwrites its own version from the one before it, so merging is exactly-once; the
stream's checkpoint keeps which files were taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from glotspark.functions.text import needs_translation
from glotspark.operators.catalog import last_wins

ENTRIES = T.StructType([T.StructField("locale", T.StringType()), T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("ord", T.LongType())])


def versions(spark: SparkSession, table: str) -> list[int]:
    """The complete versions of the table, oldest first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    names = [(s.getPath().getName(), s.getPath()) for s in system.listStatus(path)]
    done = [int(n[2:]) for n, p in names if n.startswith("v=") and system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(done)


def current(spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
    """The newest version, or the newest one before a batch; empty where there is none."""
    known = [v for v in versions(spark, table) if before is None or v < before]
    return spark.read.schema(ENTRIES).parquet(f"{table}/v={known[-1]}") if known else spark.createDataFrame([], ENTRIES)


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the entries of new: the last of each key wins, a blank never replaces a value; order of first sight is kept."""
    rows = old.select("*", F.lit(0).alias("age")).unionByName(new.select(*old.columns, F.lit(1).alias("age")))
    rows = rows.withColumn("filled", ~needs_translation(F.col("value")))
    last = last_wins(rows, ["locale", "key"], ["filled", "age", "ord"]).drop("filled", "age", "ord")
    first = rows.groupBy("locale", "key").agg(F.min_by("ord", F.struct("age", "ord")).alias("ord"))
    return last.join(first, ["locale", "key"]).select(*old.columns)


def merge_stream(spark: SparkSession, incoming: str, table: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Takes what is in the incoming folder (Parquet of locale entries) and then stops; run again for more."""
    stream = spark.readStream.schema(ENTRIES).option("maxFilesPerTrigger", files_per_batch).parquet(incoming)

    def write(batch: DataFrame, number: int) -> None:
        merged(current(spark, table, before=number), batch).write.mode("overwrite").parquet(f"{table}/v={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
