"""From occurrences to the catalogue: reuse of keys, assignment, collisions.

Order is explicit: (file, ord). The first file's context owns a text's key for all later files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glotspark.functions import paths, text


def first_wins(occurrences: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group.

    A grouped minimum of the order with the row behind it: partial minima are taken before the
    shuffle, so a text that fills a third of the rows costs one row a task.
    """
    rest = [c for c in occurrences.columns if c not in by and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    return occurrences.groupBy(*by).agg(first).select(*by, *[F.col(f"_first.{c}").alias(c) for c in [*order, *rest]]).select(*occurrences.columns)


def last_wins(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each group: what overwriting by key leaves."""
    rest = [c for c in rows.columns if c not in by and c not in order]
    last = F.max(F.struct(*order, *rest)).alias("_last")
    return rows.groupBy(*by).agg(last).select(*by, *[F.col(f"_last.{c}").alias(c) for c in [*order, *rest]]).select(*rows.columns)


def _vars(rows: DataFrame) -> Column:
    return F.array_sort(F.coalesce("vars", F.array().cast("array<string>")))


def owners(occurrences: DataFrame, context: Column | None = None) -> DataFrame:
    """text, vars (sorted), file, ord, context: the first occurrence of each text with its variables, whose file owns the key."""
    own = (paths.key_context(F.col("file")) if context is None else context).alias("context")
    rows = occurrences.select("text", _vars(occurrences).alias("vars"), "file", "ord", own)
    return first_wins(rows, ["text", "vars"], ["file", "ord"])


def joined_keys(occurrences: DataFrame, keyed: DataFrame) -> DataFrame:
    """Occurrences with the key of their text and variables; keyed: text, vars (sorted), key."""
    known = keyed.select(F.col("text").alias("_t"), F.col("vars").alias("_v"), "key")
    rows = occurrences.withColumn("_vars", _vars(occurrences))
    same = F.col("text").eqNullSafe(F.col("_t")) & (F.col("_vars") == F.col("_v"))
    return rows.join(known, same, "left").drop("_t", "_v", "_vars")


def with_keys(occurrences: DataFrame, strategy: str = "semantic", context: Column | None = None, **how) -> DataFrame:
    """Occurrences (file, ord, text, vars, ...) with the key that each uses.

    Equal texts with equal sorted variables share the key of the first.
    """
    first = owners(occurrences, context)
    return joined_keys(occurrences, first.withColumn("key", text.context_key(F.col("text"), F.col("context"), strategy, **how)))


def first_keys(rows: DataFrame, key: Column, order: list[str], text_column: str = "text") -> DataFrame:
    """key and order of the first row of each text.

    Texts are told apart by 192 bits of two hashes, taken before the shuffle, so that rows are grouped and
    sorted by those and not by whole texts; keys are made behind it, of the first rows only.
    """
    rest = [c for c in rows.columns if c not in order]
    slim = rows.select(F.md5(F.encode(F.col(text_column), "UTF-8")).alias("_a"), F.xxhash64(text_column).alias("_b"), *rows.columns)
    first = slim.groupBy("_a", "_b").agg(F.min(F.struct(*order, *rest)).alias("_first")).select("_first.*")
    return first.select(key.alias("key"), *order)


def catalogue(keyed: DataFrame) -> DataFrame:
    """key, text, context (the file), interpolations, ord: one row per key, the last text of equal keys."""
    rows = keyed.select("key", "text", F.col("file").alias("context"), F.array_sort(F.coalesce("vars", F.array().cast("array<string>"))).alias("interpolations"), "ord")
    first = first_wins(rows, ["key", "text"], ["context", "ord"])
    return last_wins(first, ["key"], ["context", "ord"])


def collisions(keyed: DataFrame) -> DataFrame:
    """key, texts: keys that stand for more than one text. Over a catalogue, which is unique by key, there are none.

    Only keys whose smallest and greatest text differ have their texts gathered.
    """
    several = keyed.groupBy("key").agg((F.min("text") < F.max("text")).alias("several")).where("several").select("key")
    pairs = keyed.select("key", "text").join(several, "key", "left_semi").distinct()
    return pairs.groupBy("key").agg(F.array_sort(F.collect_list("text")).alias("texts"))


def position_join(collected: DataFrame, replaced: DataFrame) -> DataFrame:
    """Replacements with the key of the occurrence at the same place."""
    return replaced.join(collected.select("file", "start", "end", "kind", "key"), ["file", "start", "end", "kind"])


def batches(rows: DataFrame, size: int, order: list[str], by: list[str], keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """rows with batch_id: consecutive rows of a group, size at a time.

    With keep (which stores a table once) no group has to fit in a task: the rows are stored in
    ranges of their order, each range is numbered on its own, and the numbers of rows in the ranges before
    are added. Without, a window over each group numbers them.
    """
    if keep is None:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return rows.withColumn("batch_id", F.floor((place - 1) / size).cast("long"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keep(rows.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most a row for each range
    counts = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    same = F.col("_part") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    numbered = ranged.withColumn("_place", place).join(F.broadcast(counts), same)
    return numbered.select(*rows.columns, F.floor((F.col("_before") + F.col("_place") - 1) / size).cast("long").alias("batch_id"))
