"""Reports over a catalogue and over file statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glotspark.functions.text import utf16_length


def key_context(key):
    return F.split_part(key, F.lit("."), F.lit(1))


def key_type(key):
    """The second part up to its first underscore; null for a key of one part."""
    return F.when(F.size(F.split(key, "\\.")) >= 2, F.split_part(F.split_part(key, F.lit("."), F.lit(2)), F.lit("_"), F.lit(1)))


def key_report(catalog: DataFrame, key: str = "key", ord: str = "ord") -> DataFrame:
    """One row: total, avg_key_length, longest_key, shortest_key (the first of equals; '' and 0 when empty)."""
    size = utf16_length(F.col(key))
    return catalog.agg(
        F.count("*").alias("total"),
        F.coalesce(F.floor(F.sum(size) / F.count("*") + 0.5), F.lit(0)).cast("long").alias("avg_key_length"),
        F.coalesce(F.max_by(key, F.struct(size, -F.col(ord))), F.lit("")).alias("longest_key"),
        F.coalesce(F.min_by(key, F.struct(size, F.col(ord))), F.lit("")).alias("shortest_key"),
    )


def by_context(catalog: DataFrame, key: str = "key") -> DataFrame:
    return catalog.groupBy(key_context(F.col(key)).alias("context")).agg(F.count("*").alias("n"))


def by_type(catalog: DataFrame, key: str = "key") -> DataFrame:
    kind = key_type(F.col(key))
    return catalog.where(kind.isNotNull()).groupBy(kind.alias("type")).agg(F.count("*").alias("n"))


def grouping_report(catalog: DataFrame, key: str = "key") -> DataFrame:
    """by_context, by_type and the total in one pass; grain tells which."""
    rows = catalog.select(key_context(F.col(key)).alias("context"), key_type(F.col(key)).alias("type"))
    return rows.groupingSets([["context"], ["type"], []], "context", "type").agg(F.grouping_id().alias("g"), F.count("*").alias("n")).select(
        F.when(F.col("g") == 1, "context").when(F.col("g") == 2, "type").otherwise("total").alias("grain"), "context", "type", "n"
    )


def summary(file_stats: DataFrame) -> DataFrame:
    """One row of sums and counts over files."""
    changed = (F.coalesce("extracted", F.lit(0)) > 0) | (F.coalesce("data_constants", F.lit(0)) > 0)
    return file_stats.agg(
        F.count("*").alias("total_files"), F.count_if(changed).alias("changed_files"), F.coalesce(F.sum("extracted"), F.lit(0)).alias("total_extracted"),
        F.coalesce(F.sum("data_constants"), F.lit(0)).alias("total_data_constants"), F.count("error").alias("errors"),
    )


def failure_rate(failed, attempted):
    """'12.5%'."""
    return F.concat(F.format_string("%.1f", failed * 100.0 / attempted), F.lit("%"))


def warnings(top_level: DataFrame) -> DataFrame:
    """Module-level constants by file and line, nulls as line 0; files in binary order."""
    return top_level.orderBy("file", F.coalesce("line", F.lit(0)))


def file_stats(facts: DataFrame) -> DataFrame:
    """file, extracted, data_constants, skipped, error of the sources' facts (see tsx.facts); nulls count as 0."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return facts.select("file", zero("extracted"), zero("data_constants"), zero("skipped"), "error")


def warnings_markdown(top_level: DataFrame) -> str:
    """The warnings as a page with a table, or as a page that says there are none."""
    rows = warnings(top_level).collect()  # a page for people: one row per module-level constant in the sources
    title = ["# Module-level translations", ""]
    if not rows:
        return "\n".join([*title, "None found.", ""])
    said = [f"| {r.file} | {r.name or '-'} | {r.line or '-'} | {f'`{r.intl_key}`' if r.intl_key else '-'} |" for r in rows]
    return "\n".join([*title, "| file | constant | line | key |", "| --- | --- | --- | --- |", *said, ""])


def preview(rows: DataFrame, key: str, by: list[str], order: str, n: int = 5) -> DataFrame:
    """The first n keys of each group, joined, with ... where there are more.

    Ranks up to n are taken in each task before the shuffle, so a group of any size sends n rows a task.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    first = rows.select(*by, order, key, rank.alias("_rank")).where(F.col("_rank") <= n)
    listed = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_rank", key))).alias("_first"))
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"c.{c}").eqNullSafe(F.col(f"l.{c}"))
    named = counts.alias("c").join(listed.alias("l"), same)
    return named.select(*[F.col(f"c.{c}").alias(c) for c in by], "n", F.concat(F.array_join(F.transform("_first", lambda x: x[key]), ", "), F.when(F.col("n") > n, "...").otherwise("")).alias("preview"))
